import pytest
from pyspark.sql import functions as F

from vspark.functions import text as TX
from vspark.functions import variant as V


def one(spark, value, *columns):
    rows = spark.createDataFrame([(v,) for v in value], "x string").select(*columns).collect()
    return [r[0] if len(r) == 1 else tuple(r) for r in rows]


def test_float_text_is_the_shortest_decimal(spark):
    numbers = [0.0, -0.0, 5.0, -12.5, 0.1, 0.0001, 0.00001, 1.5e-7, 123456.789, 1e7, 12345678.0, 1e15, 1e16, 1e100, 2 / 3, -1e-5, 100.0, 0.05]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select(TX.float_text(F.col("x"))).collect()
    assert [r[0] for r in rows] == [repr(x) for x in numbers]


def test_numbers(spark):
    assert one(spark, ["1", " 2.5 ", "1e3", "5d", "abc", "", None, ".5", "-7"], TX.to_float(F.col("x"))) == [1.0, 2.5, 1000.0, None, None, None, None, 0.5, -7.0]
    assert one(spark, ["1", "2.5", "x", None], TX.is_number(F.col("x"))) == [True, True, False, False]


def test_chromosome_priority(spark):
    places = {"1": "1", "chr22": "22", "23": "0", "chrX": "23", "Y": "24", "MT": "25", "chrM": "25", "GL1": "26", "hrc7": "7"}
    assert one(spark, list(places), TX.chromosome_priority(F.col("x"))) == list(places.values())


def test_custom_priority(spark):
    assert one(spark, ["chr1", "9"], TX.chromosome_priority(F.col("x"), {"1": "7"})) == ["7", "0"]


def test_annotation_chrom(spark):
    assert one(spark, ["chr1", "CHR2", "Chr3", "MT", "chrMT", "X"], TX.annotation_chrom(F.col("x"))) == ["1", "2", "3", "M", "MT", "X"]


def test_info(spark):
    info = ["A=1;FLAG;B=x=y;A=2", ".", None]
    assert one(spark, info, V.info_value(F.col("x"), "A")) == ["2", None, None]
    assert one(spark, info, V.info_map(F.col("x")))[0] == {"A": "2", "FLAG": None, "B": None}
    assert one(spark, info[:2], V.has_info(F.col("x"), "FLAG")) == [True, False]
    assert one(spark, info[:2], V.append_info(F.col("x"), "N", F.lit("3"))) == ["A=1;FLAG;B=x=y;A=2;N=3", "N=3"]
    assert one(spark, info[:2], V.append_info(F.col("x"), "N")) == ["A=1;FLAG;B=x=y;A=2;N", "N"]
    assert one(spark, info[:2], V.replace_info(F.col("x"), "A", F.lit("9"))) == ["A=9;FLAG;B=x=y;A=9", "."]
    assert one(spark, info[:2], V.append_entries(F.col("x"), V.info_entry("N", F.lit(None).cast("string")))) == info[:2]


def test_variant_ids(spark):
    rows = [("1", 10, "A", "T", "."), ("1", 10, "N", "<DEL>", "END=20;SVLEN=10"), ("1", 10, "N", "<INS>", "SVLEN=10"), ("1", 10, "N", "]2:30]A", ".")]
    df = spark.createDataFrame(rows, "c string, p long, r string, a string, i string")
    got = [r[0] for r in df.select(V.variant_id(*[F.col(x) for x in "cprai"])).collect()]
    assert got == ["1_10_A_T", "1_10_N_DEL_END20", "1_10_N_INS_SVLEN10", "1_10_N_230A"]


#: Call: genotyped, heterozygous, homozygous alternative, homozygous reference, has the variant.
CALLS = {
    "./.": "00000", ".|.": "00000", ".": "00000", "": "00000", None: "00000", "0/0": "10010", "0|0": "10010", "0": "10010", "0/.": "10010", "./0": "10010",
    "0/1": "11001", "1|0": "11001", "1/2": "11001", "1/1": "10101", "3/3": "10101", "1": "11001", "./1": "11001", "1/.": "11001", "0/0/1": "10010",
}


def test_genotypes(spark):
    got = one(spark, list(CALLS), V.genotype(F.col("x")))
    assert ["".join(str(int(x)) for x in (g.genotyped, g.het, g.homo_alt, g.homo_ref, g.has_variant)) for g in got] == list(CALLS.values())


def test_genotype_depths(spark):
    df = spark.createDataFrame([("GT:AD:DP:GQ:PS", "0|1:10,5,x:20:99.5:7"), ("GT:AD:GQ", "0/1"), ("GT:DP", "1/1:?")], "f string, s string")
    a, b, c = [r[0] for r in df.select(V.sample_genotype(F.col("f"), F.col("s"))).collect()]
    assert (a.ref_depth, a.alt_depth, a.quality_depth, a.dp, a.gq, a.ps, a.phased) == (10, 5, 15, 20, 99.5, "7", True)
    assert (b.quality_depth, b.dp, b.gq, b.ps) == (0, 0, 0.0, None) and c.dp == 0


def test_features_and_ranks(spark):
    assert one(spark, ["Annotation=A,B,A", "."], V.features(F.col("x"))) == [["A", "B"], []]
    csq = "CSQ=T|missense_variant&x|G1,T|intergenic|G2,C|stop_gained|"
    assert one(spark, [csq, "."], V.gene_features(F.col("x"), ["Allele", "Consequence", "Gene"])) == [["G1", ""], []]
    ranks = ["RankScore=1:12", "RankScore=1:23,2:0.2", ".", "RankScore=1:-100"]
    assert one(spark, ranks, V.family_score(F.col("x"))) == [12.0, 0.2, -100.0, -100.0]
    assert one(spark, ranks, V.family_score(F.col("x"), "2")) == [-100.0, 0.2, -100.0, -100.0]
    with pytest.raises(ValueError):
        V.family_score(F.col("x"), None, "Other")


def test_natural_key(spark):
    df = spark.createDataFrame([(c,) for c in ("chr10", "chr2", "chrX", "chr1")], "c string")
    assert [r[0] for r in df.orderBy(TX.natural_key(F.col("c"))).collect()] == ["chr1", "chr2", "chr10", "chrX"]


def test_entries_of_any_value(spark):
    rows = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "a=b"), (5, "="), (6, "\n")], "idx long, value string")
    for key in ("K", "K.1", "a$1"):
        got = {r.idx: r.e for r in rows.select("idx", V.info_entry(key, F.col("value")).alias("e")).collect()}
        assert got == {1: f"{key}=x", 2: key, 3: None, 4: f"{key}=a=b", 5: f"{key}==", 6: f"{key}=\n"}


def test_numbers_of_a_list_equal_those_of_its_entries(spark):
    texts = ["0.05", "1,2.5,x", " 3 ,-.5", "", ",", "1_000,7", "5d,6", "inf,nan", "NaN,-1e-3", "1.", "+4,0x1p3", "12abc,3", None, "99999999999999999999,1", "1;2,3"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    for whole, of in ((False, TX.to_float), (True, TX.to_int)):
        for separators in (",", ",;"):
            entries = F.filter(F.transform(F.split("x", f"[{separators}]"), of), lambda n: n.isNotNull())
            for pick in (F.array_max, F.array_min):
                got = rows.select(pick(TX.numbers_in(F.col("x"), separators, whole)).cast("string").alias("a"), pick(entries).cast("string").alias("b")).collect()
                assert [r.a for r in got] == [r.b for r in got]
    assert TX.numbers_in(F.col("x"), ".") is None and TX.numbers_in(F.col("x"), ",e") is None and TX.numbers_in(F.col("x"), "") is None


def test_info_values_by_plain_searches(spark):
    infos = ["A=1", "A=1;A", "A;A=1", "A", "A=;A=2", "A=2;A=", "A=x=y", "A=1;A=x=y", "XA=1;AX=2", "A=1;B=2;XA=3", ".", "", ";A=1;", "A=é;B", None]

    def last(info):
        found = [e.split("=") for e in (info or "").split(";") if e.split("=")[0] == "A"]
        return found[-1][1] if found and len(found[-1]) == 2 else None

    # Of an entry that is not one key and one value no search may find a part.
    assert one(spark, infos, V.info_value(F.col("x"), "A")) == [last(i) for i in infos]
    assert one(spark, infos, V.has_info(F.col("x"), "A")) == [any(e.split("=")[0] == "A" for e in (i or "").split(";")) for i in infos]


def test_ranks_of_a_family_by_its_last_entry(spark):
    ranks = ["RankScore=1:2,2:3,1:4", "RankScore=12:9,1:8", "RankScore=1", "RankScore=1:", "RankScore=1:5:6", "RankScore=2:1,1:x", "RankScore=a=b;RankScore=1:7", None]
    assert one(spark, ranks, V.family_score(F.col("x"), "1")) == [4.0, 8.0, -100.0, -100.0, 5.0, -100.0, 7.0, -100.0]
    assert one(spark, ranks, V.family_score(F.col("x"))) == [4.0, 8.0, -100.0, -100.0, 5.0, -100.0, 7.0, -100.0]
    assert one(spark, ranks[:2], V.family_score(F.col("x"), "1:2")) == [-100.0, -100.0]
