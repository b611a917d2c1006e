"""Phases, healthy parents, single members and several families."""

from pyspark.sql import functions as F

from records import TRIO, TRIO_PED, TRIO_SAMPLES, variant_file
from vspark.functions.variant import genotype, info_value, sample_genotype
from vspark.operators import models, summaries
from vspark.operators.models import Family, Individual
from vspark.plans import commands
from vspark.sources import files

KID, MUM, DAD = Individual("kid", "dad", "mum", 1, 2), Individual("mum", sex=2, phenotype=1), Individual("dad", sex=1, phenotype=1)
TRIO_FAMILY = Family("1", (KID, MUM, DAD))


def calls(**gts):
    out = {}
    for name, gt in gts.items():
        text, _, ps = gt.partition(":")
        out[name] = genotype(F.lit(text), ps=F.lit(ps or None).cast("string"))
    return out


def values(spark, columns):
    return list(spark.range(1).select(*columns).first())


def test_pairs(spark):
    cases = [
        ({"kid": "0|1:1"}, {"kid": "0|1:1"}, True, False), ({"kid": "0|1:1"}, {"kid": "1|0:1"}, True, True), ({"kid": "0|1:1"}, {"kid": "0|1:2"}, True, True), ({"kid": "0|1:1"}, {"kid": "0|1:1"}, False, True),
        ({"kid": "0|1"}, {"kid": "0|1"}, True, True), ({"mum": "0/1"}, {"mum": "0/1"}, False, False), ({"mum": "0/1"}, {"dad": "0/1"}, False, True), ({"dad": "1/1"}, {"dad": "0/1"}, False, False),
    ]
    base = {"kid": "0/1", "mum": "0/0", "dad": "0/0"}
    assert values(spark, [models.compound_pair(TRIO_FAMILY, calls(**(base | a)), calls(**(base | b)), phased) for a, b, phased, _ in cases]) == [c[3] for c in cases]


def test_what_pairs_set(spark):
    cases = [("0/1", "0/0", "0/0", "0/1", True, False), ("0/1", "0/0", "0/0", "0/0", False, True), ("0/1", "./.", "0/0", "0/1", False, False)]
    columns = [x for m1, d1, m2, d2, *_ in cases for x in models.compound_flags(TRIO_FAMILY, calls(kid="0/1", mum=m1, dad=d1), calls(kid="0/1", mum=m2, dad=d2))]
    assert values(spark, columns) == [x for c in cases for x in c[4:]]


def test_x_linked(spark):
    cases = [
        (1, 1, "0/1", False, False), (1, 1, "0/0", True, True), (2, 1, "0/1", True, True), (2, 1, "1/1", False, False), (1, 2, "0/1", True, True), (1, 2, "0/0", False, False), (2, 2, "0/1", False, True),
        (2, 2, "1/1", True, True), (2, 2, "./.", True, True), (0, 0, "1/1", True, True), (0, 1, "0/1", True, True),
    ]
    columns, expected = [], []
    for sex, phenotype, gt, recessive, dominant in cases:
        family = Family("f", (Individual("i", sex=sex, phenotype=phenotype),))
        columns += [models.x_recessive(family, calls(i=gt)), models.x_dominant(family, calls(i=gt)), models.x_recessive(family, calls(i=gt), strict=True)]
        expected += [recessive, dominant, recessive and gt != "./."]
    assert values(spark, columns) == expected


def test_autosomal(spark):
    cases = [(1, "0/0", True, True), (1, "0/1", False, True), (1, "1/1", False, False), (2, "0/0", False, False), (2, "0/1", True, False), (2, "1/1", False, True), (2, "./.", True, True), (1, "./.", True, True), (0, "1/1", True, True)]
    columns, expected = [], []
    for phenotype, gt, dominant, recessive in cases:
        family = Family("f", (Individual("i", phenotype=phenotype),))
        columns += [models.dominant(family, calls(i=gt)), models.recessive(family, calls(i=gt)), models.dominant(family, calls(i=gt), reduced_penetrance=F.lit(True))]
        expected += [dominant, recessive, gt != "1/1" if phenotype == 1 else dominant]
    assert values(spark, columns) == expected


def test_two_families(spark, tmp_path):
    (tmp_path / "v.vcf").write_text(variant_file(TRIO, TRIO_SAMPLES))
    header, rows = files.read_variants(spark, str(tmp_path / "v.vcf"))
    families = files.parse_pedigree(TRIO_PED + "2\tproband\t0\t0\t1\t2\n")
    out = commands.annotate_models(rows, header.samples, families).select("pos", info_value(F.col("info"), "GeneticModels"), info_value(F.col("info"), "Compounds"), info_value(F.col("info"), "ModelScore")).collect()
    got = {r[0]: r for r in out}
    assert got[1200][1] == "1:AR_hom,2:AR_hom" and got[2400][1] == "1:AR_comp|AR_comp_dn,2:AD|AR_comp"
    assert got[4000][1] == "2:AR_hom" and got[2400][3] == "1:55,2:60"
    assert [x.split(":")[0] for x in got[2400][2].split(",")] == ["1", "2"]


def test_sample_fields_and_json(spark):
    df = spark.createDataFrame([("GT:PS", "0|1:44")], "f string, s string")
    assert df.select(sample_genotype(F.col("f"), F.col("s"))).first()[0].ps == "44"
    assert summaries.as_json(df).first()[0] == '{"f":"GT:PS","s":"0|1:44"}'


def test_genotypes_of_columns_equal_those_of_one_expression(spark):
    """The staged columns of with_genotypes, on odd fields too; and a filter on them copies no part."""
    from vspark.operators.genotypes import with_genotypes

    formats = ["GT:AD:DP:GQ:PS", "AD:GT:GQ", "GT", "GTX:GT", "", "DP", "PS:GT", None]
    samples = ["0/1:3,4:7:50:a", "0|1:1,2,3,x", "3,4:1|0:9.5", "./.", ".", "0/0/1:5", "0/1|2:1,,2::", "1|1|0", "", "/", "|:7", "1:x", "0/.:.:5:nan", "7:0|0", None]
    rows = spark.createDataFrame([(f, [s, t]) for f in formats for s, t in zip(samples, samples[1:] + samples[:1], strict=True)], "format string, samples array<string>")
    sides = [F.get("samples", F.lit(i)) for i in (0, 1)]
    staged = with_genotypes(rows.withColumn("one", F.struct(*[sample_genotype(F.col("format"), s).alias(n) for n, s in zip("ab", sides, strict=True)])), dict(zip("ab", sides, strict=True)))
    got = staged.select(F.to_json("calls").alias("calls"), F.to_json("one").alias("one")).collect()
    assert len(got) == len(formats) * len(samples) and [r.calls for r in got] == [r.one for r in got]
    plan = with_genotypes(rows, dict(zip("ab", sides, strict=True))).filter("calls.a.het and not calls.b.homo_alt").select("format")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index") < 40 and plan.index("Filter") < plan.index("substring_index")
