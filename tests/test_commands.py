"""The commands end to end on small files."""

import re

import pytest
from pyspark.sql import functions as F

from records import DUO, DUO_EXPECTED, DUO_PED, DUO_SAMPLES, TRIO, TRIO_EXPECTED, TRIO_PED, TRIO_SAMPLES, four_plugins, scored_rows, variant_file
from vspark import cli
from vspark.functions.variant import info_value
from vspark.plans import commands
from vspark.plans.rules import parse_rank_model
from vspark.sources import files


def annotated(spark, tmp_path, table, samples, ped, **options):
    (tmp_path / "v.vcf").write_text(variant_file(table, samples))
    header, rows = files.read_variants(spark, str(tmp_path / "v.vcf"))
    out = commands.annotate_models(rows, header.samples, files.parse_pedigree(ped), **options).collect()
    found = {}
    for r in out:
        info = dict(e.split("=", 1) for e in r.info.split(";") if "=" in e)
        found[r.chrom, r.pos] = {k: (v.split(":", 1)[1] if ":" in v else v) for k, v in info.items()}
    return found


def partners(entry):
    return {p.split("_")[1] for p in entry.get("Compounds", "").split("|") if p}


def test_trio(spark, tmp_path):
    found = annotated(spark, tmp_path, TRIO, TRIO_SAMPLES, TRIO_PED)
    assert len(found) == len(TRIO_EXPECTED)
    for (_, pos), info in found.items():
        model, others, score = TRIO_EXPECTED[pos]
        assert (info.get("GeneticModels"), partners(info), info.get("ModelScore")) == (model, set(others.split()), score and str(score)), pos


def test_trio_strict(spark, tmp_path):
    found = annotated(spark, tmp_path, TRIO, TRIO_SAMPLES, TRIO_PED, strict=True)
    for (_, pos), info in found.items():
        model = None if pos in (1900, 800) else TRIO_EXPECTED[pos][0]
        assert info.get("GeneticModels") == model, pos


def test_trio_with_chr(spark, tmp_path):
    found = annotated(spark, tmp_path, re.sub(r"(?m)^(?=\S)", "chr", TRIO.strip()), TRIO_SAMPLES, TRIO_PED)
    assert {pos: i.get("GeneticModels") for (_, pos), i in found.items()} == {pos: e[0] for pos, e in TRIO_EXPECTED.items()}


def test_duo(spark, tmp_path):
    found = annotated(spark, tmp_path, DUO, DUO_SAMPLES, DUO_PED)
    assert {k: (i["GeneticModels"], partners(i)) for k, i in found.items()} == {k: (m, set(o.split())) for k, (m, o) in DUO_EXPECTED.items()}
    assert {i["ModelScore"] for i in found.values()} == {"57"}


def test_structural_variants_at_one_place_both_stay(spark, tmp_path):
    text = "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tproband\tfather\tmother\n"
    text += "chr16\t1\t.\tG\t<DEL>\t487\tPASS\tSVTYPE=DEL;END=1001;SVLEN=1000\tGT:CN:CNQ\t0/1:1:487\t./.:.:.\t./.:.:.\nchr16\t1\t.\tG\t<DEL>\t69\tPASS\tSVTYPE=DEL;END=101;SVLEN=100\tGT:CN:CNQ\t./.:.:.\t./.:.:.\t0/1:1:69\n"
    (tmp_path / "v.vcf").write_text(text)
    header, rows = files.read_variants(spark, str(tmp_path / "v.vcf"))
    out = commands.annotate_models(rows, header.samples, files.parse_pedigree(TRIO_PED)).select(info_value(F.col("info"), "END"), info_value(F.col("info"), "GeneticModels"), info_value(F.col("info"), "ModelScore")).collect()
    assert {tuple(r) for r in out} == {("1001", "1:AD|AD_dn", None), ("101", "1:AR_hom|AR_hom_dn", None)}


def test_scores(spark):
    model = parse_rank_model(four_plugins())
    assert model.bounds() == (-25.0, 12.0)
    rows = []
    for pos, models, cadd, af, _ in scored_rows():
        entries = ["MQ=1"] + [f"GeneticModels=1:{models}"] * bool(models) + [f"CADD={cadd}"] * (cadd is not None) + [f"1000GAF={af}"] * (af is not None)
        rows.append((pos, pos, ";".join(entries)))
    df = spark.createDataFrame(rows, "idx long, pos long, info string")
    got = commands.score(df, model).select("pos", info_value(F.col("info"), "RankScore"), info_value(F.col("info"), "RankScoreNormalized"), info_value(F.col("info"), "RankScoreMinMax")).collect()
    expected = {r[0]: r[4] for r in scored_rows()}
    assert len(got) == len(expected)
    for pos, rank, normal, bounds in got:
        assert rank == f"1:{expected[pos]}" and normal == f"1:{(expected[pos] + 25) / 37!r}" and bounds == "1:-25.0:12.0"


def scored(entries):
    return [(i, 0, 0, i, v, info) for i, (v, info) in enumerate(entries)]


def test_compound_scores(spark):
    from vspark.operators.scores import compound_scores

    info = lambda score, models, compounds: f"RankScore=1:{score};RankScoreNormalized=1:{(score + 10) / 30};RankScoreMinMax=1:-10.0:20.0;GeneticModels=1:{models}" + (f";Compounds=1:{compounds}" if compounds else "")
    rows = scored([("a", info(5.0, "AR_comp", "b|c")), ("b", info(8.0, "AR_comp|AD", "a")), ("c", info(-8.0, "AR_comp_dn", "a")), ("d", info(1.0, "AD", ""))])
    df = spark.createDataFrame(rows, "idx long, run int, batch int, o long, variant_id string, info string")
    got = {r.idx: r for r in compound_scores(df).collect()}
    assert sorted(got) == [0, 1, 2]
    assert (got[0].rank_score, got[0].compounds) == ("1:-1.0", "1:b>7.0|c>-9.0")
    assert (got[1].rank_score, got[1].compounds) == ("1:8.0", "1:a>13.0")
    # The penalty stops at the least score.
    assert (got[2].rank_score, got[2].compounds, got[2].rank_score_normalized) == ("1:-10.0", "1:a>-5.0", "1:0.0")
    with pytest.raises(Exception, match="compound without a score"):
        compound_scores(spark.createDataFrame(scored([("a", info(5.0, "AR_comp", "z"))]), df.schema)).collect()


def test_cli_chain(spark, tmp_path, capsys):
    v, ped, bed, rules = (tmp_path / n for n in ("v.vcf", "f.ped", "r.bed", "rules.ini"))
    v.write_text(variant_file(TRIO.replace("QA1,QB2", "-").replace("QA1", "-").replace("QB2", "-").replace("QC3", "-"), TRIO_SAMPLES).replace("MQ=1;Annotation", "MQ=1;Old"))
    ped.write_text(TRIO_PED)
    rules.write_text(four_plugins())
    bed.write_text("#chrom\tstart\tstop\tname\n1\t5100\t6000\tNB7\nchr10\t4400\t5000\tKC3\nMT\t1\t9000\tZM\n")

    def command(*args):
        code = cli.main([*map(str, args)], spark)
        return code, capsys.readouterr()

    code, out = command("annotate", v, "-r", bed)
    assert code == 0 and "##INFO=<ID=Annotation" in out.out
    lines = [x for x in out.out.splitlines() if not x.startswith("#")]
    assert len(lines) == 15 and lines[0].split("\t")[7].endswith(";Annotation=NB7") and ";Annotation=ZM\t" in lines[-1] and "Annotation" not in lines[-2]
    (tmp_path / "a.vcf").write_text(out.out)
    code, out = command("models", tmp_path / "a.vcf", "-f", ped)
    assert code == 0 and out.out.count("GeneticModels=1:") == 13
    (tmp_path / "m.vcf").write_text(out.out)
    assert command("models", tmp_path / "m.vcf", "-f", ped)[0] == 1
    assert command("score", tmp_path / "m.vcf", "-c", rules)[0] == 1
    code, out = command("score", tmp_path / "m.vcf", "-c", rules, "--skip-plugin-check", "-r")
    assert code == 0 and out.out.count("RankScore=1:") == 15 and out.out.count("RankResult=") == 15
    (tmp_path / "s.vcf").write_text(out.out)
    code, out = command("compound", tmp_path / "s.vcf")
    assert code == 0 and out.out.count("CompoundsNormalized=1:") == out.out.count("Compounds=1:") == 7
    (tmp_path / "c.vcf").write_text(out.out)
    code, out = command("sort", tmp_path / "c.vcf")
    ranks = [float(re.search(r"RankScore=1:([-0-9.]+)", x)[1]) for x in out.out.splitlines() if not x.startswith("#")]
    assert ranks == sorted(ranks, reverse=True) and len(ranks) == 15
    code, out = command("sort", "-p", tmp_path / "c.vcf")
    assert [x.split("\t")[0] for x in out.out.splitlines() if not x.startswith("#")] == ["1"] * 9 + ["10"] * 4 + ["X", "MT"]
    assert command("filter", v)[0] == 1
    assert command("filter", v, "-a", "MQ", "-t", "2")[1].out.count("\tPASS\t") == 15
    assert command("filter", v, "-a", "MQ", "-t", "2", "-g", "-s")[1].out == ""
    assert command("config", rules)[1].out.startswith("four plugins")
    assert command("sort", "-p", v, "-o", tmp_path / "out")[0] == 0
    assert spark.read.text(str(tmp_path / "out")).count() == 15


def test_chain_over_folders(spark, tmp_path):
    """Each command reads what the one before it wrote, header and order of rows included."""
    v, ped, rules = tmp_path / "v.vcf", tmp_path / "f.ped", tmp_path / "rules.ini"
    text = variant_file(TRIO, TRIO_SAMPLES)
    v.write_text(text)
    ped.write_text("#Note\tFamilyID\tSampleID\tFather\tMother\tSex\tPhenotype\n" + "".join("x\t" + x + "\n" for x in TRIO_PED.splitlines()[1:]))
    rules.write_text(four_plugins())
    steps = [("models", "m", ["-f", ped, "-t", "alt"]), ("score", "s", ["-c", rules, "--skip-plugin-check"]), ("compound", "c", []), ("sort", "r", []), ("sort", "p", ["-p"])]
    at = v
    for command, out, options in steps:
        assert cli.main([command, str(at), "-o", str(tmp_path / out), *map(str, options)], spark) == 0
        at = tmp_path / out
    header, rows = files.read_variants(spark, str(at))
    assert header.samples == TRIO_SAMPLES and all(header.has("INFO", k) for k in ("MQ", "GeneticModels", "RankScore", "CompoundsNormalized")) and header.has("contig", "1")
    got = rows.orderBy("idx").collect()
    assert [(r.chrom, r.pos) for r in got] == [(c, int(p)) for c, p, *_ in (x.split() for x in TRIO.strip().splitlines())]
    ranked = files.read_variants(spark, str(tmp_path / "r"))[1].orderBy("idx").select(info_value(F.col("info"), "RankScore")).collect()
    ranks = [float(r[0].split(":")[1]) for r in ranked]
    assert ranks == sorted(ranks, reverse=True)


def test_order_of_lines_over_parts(spark, tmp_path):
    for name, size in (("part-00000-x.txt", 3), ("part-00001-x.txt", 400_000), ("part-00010-x.txt", 5), ("part-00002-x.txt", 7)):
        (tmp_path / name).write_text("".join(f"{name[5:10]} {k}\n" for k in range(size)))
    rows = files.lines(spark, str(tmp_path)).orderBy("idx").collect()
    keys = [tuple(map(int, r.value.split())) for r in rows]
    assert keys == sorted(keys) and len({r.idx for r in rows}) == len(rows) == 400_015


def test_long_header_and_lookups(spark, tmp_path, monkeypatch):
    import io

    head = "##fileformat=VCFv4.2\n" + "".join(f"##contig=<ID=c{k}>\n" for k in range(2_500)) + "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "kid"]) + "\n"
    (tmp_path / "v.vcf").write_text(head + "c1\t5\t.\tA\tC\t.\tPASS\tX=1\tGT\t0/1\n")
    header, rows = files.read_variants(spark, str(tmp_path / "v.vcf"))
    assert header.samples == ["kid"] and header.has("contig", "c2499") and rows.count() == 1
    monkeypatch.setattr("sys.stdin", io.StringIO((tmp_path / "v.vcf").read_text()))
    header, rows = files.read_variants(spark, "-")
    assert header.samples == ["kid"] and rows.select("pos").first()[0] == 5
    table = spark.createDataFrame([("1", 5, "a"), ("1", 9, "b"), ("chr2", 5, "c")], "chrom string, pos long, x string")
    files.write_lookup(table, str(tmp_path / "lookup"))
    found = lambda *a: sorted(r.x for r in files.read_lookup(spark, str(tmp_path / "lookup"), *a).collect())
    assert found() == ["a", "b", "c"] and found("chr1") == ["a", "b"] and found("2") == ["c"] and found("1", 5, 9) == ["a"]
    for form, text in (("alt", "1 kid 0 0 1 2"), ("mip", "#FamilyID\tSex\n1\t1"), ("x", "")):
        with pytest.raises(ValueError):
            files.parse_pedigree(text, form)
