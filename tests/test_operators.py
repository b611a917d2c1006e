"""Operators against plain Python restatements."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vspark.operators import annotation, batches, filters, models, summaries
from vspark.plans.rules import RankModel, RuleError, ScoreFunction, normalised, parse_rank_model, parse_sections
from vspark.sources import files
from vspark.sources.header import Header, HeaderError, parse_header

from records import four_plugins


def fold(rows):
    """The batches of (chrom, features) rows by the sequential rule."""
    out, current, chrom, n = [], set(), None, -1
    for c, f in rows:
        c = c.removeprefix("chr")
        if c != chrom or not (set(f) & current):
            n += 1
            current = set(f)
        else:
            current |= set(f)
        chrom = c
        out.append(n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    cases, rows, base = [], [], 0
    for k in range(60):
        case = [(rng.choice(["1", "chr1", "2"]) if rng.random() < 0.2 else "1", rng.sample("ABCDE", rng.randint(0, 2))) for _ in range(rng.randint(1, 12))]
        # Cases are kept apart by a chromosome of their own.
        case = [(f"{c}_{k}" if not c.startswith("chr") else f"chr{c[3:]}_{k}", f) for c, f in case]
        cases.append((base, fold(case)))
        rows += [(base + i, c, f) for i, (c, f) in enumerate(case)]
        base += len(case)
    df = spark.createDataFrame(rows, "idx long, chrom string, features array<string>")
    got = {r.idx: (r.run, r.batch) for r in batches.batches(df).collect()}
    assert len(got) == len(rows)
    for start, expected in cases:
        mine = [got[start + i] for i in range(len(expected))]
        for i in range(1, len(expected)):
            assert (mine[i] == mine[i - 1]) == (expected[i] == expected[i - 1]), (start, i)


def test_last_record_of_an_id_wins_at_the_first_place(spark):
    df = spark.createDataFrame([(0, 0, 0, "a", "x"), (1, 0, 0, "b", "y"), (2, 0, 0, "a", "z"), (3, 0, 1, "a", "w")], "idx long, run int, batch int, variant_id string, v string")
    assert sorted((r.idx, r.v) for r in batches.last_of_each_id(df).collect()) == [(0, "z"), (1, "y"), (3, "w")]


def test_runs_across_pieces(spark):
    step = 1 << 20
    rows = [(0, "1"), (1, "chr1"), (step, "1"), (step + 1, "2"), (5 * step, "2"), (6 * step, "1"), (6 * step + 1, "1")]
    got = batches.chromosome_runs(spark.createDataFrame(rows, "idx long, chrom string")).orderBy("idx").collect()
    assert [r.run for r in got] == [0, 0, 0, 1, 1, 2, 2]


def test_regions_are_half_open(spark):
    r = spark.createDataFrame([("1", 50, 100, "A"), ("1", 250, 600, "B"), ("1", 90, 95, "C"), ("1", 5, 5, "E"), ("2", 1, 10**9, "Z")], "chrom string, start long, stop long, symbol string")
    v = spark.createDataFrame([(i, "1", p) for i, p in enumerate((49, 50, 92, 99, 100, 250, 599, 600, 5))] + [(99, "2", 10**8)], "idx long, chrom_key string, pos long")
    got = {x.idx: x.annotation for x in annotation.overlapping_regions(v, r, 1 << 20).collect()}
    assert got == {1: "A", 2: "A,C", 3: "A", 5: "B", 6: "B", 99: "Z"}


def test_bed(spark):
    text = spark.createDataFrame([(0, "#c"), (1, "chr1 5000 6000 G1"), (2, "2\t100\t200"), (3, "MT 10 20 X"), (4, "")], "idx long, value string")
    assert [tuple(r) for r in files.parse_regions(text).orderBy("start").collect()] == [("2", 0, 200, "2"), ("M", 10, 20, "X"), ("1", 1000, 6000, "G1")]


def test_frequencies(spark):
    records = [(0, "1", 5150, 5150, ["C"], ["0.00031"], ["0.001"]), (1, "1", 100, 103, ["A", "G"], ["0.1", "0.2"], None), (2, "1", 101, 101, ["G"], ["0.3"], ["0.4"])]
    r = spark.createDataFrame(records, "ord long, chrom string, pos long, end long, alts array<string>, af array<string>, max_af array<string>")
    v = spark.createDataFrame([(0, "1", 5150, "C"), (1, "1", 5150, "T"), (2, "1", 102, "G"), (3, "1", 101, "G"), (4, "1", 100, "A,G"), (5, "1", 104, "G")], "idx long, chrom_key string, pos long, alt string")
    assert {x.idx: (x.af, x.max_af) for x in annotation.frequencies(v, r).collect()} == {0: ("0.00031", "0.001"), 2: ("0.2", None), 3: ("0.3", "0.4")}


def test_lookups(spark):
    s = spark.createDataFrame([(1, 0, "1", 5, "A", "9"), (0, 1, "1", 5, "A", "1"), (0, 2, "1", 5, "A", "2"), (1, 0, "1", 6, "A", "7")], "source int, ord long, chrom string, pos long, alt string, raw string")
    v = spark.createDataFrame([(0, "1", 5, "A"), (1, "1", 6, "A"), (2, "1", 5, "T")], "idx long, chrom_key string, pos long, alt string")
    assert {x.idx: x.raw for x in annotation.score_lookup(v, s, ["raw"]).collect()} == {0: "2", 1: "7"}
    assert {x.idx for x in annotation.known_sites(v, s).collect()} == {0, 1}
    z = spark.createDataFrame([(0, "1", 5, "A", 0.0), (1, "1", 6, "A", -1.5)], "ord long, chrom string, pos long, alt string, score double")
    assert {x.idx: x.score for x in annotation.splice_scores(v, z).collect()} == {1: -1.5}


def test_filters(spark):
    df = spark.createDataFrame([(i, f"X={x}") for i, x in enumerate(("0.01", "0.5,0.02", "0.9", "0", "."))] + [(5, ".")], "idx long, info string")
    kept = lambda **k: {r.idx for r in filters.filter_variants(df, "X", 0.05, **k).collect()}
    assert kept() == {0, 1, 3, 4, 5} and kept(greater=True) == {2, 3, 4, 5} and kept(discard=True) == {0, 1}
    with pytest.raises(ValueError):
        filters.filter_variants(df, "Y", header_keys=["X"])
    rows, seen = filters.with_counters(df, filters.passes(filters.least_value(F.col("info"), "X"), 0.05), "counts")
    rows.collect()
    assert seen.get == {"total": 6, "passed": 5, "removed": 1}


def test_score_functions(spark):
    f = ScoreFunction("float")
    f.add_interval(0, 10, 1.0)
    f.add_interval(10, 20, 2.9)
    f.not_reported = -3.0
    df = spark.createDataFrame([(x,) for x in (None, 0.0, 5.0, 10.0, 19.9, 20.0, -1.0)], "x double")
    assert [r[0] for r in df.select(f.column(F.col("x"))).collect()] == [-3, -3, 1, 2, 2, 0, 0]
    assert (f.score_min, f.score_max) == (-3.0, 2.9)
    g = ScoreFunction("integer")
    g.add_value(5, 7.0)
    assert [r[0] for r in df.select(g.column(F.col("x").cast("long"))).collect()] == [0, 0, 7, 0, 0, 0, 0]
    # Floats are matched by their text, so that 5 never meets 5.0.
    h = ScoreFunction("float")
    h.add_value(5, 7.0)
    assert {r[0] for r in df.select(h.column(F.col("x"))).collect()} == {0}
    s = ScoreFunction("string")
    s.add_string("High", 4.0)
    assert [r[0] for r in spark.createDataFrame([("HIGH",), ("x",), ("",), (None,)], "x string").select(s.column(F.col("x"))).collect()] == [4, 0, 0, 0]
    h.add_interval(1, 2, 1.0)
    with pytest.raises(RuleError):
        h.mode
    with pytest.raises(NotImplementedError):
        ScoreFunction("float").mode
    with pytest.raises(RuleError):
        ScoreFunction("float", equal=True).score_range()


@pytest.mark.parametrize(("how", "bounds"), [("min", (-3.0, 2.0)), ("max", (0.0, 4.0)), ("sum", (-3.0, 6.0)), ("other", (0.0, 0.0))])
def test_category_bounds(how, bounds):
    a, b = ScoreFunction("float", not_reported=-3.0), ScoreFunction("float")
    a.add_interval(0, 1, 2.0)
    b.add_interval(0, 1, 4.0)
    from vspark.plans.rules import Plugin

    plugins = {n: Plugin(n, "INFO", "float", "c", [","], n) for n in "ab"}
    assert RankModel("m", 1.0, {"c": how}, plugins, {"a": a, "b": b}).category_bounds("c") == bounds


def test_normalised(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert df.select(normalised(F.col("x"), 0.0, 4.0)).first()[0] == 0.25
    for low, high in ((2.0, 4.0), (4.0, 2.0), (1.0, 1.0)):
        with pytest.raises(Exception):
            df.select(normalised(F.col("x"), low, high)).collect()


def test_record_rules(spark):
    m = parse_rank_model(four_plugins())
    df = spark.createDataFrame([("CLNSIG=2|5;GeneticModels=1:AD|AD_dn",), ("CLNSIG=x;GeneticModels=1:AR_comp_dn|AD_dn",), (".",)], "info string")
    assert [tuple(r) for r in df.select(m.plugins["CLNSIG"].column(), m.plugins["GeneticModels"].column()).collect()] == [(5, "AD"), (None, "AR_comp_dn"), (None, None)]


@pytest.mark.parametrize("broken", ["[Version]\nname = x", "[Version]\nversion = a\nname = x", "[Version]\nversion = 1\nname = x\n[P]\nfield = NO", "[Version]\nversion = 1\nname = x\n[P]\nfield = INFO\ndata_type = float", "[[x]]", "word"])
def test_broken_rules(broken):
    with pytest.raises(RuleError):
        parse_rank_model(broken)


def test_sections():
    assert parse_sections("a = 'x, y' # c\nb = ',',\nc = ',',':','|'\n[s]\nd = 1 # z\n[[t]]\ne = f\n[u]\n") == {"a": "x, y", "b": [","], "c": [",", ":", "|"], "s": {"d": "1", "t": {"e": "f"}}, "u": {}}


def test_header():
    lines = ["##fileformat=VCFv4.1", '##INFO=<ID=CSQ,Number=.,Type=String,Description="x. Format: Allele|Gene">', '##INFO=<ID=A,Number=A,Type=Float,Description="a",Source="s",Version="1">', "##contig=<ID=1>", "##k=1", "##k=2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1"]
    h = parse_header(lines)
    assert h.samples == ["s1"] and h.csq_columns == ["Allele", "Gene"] and h.has("INFO", "A") and h.lines()[-2:] == ["##k=2", lines[-1]]
    h.add("FILTER", "q10", description="low")
    assert '##FILTER=<ID=q10,Description="low">' in h.lines()
    with pytest.raises(HeaderError):
        h.add_line("##INFO=<ID=B,Number=1>")
    with pytest.raises(HeaderError):
        Header().lines()


def test_header_entries():
    from vspark.sources.header import entry_fields

    assert entry_fields('<ID=A,Number=1, Type=Float,Description="a, \\"b\\" = c",Source=x>') == {"ID": "A", "Number": "1", "Type": "Float", "Description": 'a, \\"b\\" = c', "Source": "x"}
    assert entry_fields("<ID=A,b>") is None and entry_fields('<ID=A,Description="open>') is None and entry_fields('<ID="A"b>') is None and entry_fields("ID=A") is None
    h = Header()
    for line in ('##FILTER=<ID=q,Description="">', "##contig=<ID=1,length=5>", '##ALT=<ID=DEL,Description="x">', '##INFO=<Description="d",Type=Flag,Number=0,ID=F>', '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">'):
        h.add_line(line)
    assert all(h.has(k, i) for k, i in (("FILTER", "q"), ("contig", "1"), ("ALT", "DEL"), ("INFO", "F"), ("FORMAT", "GT")))
    for line in ('##INFO=<ID=B,Number=x,Type=Float,Description="d">', '##INFO=<ID=B,Number=1,Type=Text,Description="d">', '##FORMAT=<ID=B,Number=0,Type=Flag,Description="d">', "##FILTER=<ID=q>", "##contig=<length=5>", '##ALT=<ID=,Description="x">', "##INFO=B"):
        with pytest.raises(HeaderError):
            h.add_line(line)


def test_pedigrees():
    f = files.parse_pedigree("1\tkid\tdad\tmum\t1\t2\n1\tdad\t0\t0\t1\t1\n1\tmum\t0\t0\t2\t1\n2 a 0 0 2 1\n")
    assert [x.name for x in f] == ["1", "2"] and files.affected_families(f) == f[:1]
    with pytest.raises(ValueError):
        files.affected_families(f[1:])
    with pytest.raises(OSError):
        files.check_members(f, ["kid", "dad", "mum"])
    with pytest.raises(ValueError):
        files.parse_pedigree("1 kid dad 0 1 2")


def test_counts(spark):
    df = spark.createDataFrame([(0, "1", 1, "GT:AD", ["0/1:3,4", "./."], "GeneticModels=1:AD|AR_hom,2:AD"), (1, "1", 2, "GT:AD", ["1/1:1,1", "0/0:2,0"], ".")], "idx long, chrom string, pos long, format string, samples array<string>, info string")
    assert {tuple(r) for r in summaries.sample_counts(df, ["a", "b"]).collect()} == {("a", 2, 2, 9), ("b", 0, 1, 2)}
    assert {r[0] for r in summaries.families_present(df).collect()} == {"1", "2"}
    assert {tuple(r) for r in summaries.model_counts(df).collect()} == {("AD", 1), ("AR_hom", 1)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["0/0", "0/1", "1/1", "./."]), st.floats(0, 120)), min_size=1, max_size=4))
def test_model_score(spark, calls):
    import math

    from vspark.functions.variant import genotype

    right = [1 - 10 ** -(min(q, 99) / 10) for _, q in calls if q > 0]
    value = -10 * math.log10(1 - math.prod(right)) if right else 0
    columns = [genotype(F.lit(g), gq=F.lit(repr(q))) for g, q in calls]
    got = spark.range(1).select(models.model_score(columns)).first()[0]
    assert abs(got - value) <= 0.5 + 1e-6


def test_streaming_filter(spark, tmp_path):
    from records import DUO, DUO_SAMPLES, variant_file

    from vspark.streaming.variants import per_batch, stream_filter, stream_variants

    folder = tmp_path / "in"
    folder.mkdir()
    text = variant_file(DUO, DUO_SAMPLES)
    for i in range(2):
        (folder / f"{i}.vcf").write_text(text)
    stream = stream_filter(stream_variants(spark, str(folder), parse_header(text.splitlines())), key="MQ", threshold=2)
    q = per_batch(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 22


def test_scores_are_columns_one_on_another(spark):
    """No part of a score is evaluated for each place that uses it, nor by functions of single entries of a list."""
    import re

    from vspark import queries
    from vspark.operators import scores

    rows = spark.createDataFrame([("MQ=60;DB;1000GAF=0.01,0.5;CADD=20,1", "PASS"), ("MQ=7;CADD=1", "LOWQ;PASS"), (".", "low;q"), ("1000GAF=x;MQ=1.5", "Pass")], "info string, filter string")
    out = scores.score_variants(rows, parse_rank_model(queries.RULES))
    assert [r.rank_score for r in out.select("rank_score").collect()] == [-12 + 4 - 1 + 3, 3 + 2 + 1 + 3, 3 + 0 + 1 + 0, 3 + 0 + 1 + 3]
    plan = out.select("rank_score", "rank_score_normalized")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"transform\(array\((?!null)|transform\(split|filter\(", plan)
    assert plan.count("1000GAF=") < 12


def test_batches_and_last_ids_across_pieces(spark):
    """Sums within pieces of the file order and what is added to them; rows that stay are told by narrow rows."""
    rng = random.Random(7)
    rows, idx, chrom = [], 0, 1
    for _ in range(400):
        idx += rng.choice([1, 2, 1 << 19, 1 << 20, 3 << 20])
        chrom += rng.random() < 0.06
        rows.append((idx, f"{'chr' * rng.randint(0, 1)}{chrom}", rng.sample("ABC", rng.choice([0, 1, 1, 1, 2])), rng.choice("vwxyz")))
    df = spark.createDataFrame(rows, "idx long, chrom string, features array<string>, variant_id string")
    got = {r.idx: (r.run, r.batch) for r in batches.batches(df).collect()}
    expected = fold([(c, f) for _, c, f, _ in rows])
    assert len(got) == len(rows)
    for i in range(1, len(rows)):
        assert (got[rows[i][0]] == got[rows[i - 1][0]]) == (expected[i] == expected[i - 1]), rows[i]
    last, first = {}, {}
    for i, (at, *_, name) in enumerate(rows):
        last[expected[i], name] = rows[i]
        first.setdefault((expected[i], name), at)
    once = batches.batched_once(df)
    assert sorted((r.idx, r.features) for r in once.collect()) == sorted((first[k], r[2]) for k, r in last.items())
    assert sorted(once.columns) == sorted(["run", "batch", *df.columns])


def test_correctable_by_one_expression(spark):
    from vspark.operators.scores import correctable

    models = ["1:AR_comp", "1:AR_comp|AR_comp_dn", "1:AD|AR_comp", "1:AR_comp,2:AD", "1:AR_comp,2:AR_comp_dn", "AR_comp", "a:b:AR_comp", "1:AR_comp|", "1:", "", "1:AR_comp,", "1:AR_comp_d", "1:AD_dn|AD"]
    rows = spark.createDataFrame([(f"X=1;GeneticModels={m}",) for m in models] + [(".",), (None,)], "info string")
    for alone, allowed in ((False, {"AR_comp", "AR_comp_dn"}), (True, {"AR_comp", "AR_comp_dn", "AD", "AD_dn"})):
        expected = [all(x in allowed for f in m.split(",") for x in f.split(":")[-1].split("|")) for m in models] + [False, False]
        assert [r[0] for r in rows.select(correctable(F.col("info"), alone)).collect()] == expected


def test_orders_compare_columns(spark):
    """No order puts lines together while it compares."""
    from vspark.operators import sorting

    rows = spark.createDataFrame([(0, "1", 5, "RankScore=1:3"), (1, "1", 40, "RankScore=1:3"), (2, "2", 5, "."), (3, "2", 7, "RankScore=1:9")], "idx long, chrom string, pos long, info string")
    ordered = sorting.by_rank(rows)
    assert [r.idx for r in ordered.collect()] == [3, 0, 1, 2] and ordered.columns == rows.columns
    sorts = [line for line in ordered._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in line]
    assert sorts and not any("concat_ws" in line for line in sorts)


def test_regions_of_any_length(spark):
    """A region lies in two bins at most, and bins are narrow where regions are."""
    rng = random.Random(5)
    regions = [("1", (s := rng.randrange(3_000_000)), s + rng.choice([1, 7, 256, 257, 5000, 40_000, 1_000_000]), f"S{i}") for i in range(300)]
    r = spark.createDataFrame(regions, "chrom string, start long, stop long, symbol string")
    places = [rng.randrange(4_000_000) for _ in range(200)] + [s for _, s, *_ in regions[:50]] + [t - 1 for _, _, t, _ in regions[:50]] + [t for _, _, t, _ in regions[:50]]
    v = spark.createDataFrame([(i, "1", p) for i, p in enumerate(places)], "idx long, chrom_key string, pos long")
    hits = {i: ",".join(sorted(n for _, s, t, n in regions if s <= p < t)) for i, p in enumerate(places)}
    assert {x.idx: x.annotation for x in annotation.overlapping_regions(v, r).collect()} == {i: h for i, h in hits.items() if h}
    bins, levels = annotation._binned(r, annotation.BIN)
    assert bins.groupBy("symbol").count().agg(F.max("count")).first()[0] <= 2 and levels == [0, 1, 3, 4, 6]


def test_lines_are_put_together_once(spark):
    """The filters of parse_variants take no copies of a computed line."""
    from vspark import queries

    plan = queries.variant_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GT:AD:GQ") <= 2
