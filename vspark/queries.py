"""A query for each operator over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import driver_data as D
from .functions import text as TX
from .functions import variant as V
from .operators import annotation, batches, compounds, filters, models, scores, sorting, summaries
from .operators.models import Family
from .plans import commands
from .plans.rules import ScoreFunction, parse_rank_model
from .sources import files
from .sources.header import FIXED, parse_header

RULES = """
[Version]
  version = 1.0
  name = driver model
[Categories]
  [[frequency]]
    category_aggregation = min
  [[harm]]
    category_aggregation = max
  [[call]]
    category_aggregation = sum
[AF]
  field = INFO
  data_type = float
  category = frequency
  record_rule = max
  separators = ',',
  info_key = 1000GAF
  [[not_reported]]
    score = 3
  [[rare]]
    score = 2
    lower = 0
    upper = 0.03
  [[intermediate]]
    score = 1
    lower = 0.03
    upper = 0.06
  [[common]]
    score = -12
    lower = 0.06
    upper = 1.0
[CADD]
  field = INFO
  data_type = integer
  category = harm
  record_rule = max
  separators = ',',
  info_key = CADD
  [[not_reported]]
    score = 0
  [[low]]
    score = 1
    lower = 0
    upper = 20
  [[high]]
    score = 4
    lower = 20
    upper = 100
[MQ]
  field = INFO
  data_type = integer
  category = harm
  record_rule = min
  separators = ',',
  info_key = MQ
  [[not_reported]]
    score = -1
  [[seven]]
    score = 2
    value = 7
  [[sixty]]
    score = 3
    value = 60
[DB]
  field = INFO
  data_type = flag
  category = call
  info_key = DB
  [[not_reported]]
    score = 1
  [[known]]
    score = -1
    value = yes
[Filter]
  field = FILTER
  data_type = string
  category = call
  record_rule = max
  separators = ';',
  [[not_reported]]
    score = 0
  [[pass]]
    score = 3
    priority = 2
    string = PASS
  [[low]]
    score = -2
    priority = 1
    string = LOWQ
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Register a query, and its SQL after the views of variants."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {D.SQL_VARIANTS} {sql}"
        return f

    return register


def _called(spark: SparkSession, sf_dir: str, family: Family) -> tuple[DataFrame, dict]:
    rows = commands.with_calls(D.variants(spark, sf_dir), D.SAMPLES, [m.name for m in family])
    return rows, {m.name: F.col("calls")[m.name] for m in family}


# -- records


@query("info_parse", "SELECT idx, CAST(q % 61 AS VARCHAR) AS mq, p % 3 = 0 AS db, CASE WHEN len(features) > 0 THEN array_to_string(features, ',') END AS genes, CAST(3 + (p % 3 = 0)::INT + (len(features) > 0)::INT + (s % 4 <> 0)::INT - 1 AS BIGINT) AS n FROM v")
def info_parse(spark, sf_dir):
    m = V.info_map(F.col("info"))
    return D.variants(spark, sf_dir).select("idx", m["MQ"].alias("mq"), V.has_info(F.col("info"), "DB").alias("db"), m["Annotation"].alias("genes"), F.size(F.map_keys(m)).cast("long").alias("n"))


@query("info_edit", "SELECT idx, 'MQ=0' AS first, (q % 61)::VARCHAR AS added FROM v")
def info_edit(spark, sf_dir):
    info = V.replace_info(F.col("info"), "MQ", F.lit("0"))
    info = V.append_info(V.append_info(info, "FLAG"), "OLD", V.info_value(F.col("info"), "MQ"))
    rows = D.variants(spark, sf_dir).select("idx", info.alias("info"))
    return rows.select("idx", F.split("info", ";")[0].alias("first"), V.info_value(F.col("info"), "OLD").alias("added"))


@query("variant_id", "SELECT idx, chrom || '_' || pos || '_' || ref || '_' || alt AS variant_id, chrom || '_' || pos || '_N_DEL_END' || (pos + 5) AS deletion FROM v")
def variant_id(spark, sf_dir):
    c, pos = F.col("chrom"), F.col("pos")
    end = F.concat(F.lit("SVTYPE=DEL;END="), (pos + 5).cast("string"), F.lit(";SVLEN=9"))
    return D.variants(spark, sf_dir).select("idx", V.variant_id(c, pos, F.col("ref"), F.col("alt"), F.col("info")).alias("variant_id"), V.variant_id(c, pos, F.lit("N"), F.lit("<DEL>"), end).alias("deletion"))


@query(
    "genotype_classify",
    " UNION ALL ".join(f"SELECT idx, '{n}' AS sample, {n}_gt AS gt, {n}_called AS genotyped, {n}_het AS het, {n}_alt AS homo_alt, {n}_ref AS homo_ref, {n}_has AS has_variant, {n}_gt = '0|1' AS phased, {n}_ad0 + {n}_ad1 AS reads, CAST({n}_gq AS DOUBLE) AS gq FROM v" for n in D.SAMPLES),
)
def genotype_classify(spark, sf_dir):
    g = summaries.genotypes(D.variants(spark, sf_dir), D.SAMPLES)
    return g.select("idx", "sample", *[F.col(f"call.{c}").alias(c) for c in ("gt", "genotyped", "het", "homo_alt", "homo_ref", "has_variant", "phased")], F.col("call.quality_depth").alias("reads"), F.col("call.gq").alias("gq"))


@query("features", "SELECT idx, array_to_string(features, '|') AS features, len(features) AS n FROM v")
def features(spark, sf_dir):
    return D.variants(spark, sf_dir).select("idx", F.array_join(V.features(F.col("info")), "|").alias("features"), F.size(V.features(F.col("info"))).cast("long").alias("n"))


@query("gene_consequences", "SELECT idx, CASE WHEN p % 3 = 0 THEN 'A' || (p % 11) WHEN p % 3 = 1 THEN 'B' || (s % 5) ELSE '' END AS genes FROM v")
def gene_consequences(spark, sf_dir):
    p, s = F.regexp_extract("info", "CADD=([0-9]+)", 1), F.lit("")
    n = D.numbers(spark, sf_dir)
    p, s = F.col("p"), F.col("s")
    one = F.concat(F.lit("A|"), F.when(p % 3 == 0, "stop_gained&intron_variant").otherwise("intergenic_variant"), F.lit("|A"), (p % 11).cast("string"))
    two = F.concat(F.lit("C|"), F.when(p % 3 == 1, "missense_variant").otherwise("regulatory"), F.lit("|B"), (s % 5).cast("string"))
    rows = n.select((F.col("c") * (1 << 40) + F.col("pos")).alias("idx"), F.concat(F.lit("CSQ="), one, F.lit(","), two).alias("info"))
    return rows.select("idx", F.array_join(V.gene_features(F.col("info"), ["Allele", "Consequence", "Gene"]), ",").alias("genes"))


# -- models


def _sql_parents(new: str, gone: str) -> tuple[str, str]:
    return new, gone


_HEALTHY = "NOT mother_has AND NOT father_has"
_TRIO_SQL = {
    "AD": ("NOT on_x AND NOT mother_has AND NOT father_has AND (NOT proband_called OR proband_het)", "NOT (mother_has OR father_has)", "NOT (mother_has OR father_has) AND mother_called AND father_called"),
    "AR_hom": ("NOT on_x AND NOT mother_alt AND NOT father_alt AND (NOT proband_called OR proband_alt)", "NOT (mother_has AND father_has)", "NOT (mother_has AND father_has) AND mother_called AND father_called"),
    "XR": ("on_x AND (NOT mother_called OR NOT mother_alt) AND (NOT father_called OR (NOT father_alt AND NOT father_has)) AND (NOT proband_called OR NOT proband_ref)", "NOT mother_has", "NOT mother_has AND mother_called"),
    "XD": ("on_x AND (NOT mother_called OR NOT mother_alt) AND (NOT father_called OR NOT father_has) AND (NOT proband_called OR NOT proband_ref)", "NOT mother_has", "NOT mother_has AND mother_called"),
}


def _sql_models(rules: dict[str, tuple[str, str, str]]) -> str:
    columns = ", ".join(f"{base} AND NOT ({gone}) AS {m}, {base} AND ({new}) AS {m}_dn" for m, (base, new, gone) in rules.items())
    return f"SELECT idx, {columns} FROM (SELECT *, chrom = 'X' AS on_x FROM v)"


def _models(family: Family, names: tuple[str, ...], strict: bool = False):
    def run(spark, sf_dir):
        rows, calls = _called(spark, sf_dir, family)
        flags = models.single_variant_models(F.col("chrom"), family, calls, strict)
        return rows.select("idx", *[flags[n].alias(n) for m in names for n in (m, f"{m}_dn")])

    return run


for _name, _model in (("model_dominant", "AD"), ("model_recessive", "AR_hom"), ("model_x_recessive", "XR"), ("model_x_dominant", "XD")):
    query(_name, _sql_models({_model: _TRIO_SQL[_model]}))(_models(D.TRIO, (_model,)))

_CALLED = "proband_called AND mother_called AND father_called"
query("models_strict", _sql_models({m: (f"{_CALLED} AND {b}", n, g) for m, (b, n, g) in _TRIO_SQL.items()}))(_models(D.TRIO, tuple(_TRIO_SQL), strict=True))

_GIRL_SQL = {
    "XR": ("on_x AND (NOT mother_called OR NOT mother_alt) AND (NOT father_called OR NOT father_has) AND (NOT brother_called OR NOT brother_has) AND (NOT proband_called OR proband_alt)", "NOT (mother_has AND father_has) OR NOT mother_has", "(NOT (mother_has AND father_has) AND mother_called AND father_called) OR (NOT mother_has AND mother_called)"),
    "XD": ("on_x AND (NOT mother_called OR NOT mother_alt) AND (NOT father_called OR NOT father_has) AND (NOT brother_called OR NOT brother_has) AND (NOT proband_called OR NOT proband_ref)", "NOT (mother_has OR father_has) OR NOT mother_has", "(NOT (mother_has OR father_has) AND mother_called AND father_called) OR (NOT mother_has AND mother_called)"),
}
query("models_female_sibling", _sql_models(_GIRL_SQL))(_models(D.GIRL, ("XR", "XD")))

_DUO_SQL = {
    "AD": ("NOT on_x AND NOT mother_has AND (NOT proband_called OR proband_het)", "NOT mother_has", "NOT mother_has"),
    "AR_hom": ("NOT on_x AND NOT mother_alt AND (NOT proband_called OR proband_alt)", "true", "false"),
    "XR": ("on_x AND (NOT mother_called OR NOT mother_alt) AND (NOT proband_called OR NOT proband_ref)", "NOT mother_has", "NOT mother_has AND mother_called"),
}
query("models_one_parent", _sql_models(_DUO_SQL))(_models(D.DUO, tuple(_DUO_SQL)))


@query("model_reduced_penetrance", "SELECT idx, chrom <> 'X' AND (CASE WHEN list_has_any(features, ['G1', 'G7', 'G30']) THEN NOT mother_alt AND NOT father_alt ELSE NOT mother_has AND NOT father_has END) AND (NOT proband_called OR proband_het) AS dominant FROM v")
def model_reduced_penetrance(spark, sf_dir):
    rows, calls = _called(spark, sf_dir, D.TRIO)
    reduced = F.arrays_overlap(V.features(F.col("info")), F.array(*[F.lit(g) for g in ("G1", "G7", "G30")]))
    return rows.select("idx", ((F.col("chrom") != "X") & models.dominant(D.TRIO, calls, reduced_penetrance=reduced)).alias("dominant"))


@query("model_score", "SELECT idx, CAST(CASE WHEN n = 0 THEN 0 ELSE round_even(-10 * log10(1 - r), 0) END AS BIGINT) AS model_score FROM (SELECT idx, (proband_gq > 0)::INT + (mother_gq > 0)::INT + (father_gq > 0)::INT AS n, (CASE WHEN proband_gq > 0 THEN 1 - pow(10.0::DOUBLE, -(proband_gq / 10.0::DOUBLE)) ELSE 1.0::DOUBLE END) * (CASE WHEN mother_gq > 0 THEN 1 - pow(10.0::DOUBLE, -(mother_gq / 10.0::DOUBLE)) ELSE 1.0::DOUBLE END) * (CASE WHEN father_gq > 0 THEN 1 - pow(10.0::DOUBLE, -(father_gq / 10.0::DOUBLE)) ELSE 1.0::DOUBLE END) AS r FROM v)")
def model_score(spark, sf_dir):
    rows, calls = _called(spark, sf_dir, D.TRIO)
    return rows.select("idx", models.model_score(calls.values()).alias("model_score"))


@query("model_text", f"SELECT idx, concat_ws('|', {', '.join(f'CASE WHEN {m} THEN {chr(39)}{m}{chr(39)} END' for m in models.MODELS[:8])}) AS models FROM ({_sql_models({m: _TRIO_SQL[m] for m in ('XR', 'XD', 'AD', 'AR_hom')})})")
def model_text(spark, sf_dir):
    rows, calls = _called(spark, sf_dir, D.TRIO)
    return rows.select("idx", models.render_models(models.single_variant_models(F.col("chrom"), D.TRIO, calls)).alias("models"))


# -- batches and compounds

#: The fixpoint of the batches as a chain of views; the genes of these records nest so little that five rounds are more than enough.
_ROUNDS = 5


def _sql_batches() -> str:
    views = [", b0 AS (SELECT idx, c, features, CASE WHEN lag(idx) OVER (PARTITION BY c ORDER BY idx) IS NULL OR len(features) = 0 THEN 1 ELSE 0 END AS brk FROM v)"]
    for k in range(_ROUNDS):
        views.append(f"""
s{k} AS (SELECT *, sum(brk) OVER (PARTITION BY c ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seg FROM b{k}),
l{k} AS (SELECT idx, bool_or(again) AS again FROM (SELECT idx, lag(idx) OVER (PARTITION BY c, seg, f ORDER BY idx) IS NOT NULL AS again FROM (SELECT idx, c, seg, unnest(features) AS f FROM s{k})) GROUP BY idx),
b{k + 1} AS (SELECT s{k}.idx, c, features, CASE WHEN brk = 1 OR NOT coalesce(again, true) THEN 1 ELSE 0 END AS brk FROM s{k} LEFT JOIN l{k} USING (idx))""")
    return ",".join(views) + f", bt AS (SELECT idx, CAST(sum(brk) OVER (PARTITION BY c ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS batch FROM b{_ROUNDS})"


def _batched(spark, sf_dir, family, scored=lambda rows: rows):
    """scored: what else each row gets before the joins and windows of batches, so that it is computed where the rows are read."""
    rows = D.variants(spark, sf_dir).withColumn("features", V.features(F.col("info")))
    rows = rows.withColumn("variant_id", V.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    return batches.batched_once(commands.with_calls(scored(rows), D.SAMPLES, [m.name for m in family]))


@query("batches", f"{_sql_batches()} SELECT idx, batch FROM bt")
def batch_rows(spark, sf_dir):
    rows = D.variants(spark, sf_dir).withColumn("features", V.features(F.col("info")))
    return batches.batches(rows).select("idx", F.col("batch").cast("long").alias("batch"))


_CANDIDATE = "NOT proband_alt AND NOT mother_alt AND NOT father_alt AND proband_het AND NOT (mother_has AND father_has)"


@query("compound_candidates", f"SELECT idx FROM v WHERE {_CANDIDATE}")
def compound_candidates(spark, sf_dir):
    rows, calls = _called(spark, sf_dir, D.TRIO)
    return rows.filter(models.compound_candidate(D.TRIO, calls)).select("idx")


def _sql_pairs(candidate: str, fits: str, comp: str, new: str) -> str:
    return f"""{_sql_batches()},
cand AS (SELECT v.*, batch FROM v JOIN bt USING (idx) WHERE {candidate}),
pairs AS (
  SELECT a.idx AS idx_1, b.idx AS idx_2, {comp} AS comp, {new} AS comp_dn
  FROM cand a JOIN cand b ON a.c = b.c AND a.batch = b.batch AND a.idx < b.idx AND list_has_any(a.features, b.features)
  WHERE {fits})"""


_TRIO_PAIRS = _sql_pairs(
    _CANDIDATE, "NOT (a.mother_has AND b.mother_has) AND NOT (a.father_has AND b.father_has) AND NOT (a.mother_het AND b.mother_het) AND NOT (a.father_het AND b.father_het)",
    "a.mother_called AND b.mother_called AND a.father_called AND b.father_called AND (a.mother_has OR b.mother_has) AND (a.father_has OR b.father_has)",
    "a.mother_called AND b.mother_called AND a.father_called AND b.father_called AND NOT ((a.mother_has OR b.mother_has) AND (a.father_has OR b.father_has))",
)


@query("compound_pairs", f"{_TRIO_PAIRS} SELECT * FROM pairs")
def compound_pairs(spark, sf_dir):
    return compounds.pairs(_batched(spark, sf_dir, D.TRIO), D.TRIO).select("idx_1", "idx_2", "comp", "comp_dn")


_PARTNERS = """,
sides AS (SELECT idx_1 AS idx, idx_2 AS partner, idx_1, idx_2, comp, comp_dn FROM pairs UNION ALL SELECT idx_2, idx_1, idx_1, idx_2, comp, comp_dn FROM pairs),
kept AS (SELECT *, bool_or(comp OR comp_dn) OVER (PARTITION BY idx ORDER BY idx_1, idx_2 ROWS UNBOUNDED PRECEDING) AS keep FROM sides),
named AS (SELECT k.*, v.chrom || '_' || v.pos || '_' || v.ref || '_' || v.alt AS name FROM kept k JOIN v ON v.idx = k.partner)
SELECT idx, bool_or(comp) AS AR_comp, bool_or(comp_dn) AS AR_comp_dn, coalesce(string_agg(name, '|' ORDER BY name) FILTER (keep), '') AS compounds FROM named GROUP BY idx"""


@query("compound_partners", _TRIO_PAIRS + _PARTNERS)
def compound_partners(spark, sf_dir):
    found = compounds.partners(compounds.pairs(_batched(spark, sf_dir, D.TRIO), D.TRIO))
    return found.select("idx", "AR_comp", "AR_comp_dn", F.array_join("compounds", "|").alias("compounds"))


@query("compound_partners_alone", _sql_pairs("NOT proband_alt AND proband_het", "true", "true", "false") + _PARTNERS)
def compound_partners_alone(spark, sf_dir):
    found = compounds.partners(compounds.pairs(_batched(spark, sf_dir, D.ALONE), D.ALONE))
    return found.select("idx", "AR_comp", "AR_comp_dn", F.array_join("compounds", "|").alias("compounds"))


# -- regions and lookups


def _keyed(spark, sf_dir):
    return D.variants(spark, sf_dir).withColumn("chrom_key", TX.annotation_chrom(F.col("chrom"))).select("idx", "chrom_key", "pos", "alt")


@query("region_overlap", f", {D.SQL_REGIONS} SELECT idx, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS annotation FROM v JOIN r ON v.chrom = r.chrom AND start <= pos AND pos < stop GROUP BY idx")
def region_overlap(spark, sf_dir):
    return annotation.overlapping_regions(_keyed(spark, sf_dir), D.regions(spark, sf_dir), 256)


_KEY = "(CASE WHEN v.chrom = 'MT' THEN 'M' ELSE v.chrom END)"


@query("frequency_lookup", f", {D.SQL_FREQUENCIES} SELECT idx, arg_max(f.af, ord) AS af, arg_max(f.max_af, ord) AS max_af FROM v JOIN f ON f.chrom = {_KEY} AND f.alt = v.alt AND f.pos <= v.pos AND v.pos <= stop_at GROUP BY idx")
def frequency_lookup(spark, sf_dir):
    return annotation.frequencies(_keyed(spark, sf_dir), D.frequency_records(spark, sf_dir), 256)


@query("score_first_source", f", {D.SQL_SCORES} SELECT idx, arg_min(phred, source) AS phred, arg_min(raw, source) AS raw FROM v JOIN c3 ON c3.chrom = {_KEY} AND c3.alt = v.alt AND c3.pos = v.pos GROUP BY idx")
def score_first_source(spark, sf_dir):
    return annotation.score_lookup(_keyed(spark, sf_dir), D.score_rows(spark, sf_dir), ["phred", "raw"])


@query("splice_score", f", {D.SQL_SCORES} SELECT idx, CAST(raw AS DOUBLE) % 7 AS score FROM v JOIN c3 ON c3.chrom = {_KEY} AND c3.alt = v.alt AND c3.pos = v.pos WHERE source = 1 AND CAST(raw AS DOUBLE) % 7 <> 0")
def splice_score(spark, sf_dir):
    rows = D.score_rows(spark, sf_dir).filter("source = 1").withColumn("score", F.col("raw").cast("double") % 7)
    return annotation.splice_scores(_keyed(spark, sf_dir), rows)


@query("known_sites", f", {D.SQL_SCORES} SELECT idx FROM v WHERE EXISTS (SELECT 1 FROM c3 WHERE c3.chrom = {_KEY} AND c3.alt = v.alt AND c3.pos = v.pos)")
def known_sites(spark, sf_dir):
    return annotation.known_sites(_keyed(spark, sf_dir), D.score_rows(spark, sf_dir))


@query("annotate", f", {D.SQL_REGIONS}, g AS (SELECT idx, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS a FROM v JOIN r ON v.chrom = r.chrom AND start <= pos AND pos < stop GROUP BY idx), {D.SQL_SCORES}, h AS (SELECT idx, arg_min(phred, source) AS phred, arg_min(raw, source) AS raw FROM v JOIN c3 ON c3.chrom = {_KEY} AND c3.alt = v.alt AND c3.pos = v.pos GROUP BY idx) SELECT v.idx, concat_ws(';', '.X', 'Annotation=' || a, 'CADD=' || phred, 'CADD_raw=' || raw) AS info FROM v LEFT JOIN g USING (idx) LEFT JOIN h USING (idx)")
def annotate(spark, sf_dir):
    rows = D.variants(spark, sf_dir).withColumn("info", F.lit(".X"))
    out = commands.annotate(rows, regions=D.regions(spark, sf_dir), deleteriousness=D.score_rows(spark, sf_dir))
    return out.select("idx", "info")


# -- scores

_AF_SCORE = "(CASE WHEN af IS NULL OR af = 0 THEN 3 WHEN af < 0.03 THEN 2 WHEN af < 0.06 THEN 1 ELSE -12 END)"
_CADD_SCORE = "(CASE WHEN greatest(q % 40, 1) < 20 THEN 1 ELSE 4 END)"
_MQ_SCORE = "(CASE WHEN q % 61 = 0 THEN -1 WHEN q % 61 = 7 THEN 2 WHEN q % 61 = 60 THEN 3 ELSE 0 END)"
_DB_SCORE = "(CASE WHEN p % 3 = 0 THEN -1 ELSE 1 END)"
_FILTER_SCORE = "(CASE WHEN filter = 'PASS' THEN 3 ELSE -2 END)"


def _plugin_query(plugin: str):
    return lambda spark, sf_dir: D.variants(spark, sf_dir).select("idx", parse_rank_model(RULES).plugin_score(plugin).alias("score"))


for _name, _plugin, _sql in (("score_intervals", "AF", _AF_SCORE), ("score_intervals_integer", "CADD", _CADD_SCORE), ("score_values", "MQ", _MQ_SCORE), ("score_flag", "DB", _DB_SCORE), ("score_strings", "Filter", _FILTER_SCORE)):
    query(_name, f"SELECT idx, CAST({_sql} AS BIGINT) AS score FROM v")(_plugin_query(_plugin))


@query("score_equal", "SELECT idx, CAST(q % 61 AS BIGINT) AS score FROM v")
def score_equal(spark, sf_dir):
    return D.variants(spark, sf_dir).select("idx", ScoreFunction("integer", equal=True).column(V.info_value(F.col("info"), "MQ").cast("long")).alias("score"))


_RANK = f"({_AF_SCORE} + greatest({_CADD_SCORE}, {_MQ_SCORE}) + {_DB_SCORE} + {_FILTER_SCORE})"
_LOW, _HIGH = parse_rank_model(RULES).bounds()


@query("score_categories", f"SELECT idx, CAST({_AF_SCORE} AS DOUBLE) AS frequency, CAST(greatest({_CADD_SCORE}, {_MQ_SCORE}) AS DOUBLE) AS harm, CAST({_DB_SCORE} + {_FILTER_SCORE} AS DOUBLE) AS call FROM v")
def score_categories(spark, sf_dir):
    return scores.score_variants(D.variants(spark, sf_dir), parse_rank_model(RULES)).select("idx", "frequency", "harm", "call")


@query("rank_score", f"SELECT idx, CAST({_RANK} AS DOUBLE) AS rank_score, round(({_RANK} - {_LOW}) / ({_HIGH} - {_LOW}), 6) AS normalized FROM v")
def rank_score(spark, sf_dir):
    out = scores.score_variants(D.variants(spark, sf_dir), parse_rank_model(RULES))
    return out.select("idx", "rank_score", F.round("rank_score_normalized", 6).alias("normalized"))


@query("rank_score_text", f"SELECT idx, '1:' || ({_RANK})::INT || '.0' AS score, '1:{_LOW}:{_HIGH}' AS bounds FROM v")
def rank_score_text(spark, sf_dir):
    model = parse_rank_model(RULES)
    out = commands.score(D.variants(spark, sf_dir), model)
    return out.select("idx", V.info_value(F.col("info"), "RankScore").alias("score"), V.info_value(F.col("info"), "RankScoreMinMax").alias("bounds"))


_RESCORE = _sql_pairs("NOT proband_alt AND proband_het", "true", "true", "false") + f""",
ties AS (SELECT idx_1 AS idx, idx_2 AS partner FROM pairs UNION ALL SELECT idx_2, idx_1 FROM pairs),
ranks AS (SELECT idx, CAST({_RANK} AS DOUBLE) AS score, chrom || '_' || pos || '_' || ref || '_' || alt AS name, p FROM v),
low AS (SELECT b.idx, NOT bool_or(r.score > 9) AS low_only FROM ties b JOIN ranks r ON r.idx = b.partner GROUP BY b.idx),
new AS (SELECT r.idx, CASE WHEN r.p % 2 = 0 AND low_only THEN greatest(score - 6, {_LOW}) ELSE score END AS score FROM ranks r JOIN low USING (idx))
SELECT n.idx, n.score AS rank_score, count(*) AS partners, round(sum(n.score + r.score), 3) AS total FROM new n JOIN ties b ON b.idx = n.idx JOIN ranks r ON r.idx = b.partner GROUP BY n.idx, n.score"""


def _rescored(spark, sf_dir):
    """Variants with an even part follow only the compound model, the others the dominant one too."""
    model = parse_rank_model(RULES)
    batched = _batched(spark, sf_dir, D.ALONE, lambda rows: scores.write_scores(scores.score_variants(rows, model), model))
    found = compounds.partners(compounds.pairs(batched, D.ALONE)).select("idx", F.array_join("compounds", "|").alias("listed"))
    parts = D.numbers(spark, sf_dir).select((F.col("c") * (1 << 40) + F.col("pos")).alias("idx"), (F.col("p") % 2 == 0).alias("even"))
    rows = batched.join(found, "idx", "left").join(parts, "idx")
    info = V.append_entries(F.col("info"), F.concat(F.lit("Compounds=1:"), "listed"), F.when(F.col("even"), "GeneticModels=1:AR_comp").otherwise("GeneticModels=1:AD|AR_comp"))
    return scores.compound_scores(rows.withColumn("info", info))


@query("compound_rescore", _RESCORE)
def compound_rescore(spark, sf_dir):
    out = _rescored(spark, sf_dir)
    listed = F.split(F.element_at(F.split("compounds", ":"), -1), r"\|")
    sums = F.transform(listed, lambda x: F.element_at(F.split(x, ">"), -1).cast("double"))
    total = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
    return out.select("idx", F.element_at(F.split("rank_score", ":"), -1).cast("double").alias("rank_score"), F.size(listed).cast("long").alias("partners"), F.round(total, 3).alias("total"))


# -- filters

_FILTER_SQL = "SELECT idx FROM v WHERE CASE WHEN af IS NULL OR af = 0 THEN {} ELSE af {} 0.05 END"
for _name, _sql, _options in (
    ("filter_below", _FILTER_SQL.format("true", "<"), {}),
    ("filter_above", _FILTER_SQL.format("true", ">"), {"greater": True}),
    ("filter_discard", _FILTER_SQL.format("false", "<"), {"discard": True}),
):
    query(_name, _sql)(lambda spark, sf_dir, options=_options: filters.filter_variants(D.variants(spark, sf_dir), **options).select("idx"))


@query("covered_in_all", "SELECT idx, proband_ad0 + proband_ad1 >= 10 AND mother_ad0 + mother_ad1 >= 10 AND father_ad0 + father_ad1 >= 10 AND brother_ad0 + brother_ad1 >= 10 AS covered FROM v")
def covered_in_all(spark, sf_dir):
    calls = F.array(*[V.sample_genotype(F.col("format"), F.get("samples", F.lit(i))) for i in range(len(D.SAMPLES))])
    return D.variants(spark, sf_dir).select("idx", filters.covered_in_all(calls, 10).alias("covered"))


@query("interesting", "SELECT idx, unnest(CASE WHEN p % 2 = 0 THEN ['dominant'] ELSE ['dominant', 'compound'] END) AS bucket FROM v WHERE filter = 'PASS' AND qual > 20 AND q % 40 > 15 AND coalesce(af, 0) < 0.05 AND NOT list_has_any(features, ['G3', 'G4'])")
def interesting(spark, sf_dir):
    rows = D.variants(spark, sf_dir)
    even = D.numbers(spark, sf_dir).select((F.col("c") * (1 << 40) + F.col("pos")).alias("idx"), (F.col("p") % 2 == 0).alias("even"))
    m = F.when(F.col("even"), F.array(F.lit("AD"))).otherwise(F.array(F.lit("AD"), F.lit("AR_comp")))
    rows = rows.join(even, "idx").select("idx", m.alias("models"), "filter", F.col("qual").cast("double").alias("qual"), F.split(V.info_value(F.col("info"), "CADD"), ",")[0].cast("double").alias("score"), filters.least_value(F.col("info"), "1000GAF").alias("frequency"), V.features(F.col("info")).alias("features"))
    return filters.interesting(rows, least_quality=20, excluded_genes=("G3", "G4")).select("idx", "bucket")


# -- orders


@query("chromosome_priority", "SELECT idx, CASE chrom WHEN 'X' THEN '23' WHEN 'Y' THEN '24' WHEN 'MT' THEN '25' ELSE chrom END AS priority FROM v")
def chromosome_priority(spark, sf_dir):
    return D.variants(spark, sf_dir).select("idx", TX.chromosome_priority(F.concat(F.lit("chr"), "chrom")).alias("priority"))


@query("rank_extraction", f"SELECT idx, CAST({_RANK} AS DOUBLE) AS last, CASE WHEN p % 2 = 0 THEN 5.5 ELSE -100.0 END::DOUBLE AS second FROM v")
def rank_extraction(spark, sf_dir):
    model = parse_rank_model(RULES)
    rows = scores.score_variants(D.variants(spark, sf_dir), model).join(D.numbers(spark, sf_dir).select((F.col("c") * (1 << 40) + F.col("pos")).alias("idx"), "p"), "idx")
    info = V.append_info(F.lit("."), "RankScore", F.concat(F.when(F.col("p") % 2 == 0, "2:5.5,").otherwise(""), F.lit("1:"), TX.float_text(F.col("rank_score"))))
    return rows.select("idx", V.family_score(info).alias("last"), V.family_score(info, "2").alias("second"))


@query("top_ranks", f"SELECT idx, CAST({_RANK} AS DOUBLE) AS rank_score FROM v ORDER BY rank_score DESC, idx LIMIT 20")
def top_ranks(spark, sf_dir):
    out = scores.score_variants(D.variants(spark, sf_dir), parse_rank_model(RULES))
    return sorting.top(out, "rank_score").select("idx", "rank_score")


@query("sort_by_place", "SELECT idx FROM v ORDER BY CASE c WHEN 0 THEN 23 WHEN 23 THEN 24 WHEN 24 THEN 25 ELSE c END, pos, idx")
def sort_by_place(spark, sf_dir):
    return sorting.by_place(D.variants(spark, sf_dir)).select("idx")


@query("sort_by_rank", "SELECT idx FROM v")
def sort_by_rank(spark, sf_dir):
    return sorting.by_rank(commands.score(D.variants(spark, sf_dir), parse_rank_model(RULES))).select("idx")


@query("sort_by_name", "SELECT idx FROM v")
def sort_by_name(spark, sf_dir):
    return sorting.by_name(D.variants(spark, sf_dir)).select("idx")


@query("float_text", "SELECT idx, CASE WHEN d = 0 THEN '0.0' WHEN d = 10 THEN '0.1' ELSE '0.0' || d END AS small, q || '.5' AS half, (p * 1000000) || '.0' AS large FROM v")
def float_text(spark, sf_dir):
    n = D.numbers(spark, sf_dir)
    t = TX.float_text
    return n.select((F.col("c") * (1 << 40) + F.col("pos")).alias("idx"), t(F.col("d") / 100).alias("small"), t(F.col("q") + 0.5).alias("half"), t((F.col("p") * 1000000).cast("double")).alias("large"))


# -- counts


@query("sample_counts", " UNION ALL ".join(f"SELECT '{n}' AS sample, count(*) FILTER ({n}_has) AS variants, count(*) FILTER ({n}_called) AS called, CAST(sum({n}_ad0 + {n}_ad1) AS BIGINT) AS reads FROM v" for n in D.SAMPLES))
def sample_counts(spark, sf_dir):
    return summaries.sample_counts(D.variants(spark, sf_dir), D.SAMPLES)


@query("model_counts", f"SELECT model, count(*) AS variants FROM (SELECT unnest(string_split(models, '|')) AS model FROM (SELECT concat_ws('|', {', '.join(f'CASE WHEN {m} THEN {chr(39)}{m}{chr(39)} END' for m in models.MODELS[:8])}) AS models FROM ({_sql_models({m: _TRIO_SQL[m] for m in ('XR', 'XD', 'AD', 'AR_hom')})})) WHERE models <> '') GROUP BY model")
def model_counts(spark, sf_dir):
    rows, calls = _called(spark, sf_dir, D.TRIO)
    text = models.render_models(models.single_variant_models(F.col("chrom"), D.TRIO, calls))
    rows = rows.withColumn("info", F.when(text != "", F.concat(F.lit("GeneticModels=1:"), text)).otherwise("."))
    return summaries.model_counts(rows)


@query("families_present", "SELECT unnest(['1', '2']) AS family")
def families_present(spark, sf_dir):
    rows = D.variants(spark, sf_dir).withColumn("info", F.lit("GeneticModels=1:AD|AR_hom,2:AD"))
    return summaries.families_present(rows)


@query("filter_counts", "SELECT count(*) AS total, count(*) FILTER (CASE WHEN af IS NULL OR af = 0 THEN true ELSE af < 0.05 END) AS passed FROM v")
def filter_counts(spark, sf_dir):
    kept = filters.passes(filters.least_value(F.col("info"), "1000GAF"), 0.05)
    return D.variants(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(kept, 1)).alias("passed"))


# -- places in an order, lines of files, and other rows that hold what the operators above are fed with

_PLACE = "CASE c WHEN 0 THEN 23 WHEN 23 THEN 24 WHEN 24 THEN 25 ELSE c END"


@query("order_by_place", f"SELECT idx, row_number() OVER (ORDER BY {_PLACE}, pos, idx) AS position FROM v")
def order_by_place(spark, sf_dir):
    return sorting.numbered(sorting.by_place(D.variants(spark, sf_dir)).select("idx"))


@query("order_by_name", "SELECT idx, row_number() OVER (ORDER BY CASE c WHEN 24 THEN 23 WHEN 0 THEN 24 WHEN 23 THEN 25 ELSE c END, pos, idx) AS position FROM v")
def order_by_name(spark, sf_dir):
    return sorting.numbered(sorting.by_name(D.variants(spark, sf_dir)).select("idx"))


@query("order_by_rank", f"SELECT idx, row_number() OVER (ORDER BY {_RANK} DESC, chrom || chr(9) || pos || chr(9) DESC) AS position FROM v")
def order_by_rank(spark, sf_dir):
    return sorting.numbered(sorting.by_rank(commands.score(D.variants(spark, sf_dir), parse_rank_model(RULES))).select("idx"))


@query("variant_lines", "SELECT idx, chrom, pos, ref, alt, CAST(qual AS VARCHAR) AS qual, filter, 'GT:AD:GQ' AS format, father_gt AS gt, CAST(4 AS BIGINT) AS n FROM v")
def variant_lines(spark, sf_dir):
    header = parse_header(["##fileformat=VCFv4.2", "#" + "\t".join((*FIXED, "FORMAT", *D.SAMPLES))])
    rows = D.variants(spark, sf_dir)
    read = files.parse_variants(rows.select("idx", TX.apart(sorting.line_text(rows), "string").alias("value")), header)
    return read.select("idx", "chrom", "pos", "ref", "alt", "qual", "filter", "format", F.split(F.col("samples")[header.samples.index("father")], ":")[0].alias("gt"), F.size("samples").cast("long").alias("n"))


@query("region_lines", "SELECT CAST(p_partkey % 22 + 1 AS VARCHAR) AS chrom, greatest(p_partkey * 3 - 4000, 0) AS start, p_partkey * 3 + p_size * 7 AS stop, p_brand AS symbol FROM part")
def region_lines(spark, sf_dir):
    r = D.regions(spark, sf_dir)
    return files.parse_regions(r.select(F.lit(0).alias("idx"), F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), "start", "stop", "symbol").alias("value")))


@query("frequency_lines", f", {D.SQL_FREQUENCIES} SELECT ord, chrom, pos, pos + k % 3 AS stop, ['A', 'C', 'G', 'T'][CAST(k % 4 + 1 AS INTEGER)] || ',' || ['A', 'C', 'G', 'T'][CAST((k + 1) % 4 + 1 AS INTEGER)] AS alts, '0.' || (k % 97) || ',0.' || (k % 89) AS af, '0.' || (k % 79) || ',0.' || (k % 73) AS max_af FROM f0")
def frequency_lines(spark, sf_dir):
    f = D.frequency_records(spark, sf_dir)
    info = F.concat_ws(";", F.concat(F.lit("AF="), F.array_join("af", ",")), F.concat(F.lit("MAX_AF="), F.array_join("max_af", ",")), F.concat(F.lit("END="), F.col("end").cast("string")))
    text = f.select(F.col("ord").alias("idx"), F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), F.lit("."), F.lit("N"), F.array_join("alts", ","), F.lit("."), F.lit("PASS"), info).alias("value"))
    read = files.parse_frequencies(files.parse_variants(text, parse_header(["#" + "\t".join(FIXED)])))
    return read.select("ord", "chrom", "pos", F.col("end").alias("stop"), *[F.array_join(c, ",").alias(c) for c in ("alts", "af", "max_af")])


@query("score_lines", f", {D.SQL_SCORES} SELECT ord, chrom, pos, alt, raw, phred FROM c3 WHERE source = 1")
def score_lines(spark, sf_dir):
    r = D.score_rows(spark, sf_dir).filter("source = 1")
    text = r.select(F.col("ord").alias("idx"), F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), F.lit("N"), "alt", "raw", "phred").alias("value"))
    return files.parse_scores(text, 1).select("ord", "chrom", "pos", "alt", "raw", "phred")


@query("pedigree_members", "SELECT CAST(n_regionkey AS VARCHAR) AS family, n_name AS name, CAST(n_nationkey % 3 AS BIGINT) AS sex, CAST(n_nationkey % 2 + 1 AS BIGINT) AS phenotype, n_nationkey % 2 = 1 AS affected FROM nation")
def pedigree_members(spark, sf_dir):
    """A pedigree is read on the driver, here one of the 25 nations."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    text = "#Phenotype\tSampleID\tFamilyID\tSex\tMother\tFather\tNote\n" + "".join(f"{r.n_nationkey % 2 + 1}\t{r.n_name}\t{r.n_regionkey}\t{r.n_nationkey % 3}\t0\t0\tx\n" for r in nations)
    return spark.createDataFrame([(f.name, m.name, m.sex, m.phenotype, m.affected) for f in files.parse_pedigree(text, "alt") for m in f], "family string, name string, sex long, phenotype long, affected boolean")


@query("repeated_ids", "SELECT first AS idx, c AS run, b AS batch, vid AS variant_id, q FROM (SELECT *, min(idx) OVER (PARTITION BY c, b, vid) AS first, row_number() OVER (PARTITION BY c, b, vid ORDER BY idx DESC) AS nth FROM (SELECT idx, c, pos // 200 AS b, 'v' || (pos % 50) AS vid, q FROM v)) WHERE nth = 1")
def repeated_ids(spark, sf_dir):
    n = D.numbers(spark, sf_dir)
    rows = n.select((F.col("c") * (1 << 40) + F.col("pos")).alias("idx"), F.col("c").alias("run"), F.floor(F.col("pos") / 200).alias("batch"), F.concat(F.lit("v"), (F.col("pos") % 50).cast("string")).alias("variant_id"), "q")
    return batches.last_of_each_id(rows)


@query("chromosome_names", "SELECT idx, CASE WHEN idx % 4 = 3 AND chrom = 'MT' THEN 'M' ELSE chrom END AS name FROM v")
def chromosome_names(spark, sf_dir):
    prefix = F.element_at(F.array(*map(F.lit, ("chr", "Chr", "CHR", ""))), (F.col("idx") % 4 + 1).cast("int"))
    return D.variants(spark, sf_dir).select("idx", TX.annotation_chrom(F.concat(prefix, "chrom")).alias("name"))


@query("phased_pairs", _sql_pairs(
    "NOT proband_alt AND NOT mother_alt AND proband_het",
    "NOT (a.mother_has AND b.mother_has) AND NOT (a.mother_het AND b.mother_het) AND NOT ((a.pos // 20) % 2 = (b.pos // 20) % 2 AND (a.proband_gt[1] = b.proband_gt[1] OR CASE WHEN length(a.proband_gt) < 3 THEN '.' ELSE a.proband_gt[3] END = CASE WHEN length(b.proband_gt) < 3 THEN '.' ELSE b.proband_gt[3] END))", "true", "true",
) + " SELECT * FROM pairs")
def phased_pairs(spark, sf_dir):
    """Two phase sets that change every 20 places."""
    phase = F.concat(F.lit(":"), (F.floor(F.col("pos") / 20) % 2).cast("string"))
    rows = D.variants(spark, sf_dir).withColumn("format", F.lit("GT:AD:GQ:PS")).withColumn("samples", F.transform("samples", lambda x: F.concat(x, phase)))
    rows = rows.withColumn("features", V.features(F.col("info"))).withColumn("variant_id", V.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    batched = batches.batched_once(commands.with_calls(rows, D.SAMPLES, [m.name for m in D.DUO]))
    return compounds.pairs(batched, D.DUO, phased=True).select("idx_1", "idx_2", "comp", "comp_dn")


_WIDTH = f"CAST({_HIGH - _LOW} AS DOUBLE)"


@query("compound_rescore_normalised", _RESCORE.split("SELECT n.idx")[0].rstrip() + f""",
norms AS (SELECT idx, name, p, (score - ({_LOW})) / {_WIDTH} AS norm FROM ranks),
quiet AS (SELECT b.idx, NOT bool_or(r.norm > (9 - ({_LOW})) / {_WIDTH}) AS low_only FROM ties b JOIN norms r ON r.idx = b.partner GROUP BY b.idx),
fresh AS (SELECT r.idx, CASE WHEN r.p % 2 = 0 AND low_only THEN greatest(norm - 6 / {_WIDTH}, 0) ELSE norm END AS norm FROM norms r JOIN quiet USING (idx))
SELECT n.idx, round(n.norm, 6) AS norm, string_agg(r.name, '|' ORDER BY r.name) AS ids, round(sum(n.norm + r.norm), 4) AS total FROM fresh n JOIN ties b ON b.idx = n.idx JOIN norms r ON r.idx = b.partner GROUP BY n.idx, n.norm""")
def compound_rescore_normalised(spark, sf_dir):
    listed = F.split(F.element_at(F.split("compounds_normalized", ":"), -1), r"\|")
    total = F.aggregate(F.transform(listed, lambda x: F.split(x, ">")[1].cast("double")), F.lit(0.0), lambda a, b: a + b)
    ids = F.array_join(F.array_sort(F.transform(listed, lambda x: F.split(x, ">")[0])), "|")
    return _rescored(spark, sf_dir).select("idx", F.round(F.element_at(F.split("rank_score_normalized", ":"), -1).cast("double"), 6).alias("norm"), ids.alias("ids"), F.round(total, 4).alias("total"))


@query("families_of_rows", "SELECT DISTINCT family FROM (SELECT 'F' || (p % 7) AS family FROM v UNION ALL SELECT 'G' || (s % 5) FROM v WHERE p % 3 = 0)")
def families_of_rows(spark, sf_dir):
    n = D.numbers(spark, sf_dir)
    second = F.when(F.col("p") % 3 == 0, F.concat(F.lit("G"), (F.col("s") % 5).cast("string"), F.lit(":XD")))
    rows = n.select(F.concat(F.lit("MQ=1;GeneticModels="), F.concat_ws(",", F.concat(F.lit("F"), (F.col("p") % 7).cast("string"), F.lit(":AD|AR_hom")), second)).alias("info"))
    return summaries.families_present(rows)


@query("filter_counters", "SELECT count(*) AS total, count(*) FILTER (CASE WHEN af IS NULL OR af = 0 THEN true ELSE af < 0.05 END) AS passed, count(*) FILTER (NOT CASE WHEN af IS NULL OR af = 0 THEN true ELSE af < 0.05 END) AS removed FROM v")
def filter_counters(spark, sf_dir):
    kept, seen = filters.with_counters(D.variants(spark, sf_dir), filters.passes(filters.least_value(F.col("info"), "1000GAF"), 0.05), f"counters-{uuid.uuid4().hex}")
    kept.write.format("noop").mode("overwrite").save()
    counts = seen.get
    return spark.createDataFrame([(counts["total"], counts["passed"], counts["removed"])], "total long, passed long, removed long")


@query("prune_partners", "SELECT idx, array_to_string(list_filter(features, lambda x: x = 'G' || (pos // 40 + s % 2)), '|') AS kept FROM v")
def prune_partners(spark, sf_dir):
    rows = D.variants(spark, sf_dir).join(D.numbers(spark, sf_dir).select((F.col("c") * (1 << 40) + F.col("pos")).alias("idx"), "s"), "idx")
    retained = F.array(F.concat(F.lit("G"), (F.floor(F.col("pos") / 40) + F.col("s") % 2).cast("string")))
    return rows.select("idx", F.array_join(filters.prune_partners(V.features(F.col("info")), retained), "|").alias("kept"))


@query("json_rows", "SELECT CAST(to_json({'idx': idx, 'chrom': chrom, 'pos': pos, 'filter': filter}) AS VARCHAR) AS value FROM v")
def json_rows(spark, sf_dir):
    return summaries.as_json(D.variants(spark, sf_dir).select("idx", "chrom", "pos", "filter"))


@query("score_fractions", "SELECT idx, CAST(CASE WHEN q % 100 = 0 THEN -1 WHEN q % 100 < 10 THEN 1 WHEN q % 100 < 30 THEN 2 WHEN q % 100 < 90 THEN 3 ELSE 0 END AS BIGINT) AS score FROM v")
def score_fractions(spark, sf_dir):
    rule = ScoreFunction("float", intervals=[(0, 10, 1.9), (10, 30, 2.9), (30, 90, 3.2)], not_reported=-1.7)
    return D.variants(spark, sf_dir).select("idx", rule.column(F.col("qual").cast("double")).alias("score"))


@query("numbers_in_text", "SELECT idx, p % 5 IN (0, 1, 4) AS number FROM v")
def numbers_in_text(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, (" 12 ", "1.5e3", "x7", "5d", "-.5"))), (F.col("p") % 5 + 1).cast("int"))
    return D.numbers(spark, sf_dir).select((F.col("c") * (1 << 40) + F.col("pos")).alias("idx"), TX.is_number(text).alias("number"))
