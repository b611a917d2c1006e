"""Variant records, regions and lookups as deterministic projections of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.models import Family, Individual

SAMPLES = ("proband", "mother", "father", "brother")
TRIO = Family("1", (Individual("proband", "father", "mother", 1, 2), Individual("mother", sex=2, phenotype=1), Individual("father", sex=1, phenotype=1)))
GIRL = Family("1", (Individual("proband", "father", "mother", 2, 2), Individual("mother", sex=2, phenotype=1), Individual("father", sex=1, phenotype=1), Individual("brother", "father", "mother", 1, 1)))
DUO = Family("2", (Individual("proband", "0", "mother", 1, 2), Individual("mother", sex=2, phenotype=1)))
ALONE = Family("3", (Individual("proband", sex=1, phenotype=2),))
GT = ("0/0", "0/1", "0/1", "1/1", "./.", "0/1", "1/1", "0|1", "0/0", "1")
BASES = ("A", "C", "G", "T")
GENE = 40

#: One row a place: sums and extremes of its line items, all whole numbers.
_NUMBERS = {
    "p": ("min", "l_partkey"), "s": ("max", "l_suppkey"), "q": ("sum", "l_quantity"), "d": ("max", "round(l_discount * 100)"), "e": ("max", "l_linenumber"),
}


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    aggregates = [getattr(F, how)(F.expr(of)).cast("long").alias(n) for n, (how, of) in _NUMBERS.items()]
    # Whether the least flag is R (1), as a number below, at or above it: texts are not aggregated by hash.
    flag = F.col("l_returnflag")
    flag = F.min(F.when(flag < "R", 0).when(flag == "R", 1).when(flag > "R", 2))
    rows = items.groupBy("l_orderkey", "l_linenumber").agg(*aggregates, flag.alias("flag"))
    c = F.col("l_orderkey") % 25
    return rows.select(c.alias("c"), (F.floor(F.col("l_orderkey") / 25) * 10 + F.col("l_linenumber")).alias("pos"), "p", "s", "q", "d", "flag")


SQL_NUMBERS = f"""
n AS (
  SELECT l_orderkey % 25 AS c, (l_orderkey // 25) * 10 + l_linenumber AS pos,
         {", ".join(f"CAST({how}({of}) AS BIGINT) AS {n}" for n, (how, of) in _NUMBERS.items() if n != "e")}, min(l_returnflag) AS flag
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, chrom, pos, id, ref, alt, qual, filter, info, format, samples: records as a reader of files gives them."""
    n = numbers(spark, sf_dir)
    p, s, d, q, pos, c = (F.col(x) for x in ("p", "s", "d", "q", "pos", "c"))
    gene = F.floor(pos / GENE)
    genes = F.when(p % 7 == 0, F.lit(None).cast("string")).when(pos % 5 == 0, F.concat(F.lit("G"), gene.cast("string"), F.lit(",G"), (gene + 1).cast("string"))).otherwise(F.concat(F.lit("G"), gene.cast("string")))
    af = F.when(d == 0, "0").when(d == 10, "0.1").otherwise(F.concat(F.lit("0.0"), d.cast("string")))
    info = F.concat_ws(";", F.concat(F.lit("MQ="), (q % 61).cast("string")), F.when(p % 3 == 0, F.lit("DB")), F.concat(F.lit("Annotation="), genes), F.when(s % 4 != 0, F.concat(F.lit("1000GAF="), af)), F.concat(F.lit("CADD="), (q % 40).cast("string"), F.lit(",1")))
    call = lambda code, quality: F.concat(_pick(GT, code % 10), F.lit(":"), (code % 30).cast("string"), F.lit(","), (code % 17).cast("string"), F.lit(":"), quality.cast("string"))
    return n.select(
        (c * (1 << 40) + pos).alias("idx"), _pick(["X", *map(str, range(1, 23)), "Y", "MT"], c).alias("chrom"), "pos", F.lit(".").alias("id"), _pick(BASES, p % 4).alias("ref"), _pick(BASES, (p + 1) % 4).alias("alt"),
        (q % 100).cast("string").alias("qual"), F.when(F.col("flag") == 1, "LOWQ").otherwise("PASS").alias("filter"), info.alias("info"), F.lit("GT:AD:GQ").alias("format"),
        F.array(call(p * 7 + s, p % 100), call(p * 3 + s, s % 100), call(p + 2 * s + 3, (p + s) % 100), call(p * 9 + s * 4, q % 100)).alias("samples"),
    )


_CODES = {"proband": ("p * 7 + s", "p % 100"), "mother": ("p * 3 + s", "s % 100"), "father": ("p + 2 * s + 3", "(p + s) % 100"), "brother": ("p * 9 + s * 4", "q % 100")}
_GT_LIST = "[" + ", ".join(f"'{g}'" for g in GT) + "]"


def _sql_calls() -> str:
    """Columns gt, called, het, alt (homozygous), ref, has, gq by sample from the codes, by the rules for genotype texts."""
    out = []
    for name, (code, quality) in _CODES.items():
        k = f"(({code}) % 10)"
        out.append(
            f"{_GT_LIST}[CAST({k} + 1 AS INTEGER)] AS {name}_gt, {k} <> 4 AS {name}_called, {k} IN (1, 2, 5, 7, 9) AS {name}_het, {k} IN (3, 6) AS {name}_alt, "
            f"{k} IN (0, 8) AS {name}_ref, {k} IN (1, 2, 3, 5, 6, 7, 9) AS {name}_has, ({quality}) AS {name}_gq, ({code}) % 30 AS {name}_ad0, ({code}) % 17 AS {name}_ad1"
        )
    return ", ".join(out)


SQL_VARIANTS = f"""{SQL_NUMBERS},
v AS (
  SELECT c * 1099511627776 + pos AS idx, ['X', {", ".join(f"'{i}'" for i in range(1, 23))}, 'Y', 'MT'][CAST(c + 1 AS INTEGER)] AS chrom, pos, ['A', 'C', 'G', 'T'][CAST(p % 4 + 1 AS INTEGER)] AS ref,
         ['A', 'C', 'G', 'T'][CAST((p + 1) % 4 + 1 AS INTEGER)] AS alt, q % 100 AS qual, CASE WHEN flag = 'R' THEN 'LOWQ' ELSE 'PASS' END AS filter, p, s, q, d, c,
         CASE WHEN p % 7 = 0 THEN []::VARCHAR[] WHEN pos % 5 = 0 THEN ['G' || (pos // {GENE}), 'G' || (pos // {GENE} + 1)] ELSE ['G' || (pos // {GENE})] END AS features,
         CASE WHEN s % 4 <> 0 THEN d / 100.0::DOUBLE END AS af, {_sql_calls()}
  FROM n)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, stop, symbol: a region for each part, dealt over the chromosomes."""
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select((k % 22 + 1).cast("string").alias("chrom"), (k * 3).alias("start"), (k * 3 + F.col("p_size") * 7).alias("stop"), F.col("p_brand").alias("symbol"))


SQL_REGIONS = "r AS (SELECT CAST(p_partkey % 22 + 1 AS VARCHAR) AS chrom, p_partkey * 3 AS start, p_partkey * 3 + p_size * 7 AS stop, p_brand AS symbol FROM part)"


def frequency_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, chrom, pos, end, alts, af, max_af: a record for each order."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    a, b = _pick(BASES, cust % 4), _pick(BASES, (cust + 1) % 4)
    pos = F.floor(k / 25) * 10 + cust % 7 + 1
    af = lambda x: F.concat(F.lit("0."), x.cast("string"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("ord"), _pick(["X", *map(str, range(1, 23)), "Y", "M"], k % 25).alias("chrom"), pos.alias("pos"), (pos + cust % 3).alias("end"),
        F.array(a, b).alias("alts"), F.array(af(cust % 97), af(cust % 89)).alias("af"), F.array(af(cust % 79), af(cust % 73)).alias("max_af"),
    )


SQL_FREQUENCIES = """f0 AS (
  SELECT o_orderkey AS ord, ['X', {}, 'Y', 'M'][CAST(o_orderkey % 25 + 1 AS INTEGER)] AS chrom, (o_orderkey // 25) * 10 + o_custkey % 7 + 1 AS pos, o_custkey AS k FROM orders),
f AS (
  SELECT ord, chrom, pos, pos + k % 3 AS stop_at, ['A', 'C', 'G', 'T'][CAST(k % 4 + 1 AS INTEGER)] AS alt, '0.' || (k % 97) AS af, '0.' || (k % 79) AS max_af FROM f0
  UNION ALL SELECT ord, chrom, pos, pos + k % 3, ['A', 'C', 'G', 'T'][CAST((k + 1) % 4 + 1 AS INTEGER)], '0.' || (k % 89), '0.' || (k % 73) FROM f0)""".format(", ".join(f"'{i}'" for i in range(1, 23)))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, ord, chrom, pos, alt, raw, phred: rows of three sources, a third of the places in each."""
    n = numbers(spark, sf_dir)
    p, s = F.col("p"), F.col("s")
    rows = n.filter(p % 5 != 0).select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("source"), "*").filter((p + F.col("source")) % 3 != 0)
    alt = _pick(BASES, (p + F.when(s % 6 == 0, 2).otherwise(1)) % 4)
    return rows.select("source", (F.col("pos") * 10 + s % 10).alias("ord"), _pick(["X", *map(str, range(1, 23)), "Y", "M"], F.col("c")).alias("chrom"), "pos", alt.alias("alt"), (p % 1000 + F.col("source")).cast("string").alias("raw"), (s % 50 + F.col("source")).cast("string").alias("phred"))


SQL_SCORES = """c3 AS (
  SELECT k AS source, pos * 10 + s % 10 AS ord, ['X', {}, 'Y', 'M'][CAST(c + 1 AS INTEGER)] AS chrom, pos,
         ['A', 'C', 'G', 'T'][CAST((p + CASE WHEN s % 6 = 0 THEN 2 ELSE 1 END) % 4 + 1 AS INTEGER)] AS alt, CAST(p % 1000 + k AS VARCHAR) AS raw, CAST(s % 50 + k AS VARCHAR) AS phred
  FROM n, range(3) t(k) WHERE p % 5 <> 0 AND (p + k) % 3 <> 0)""".format(", ".join(f"'{i}'" for i in range(1, 23)))
