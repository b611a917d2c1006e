"""Operator 1: mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hex_bits, n_words

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix-1:"
#: Hexadecimal digits of the sub-bucket that splits documents of one source and size: 16 ** 3 buckets.
BUCKET_DIGITS = 3
#: Parts that rows without doc_id, or of one doc_id, are split into by their texts.
PARTS = 4096


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """Targets of each source from (source, size) rows.

    Sources in code point order, null last, take `weights` in turn and share total_share of all sizes; a
    target stops at max_repeat times its source's size and the excess is shared anew by weight. With sources
    in order of cap / weight, level(k) = (total - caps before k) / (weights from k on) rises up to the first
    source that is not capped and falls after it, so that the highest level is the one all settle at.
    Returns source, source_size, target. One row a source, so the windows without a key stay small.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = stats.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeat)
    all_rows = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "source", "source_size", "weight", "cap",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.sum("weight").over(all_rows).alias("weight_all"),
        (F.sum("source_size").over(all_rows) * F.lit(float(total_share))).alias("total"),
    )
    level = (F.col("total") - F.col("caps_before")) / (F.col("weight_all") - F.col("weight_before"))
    ranked = ranked.withColumn("level", F.max(level).over(all_rows))
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
) -> DataFrame:
    """How often the mix takes each document: systematic sampling within each source.

    Every document of a source expects target / source_size copies. Documents stand in order of size, the
    expected copies are summed up along that order, one random offset a source is added, and a document is
    emitted once for each integer boundary that its stretch crosses: floor(u + r * rank) - floor(u + r * (rank - 1)).
    The order by size makes the words taken follow the target closely, as each stretch of similar sizes gives its share.

    docs: doc_id, text, source; other columns are not read. Returns doc_id, source, size, source_size, target,
    copies, taken (copies * size). The rank is a prefix sum in three steps, so no task holds a source:
    counts by size before it (rows: distinct sizes of a source), counts by sub-bucket of one size (at most
    4,096 rows), row numbers within a sub-bucket (which hashes of doc_id split; rows without doc_id, the first of their
    sub-bucket, are split by hashes of their texts).

    Null text: size 0. Texts of any length are counted whole. Null source: a source of its own, the last. Repeated rows: each
    is a document; where doc_ids tie, sizes tie too or the order by size decides. Empty tables: no rows. Sources without a
    word: target 0.
    """
    sized = cut(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
            hex_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "", BUCKET_DIGITS).cast("int").alias("bucket"),
            F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")).otherwise(PARTS).alias("part"),
        )
    )
    targets = source_targets(sized, weights, total_share, max_repeat)
    # A null source joins like any other under (is null, name).
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]
    counts = sized.groupBy(*key, "size", "bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    levels = counts.groupBy("no_source", "source_key", "size").agg(F.sum("n").alias("n"))
    by_size = Window.partitionBy("no_source", "source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("no_source", "source_key", "size", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("smaller"))
    by_bucket = Window.partitionBy("no_source", "source_key", "size").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("no_source", "source_key", "size", "bucket", "part", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("earlier"))
    offsets = offsets.join(levels, ["no_source", "source_key", "size"])
    targets = targets.select(*key, "source_size", "target")
    offsets = offsets.join(targets, ["no_source", "source_key"])
    inside = Window.partitionBy("no_source", "source_key", "size", "bucket", "part").orderBy("doc_id")
    rows = sized.select("doc_id", "source", *key, "size", "bucket", "part").withColumn("nth", F.row_number().over(inside))
    rows = rows.join(offsets, ["no_source", "source_key", "size", "bucket", "part"])
    rank = F.col("smaller") + F.col("earlier") + F.col("nth")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (hex_bits(F.coalesce("source", F.lit("")), seed, 8) + F.lit(0.5)) / F.lit(float(2**32))
    copies = F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """docs with every row as often as the mix takes it; same columns, repeats are equal rows. Other arguments as in mix_sources.

    doc_id must identify rows here up to equal rows: of several rows with one doc_id each is taken as often as that id is on
    average, those of the least hashes of their texts once less or more. So are rows without doc_id. Rows travel as one struct,
    whatever their columns are named; null, empty and long texts and empty tables: as in mix_sources.
    """
    taken = mix_sources(docs, **kwargs).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    taken = taken.filter("copies > 0").withColumnRenamed("doc_id", "taken_id")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(taken, F.col("id").eqNullSafe(F.col("taken_id"))).drop("taken_id")
    single = rows.filter("n = 1").select("row", F.col("copies").alias("times"))
    several = rows.filter("n > 1").withColumn("part", F.pmod("h", F.lit(PARTS)))
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = several.groupBy("id", "part").agg(F.count(F.lit(1)).alias("k"))
    parts = parts.select(F.col("id").alias("part_id"), F.col("part").alias("of"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("earlier"))
    several = several.join(parts, F.col("id").eqNullSafe(F.col("part_id")) & (F.col("part") == F.col("of")))
    nth = F.col("earlier") + F.row_number().over(Window.partitionBy("id", "part").orderBy("h"))
    share = F.floor(F.col("copies") * F.col("nth") / F.col("n")) - F.floor(F.col("copies") * (F.col("nth") - 1) / F.col("n"))
    several = several.withColumn("nth", nth).select("row", share.alias("times"))
    both = single.unionByName(several).filter("times > 0")
    return both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("again")).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BUCKET_DIGITS}) AS INTEGER) AS bucket
  FROM documents),
stats AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * {MAX_REPEAT} AS cap,
         list_extract([{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}], CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)) AS weight
  FROM stats),
levels AS (
  SELECT *, (sum(source_size) OVER () * {TOTAL_SHARE}::DOUBLE - coalesce(sum(cap) OVER w, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         (CAST('0x' || substr(md5('{SEED}' || coalesce(s.source, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.bucket, s.doc_id NULLS FIRST) AS rank
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(u + rate * rank) - floor(u + rate * (rank - 1))) AS BIGINT) * size AS taken
FROM ranked
"""
