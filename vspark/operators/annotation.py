"""Regions and lookups: what lies at a variant's position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases in a bin of the finest level of the range joins.
BIN = 1 << 8
LEVELS = 13


def _binned(ranges: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """ranges [start, stop) with level and bin, a row for each bin that they touch, and the levels that there are.

    Bins of each level are four times as wide as those of the one before; a range is on the first level whose bins are as wide as
    itself, so that it touches two at most and no bin holds more than what lies close together.
    """
    length, level = F.col("stop") - F.col("start"), F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(length <= width << 2 * k, F.lit(k)).otherwise(level)
    wide = F.element_at(F.array(*[F.lit(width << 2 * k).cast("long") for k in range(LEVELS)]), F.col("level") + 1)
    levelled = ranges.filter("start < stop").withColumn("level", level)
    levels = sorted(r.level for r in levelled.select("level").distinct().collect())
    return levelled.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor((F.col("stop") - 1) / wide)))), levels or [0]


def _places(variants: DataFrame, levels: list[int], width: int, *others: str) -> DataFrame:
    """idx, chrom, pos and others of variants with level and bin, a row for each level."""
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("pos") / (width << 2 * k)).alias("bin")) for k in levels])
    return variants.select("idx", F.col("chrom_key").alias("chrom"), "pos", *others, F.explode(at).alias("at")).select("idx", "chrom", "pos", *others, "at.level", "at.bin")


def overlapping_regions(variants: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """idx and annotation: the sorted distinct symbols of regions with start <= pos < stop, joined by commas; variants without one are not returned.

    variants: idx, chrom_key, pos. regions: chrom, start, stop, symbol. An equi-join by chromosome, level and bin with the
    bounds as a residual: both sides are dealt by place, not by chromosome, and the engine broadcasts the regions where their size allows it.
    """
    bins, levels = _binned(regions, width)
    hits = _places(variants, levels, width).join(bins, ["chrom", "level", "bin"]).filter((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("stop")))
    return hits.groupBy("idx").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("annotation"))


def frequencies(variants: DataFrame, records: DataFrame, width: int = BIN) -> DataFrame:
    """idx, af, max_af of the last record (by ord) that covers the position and lists the variant's whole ALT.

    variants: idx, chrom_key, pos, alt. records: ord, chrom, pos, end (inclusive), alts, af, max_af (arrays of texts). The value
    is that at the ALT's place in the list; REF is not compared.
    """
    each = records.select("ord", "chrom", F.col("pos").alias("start"), (F.col("end") + 1).alias("stop"), F.posexplode("alts").alias("at", "alt"), "af", "max_af")
    each = each.select("ord", "chrom", "start", "stop", "alt", F.get("af", F.col("at")).alias("af"), F.get("max_af", F.col("at")).alias("max_af"))
    bins, levels = _binned(each, width)
    hits = _places(variants, levels, width, "alt").join(bins, ["chrom", "level", "bin", "alt"]).filter((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("stop")))
    # Within one record a later entry of the same ALT counts.
    last = F.max_by(F.struct("af", "max_af"), F.struct("ord"))
    return hits.groupBy("idx").agg(last.alias("x")).select("idx", "x.af", "x.max_af")


def score_lookup(variants: DataFrame, scores: DataFrame, values: list[str]) -> DataFrame:
    """idx and the values of the row at chrom, pos and alt in the first source that has one; within a source the last row counts.

    variants: idx, chrom_key, pos, alt. scores: source, ord, chrom, pos, alt and the values. REF is not compared.
    """
    places = variants.select("idx", F.col("chrom_key").alias("chrom"), "pos", "alt")
    # The hits are reduced, not the sources: those can hold a row for every base.
    hits = places.join(scores, ["chrom", "pos", "alt"])
    best = hits.groupBy("idx").agg(F.min_by(F.struct(*values), F.struct(F.col("source"), -F.col("ord"))).alias("x"))
    return best.select("idx", *[F.col(f"x.{v}").alias(v) for v in values])


def splice_scores(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """idx and score from one source of splice scores; 0 is not reported."""
    return score_lookup(variants, scores.withColumn("source", F.lit(0)), ["score"]).filter("score <> 0")


def known_sites(variants: DataFrame, sites: DataFrame) -> DataFrame:
    """The variants' idx whose chrom, pos and alt is among sites (chrom, pos, alt)."""
    places = variants.select("idx", F.col("chrom_key").alias("chrom"), "pos", "alt")
    return places.join(sites.select("chrom", "pos", "alt"), ["chrom", "pos", "alt"], "left_semi").select("idx")


def with_lookup(variants: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """variants with columns of a lookup by idx, null where there was no hit."""
    return variants.join(found.select("idx", *columns), "idx", "left")

