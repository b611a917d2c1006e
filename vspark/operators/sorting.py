"""Orders of variants: by rank, by place, by natural names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chromosome_priority, natural_key
from ..functions.variant import family_score
from ..plans.checkpoint import stored

LINE = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def line_text(variants: DataFrame) -> Column:
    """The record as a line of text."""
    fixed = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in LINE if c in variants.columns]
    return F.concat_ws("\t", *fixed, *(["samples"] if "samples" in variants.columns else []))


def by_rank(variants: DataFrame, key: str = "RankScore", family: str | None = None) -> DataFrame:
    """Highest rank first, those without one at -100; ties by the whole line, backwards. The order is by ranges over the cluster, and spills.

    Rows are stored first: an order by ranges reads its input twice, once for the ranges. Lines are a column, as an order compares
    rows many times and would put both lines together each time.
    """
    ranked = stored(variants.withColumn("__rank", family_score(F.col("info"), family, key)))
    ranked = ranked.withColumn("__line", line_text(ranked.drop("__rank")))
    return ranked.orderBy(F.col("__rank").desc(), F.col("__line").desc()).drop("__rank", "__line")


def by_place(variants: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """By chromosome priority and position; equal ones as in the file."""
    return variants.withColumn("__p", chromosome_priority(F.col("chrom"), custom).try_cast("int")).orderBy("__p", "pos", "idx").drop("__p")


def by_name(variants: DataFrame) -> DataFrame:
    """By chromosome name, numbers within names as numbers, and position."""
    return variants.withColumn("__k", natural_key(F.col("chrom"))).orderBy("__k", "pos", "idx").drop("__k")


def numbered(ordered: DataFrame, name: str = "position") -> DataFrame:
    """The rows of an ordered table with their place from 1: counts of the order's ranges are summed up, one row a range."""
    rows = stored(ordered.withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at") - F.shiftleft(F.col("__range"), 33) + 1
    return rows.join(ranges, "__range").withColumn(name, place).drop("__at", "__range", "__before")


def top(variants: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n rows of the highest value, ties by idx."""
    return variants.orderBy(F.col(column).desc_nulls_last(), F.col("idx")).limit(n)
