"""Counts over variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.variant import info_value
from .genotypes import with_genotypes


def genotypes(variants: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Long form: a row for each variant and sample, with the call as a struct."""
    rows = with_genotypes(variants, {str(i): F.get("samples", F.lit(i)) for i in range(len(samples))}, "__calls")
    called = F.array(*[F.struct(F.lit(s).alias("sample"), F.col("__calls")[str(i)].alias("call")) for i, s in enumerate(samples)])
    return rows.select("idx", "chrom", "pos", F.explode(called).alias("g")).select("idx", "chrom", "pos", "g.sample", "g.call")


def sample_counts(variants: DataFrame, samples: Sequence[str]) -> DataFrame:
    """sample, variants (calls with the variant), called, reads (sum of read depths)."""
    g = genotypes(variants, samples)
    return g.groupBy("sample").agg(F.count(F.when(F.col("call.has_variant"), 1)).alias("variants"), F.count(F.when(F.col("call.genotyped"), 1)).alias("called"), F.sum("call.quality_depth").alias("reads"))


def families_present(variants: DataFrame, key: str = "GeneticModels") -> DataFrame:
    """The distinct families that an INFO key names."""
    return variants.select(F.explode(F.split(info_value(F.col("info"), key), ",")).alias("entry")).select(F.split("entry", ":")[0].alias("family")).distinct()


def model_counts(variants: DataFrame, key: str = "GeneticModels") -> DataFrame:
    """model, variants: how many variants follow each model in some family."""
    entries = F.split(info_value(F.col("info"), key), ",")
    models = F.array_distinct(F.flatten(F.transform(entries, lambda e: F.split(F.element_at(F.split(e, ":"), -1), r"\|"))))
    return variants.select(F.explode(models).alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("variants"))


def as_json(rows: DataFrame) -> DataFrame:
    """value: each row as a JSON object."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))
