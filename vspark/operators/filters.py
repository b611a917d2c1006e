"""Filters by thresholds, sets and qualities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_float
from ..functions.variant import info_value


def least_value(info: Column, key: str) -> Column:
    """The least number of a comma list."""
    return F.array_min(F.transform(F.split(info_value(info, key), ","), to_float))


def passes(value: Column, threshold: float, greater: bool = False, discard: bool = False) -> Column:
    """value < threshold, or > with `greater`; a missing value, and 0 as well, passes unless `discard`."""
    held = (value > threshold) if greater else (value < threshold)
    return F.when(value.isNull() | (value == 0), F.lit(not discard)).otherwise(held)


def filter_variants(variants: DataFrame, key: str = "1000GAF", threshold: float = 0.05, greater: bool = False, discard: bool = False, header_keys: Sequence[str] | None = None) -> DataFrame:
    """The variants that pass by an INFO key; ValueError if a header is given that does not declare the key. A row-wise filter: it also runs on streams."""
    if header_keys is not None and key not in header_keys:
        raise ValueError(f"{key} is not in the header")
    return variants.filter(passes(least_value(F.col("info"), key), threshold, greater, discard))


def with_counters(variants: DataFrame, kept: Column, name: str):
    """The kept variants and an observation of total, passed and removed, filled by the first action over them."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counted = variants.observe(seen, F.count(F.lit(1)).alias("total"), F.count(F.when(kept, 1)).alias("passed"), F.count(F.when(~F.coalesce(kept, F.lit(False)), 1)).alias("removed"))
    return counted.filter(kept), seen


def covered_in_all(calls: Column, least: int) -> Column:
    """Whether all calls of an array of genotypes have at least so many reads."""
    return F.forall(calls, lambda g: g["quality_depth"] >= least)


#: Buckets of models that variants of interest are shown under.
INTERESTS = {
    "dominant": ("AD",), "dominant_dn": ("AD_dn",), "homozygous": ("AR_hom", "AR_hom_dn"), "compound": ("AR_comp", "AR_comp_dn"), "x": ("XR", "XD"), "x_dn": ("XR_dn", "XD_dn"),
}


def interesting(variants: DataFrame, least_score: float = 15.0, most_frequency: float = 0.05, least_quality: float = 0.0, excluded_genes: Sequence[str] = ()) -> DataFrame:
    """One row for each bucket of a variant's models, of variants that pass FILTER, quality, score and frequency and lie in no excluded gene.

    variants: models (array), filter, qual (number), score, frequency, features (array).
    """
    held = (F.size("models") > 0) & (F.col("filter") == "PASS") & (F.col("qual") > least_quality) & (F.col("score") > least_score) & (F.coalesce("frequency", F.lit(0.0)) < most_frequency)
    if excluded_genes:
        held = held & ~F.coalesce(F.arrays_overlap("features", F.array(*[F.lit(g) for g in excluded_genes])), F.lit(False))
    buckets = [F.when(F.arrays_overlap("models", F.array(*[F.lit(m) for m in ms])), F.lit(name)) for name, ms in INTERESTS.items()]
    return variants.filter(held).withColumn("bucket", F.explode(F.array_compact(F.array(*buckets))))


def prune_partners(compounds: Column, retained: Column) -> Column:
    """Only the partners that are themselves retained."""
    return F.array_intersect(compounds, retained)
