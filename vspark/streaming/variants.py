"""Variant lines as a stream: scan, filter and score are row-wise, so that append mode holds without state.

Batches need their whole chromosome; per_batch runs them on each micro-batch whose files hold whole chromosomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import filter_variants
from ..operators.scores import score_variants, write_scores
from ..plans.rules import RankModel
from ..sources.files import parse_variants
from ..sources.header import Header


def stream_variants(spark: SparkSession, folder: str, header: Header, files_per_trigger: int = 1) -> DataFrame:
    """Records of the variant files that arrive in a folder."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_variants(text, header)


def stream_filter(variants: DataFrame, **kwargs) -> DataFrame:
    return filter_variants(variants, **kwargs)


def stream_scores(variants: DataFrame, model: RankModel, family: str = "1") -> DataFrame:
    return write_scores(score_variants(variants, model), model, family).select(*variants.columns)


def per_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A query that applies a batch plan to each micro-batch and writes it as Parquet, a folder a batch: a batch that is run again overwrites its own."""

    def write(df: DataFrame, number: int) -> None:
        step(df.withColumn("idx", F.monotonically_increasing_id())).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
