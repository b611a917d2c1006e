"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, for every operator here: a run of code points other than the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster (spark.checkpoint.dir); a temporary one only where none is set and driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vspark-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once a context, so that their Python workers need no copy of their own.

    Batches for the workers are kept small, unless the session asks for other sizes: texts can be long, and each task holds a batch on both sides.
    """
    if spark.conf.get(ROWS, "10000") == "10000":
        spark.conf.set(ROWS, "1000")
    sc = spark.sparkContext
    if getattr(sc, "_vspark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="vspark-package-")) / f"{package.name}_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._vspark_shipped = True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this package wrote to the shared folder and that is no longer needed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; use it for narrow rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def n_words(text: Column) -> Column:
    """Number of words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_key(docs: DataFrame) -> tuple[Column, Column]:
    """doc_id as a number or text (of any other type its text), and what stands for a missing one of that type."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.NumericType):
        return F.col("doc_id"), F.lit(0).cast(kind)
    return F.col("doc_id") if isinstance(kind, T.StringType) else F.col("doc_id").cast("string"), F.lit("")


def hex_bits(value: Column, seed: str, digits: int) -> Column:
    """The first hexadecimal digits of md5(seed + value) as a long: the same number in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), value.cast("string"))), 1, digits), 16, 10).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
