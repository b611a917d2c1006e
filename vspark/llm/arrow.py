"""Row-wise operators over Arrow batches: the kept columns pass through, computed ones are appended."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ship


def with_computed(df: DataFrame, inputs: Sequence[str], keep: Sequence[str], added: T.StructType, make: Callable[[], Callable], by_batch: bool = False) -> DataFrame:
    """df's `keep` columns and then the columns of `added`.

    make() runs once a task and returns a function that gets one row's `inputs` as Python values and returns
    the row's added values as a tuple; with by_batch, a function of lists of these values that returns a list of tuples. A kept column with the name of an added one gives way to it. Memory: one
    Arrow batch and one row's working set.
    """
    ship(df.sparkSession)
    names = {f.name for f in added}
    kept = [c for c in keep if c not in names]
    source = df.select(*[df[f"`{c}`"].alias(f"__in{i}") for i, c in enumerate(inputs)], *[df[f"`{c}`"].alias(f"__keep{i}") for i, c in enumerate(kept)])
    fields = source.schema.fields[len(inputs) :]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(kept, fields, strict=True)] + list(added))
    added_arrow = to_arrow_schema(added)
    n_in = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            columns = [batch.column(i) for i in range(n_in)]
            rows = one(*(c.to_pylist() for c in columns)) if by_batch else [one(*(c[i].as_py() for c in columns)) for i in range(batch.num_rows)]
            made = [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(added_arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(n_in + i) for i in range(len(kept))] + made, names=kept + added_arrow.names)

    return source.mapInArrow(run, schema)
