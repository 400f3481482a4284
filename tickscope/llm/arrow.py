"""Columns computed from a text column in Arrow batches; the other columns pass through unchanged, nulls and large ids included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def with_columns(df: DataFrame, text_col: str, new: dict[str, str], compute: Callable[[list[str | None]], list], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) plus ``new`` (name to type). ``compute`` gets a batch's texts and returns a list per new column.

    A column of ``df`` with the name of a new one is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    read = list(dict.fromkeys([*kept, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = compute(batch.column(read.index(text_col)).to_pylist())
            columns = [batch.column(read.index(c)) for c in kept] + [pa.array(v, KINDS[t]) for v, t in zip(values, new.values())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *new])

    schema = df.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    return df.select(*read).mapInArrow(run, schema)
