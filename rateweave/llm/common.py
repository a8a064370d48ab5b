"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

#: Rows that a Python task turns into objects at a time. It bounds memory only; results don't depend on it.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``rows`` rows, or of more that make about ``size`` bytes."""
    for batch in batches:
        step = max(rows, size * batch.num_rows // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def put(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with ``fields`` in place of columns of these names, or else at the end."""
    own = {name.lower() for name, _ in fields}
    return T.StructType(
        [f for f in schema if f.name.lower() not in own] + [T.StructField(name, kind) for name, kind in fields]
    )


def with_python_columns(
    df: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], make: Callable[[pa.RecordBatch], list[list]], size: int = 0,
) -> DataFrame:
    """Add columns that ``make`` computes from a slice of rows, one list per field.

    A column of the same name is replaced; ``make`` still sees the old one. A slice may have more rows up to ``size`` bytes.
    """
    schema = put(df.schema, *((name, kind) for name, kind, _ in fields))
    kept = [f.name for f in schema][: len(schema) - len(fields)]

    def run(batches):
        for part in slices(batches, size=size):
            made = make(part)
            yield pa.RecordBatch.from_arrays(
                [part.column(name) for name in kept] + [pa.array(v, k[2]) for v, k in zip(made, fields, strict=True)],
                names=[f.name for f in schema],
            )

    return df.mapInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
