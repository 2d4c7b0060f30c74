"""What the training-data operators share: tables, Arrow helpers, and the core's checkpoints and components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import checkpointed, connected_components, release, sized

__all__ = ["checkpointed", "columns_of", "connected_components", "release", "rows_to_batches", "sized", "slices", "table", "text_bytes", "wider"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit("").cast("binary"))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def wider(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with the columns of a DDL string after its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def slices(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows, so that few texts at a time become Python objects."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def rows_to_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
