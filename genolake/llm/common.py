"""What several training-data operators share: staged tables, size-checked joins, Arrow text batches.

Spark hands Python workers batches of 64 MB at most (spark.sql.execution.arrow.maxBytesPerBatch), unless one text is longer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, join_hot, join_small, ship, size_of, staged

__all__ = ["crc_of_id", "discard", "each_text", "fresh", "join_hot", "join_small", "ship", "size_of", "staged", "table", "text_column"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column as (bytes, start of each text, end of each text); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    if column.null_count:
        ends = np.where(column.is_valid().to_numpy(zero_copy_only=False), ends, starts)
    return data, starts, ends


def each_text(column: pa.Array) -> Iterator[np.ndarray]:
    data, starts, ends = text_column(column)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        yield data[a:b]


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    name = base
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
