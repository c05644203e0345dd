"""Shared plumbing of the training-data operators: shared work folder, written tables, Arrow text blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, shared_dir, written  # noqa: F401

#: Bytes of text that one Python step holds at a time; a longer document makes a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of an Arrow batch; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, by rows and by bytes, so that a batch of long documents fits beside the executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: Bytes of input files for each part of a shuffle, where the session's number of partitions makes larger ones.
PART_BYTES = 32 << 20


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Parts of a shuffle: the session's number, or more where df reads more files than that."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if df is not None else 0
    return max(n, -(-size // PART_BYTES)) if size < 1 << 52 else n  # a size that is not known is given as a larger one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bundled(df: DataFrame, name: str, leave: tuple[str, ...] = ()) -> DataFrame:
    """One struct column of all columns but those in `leave`, and those; so no other column's name can clash."""
    rest = [c for c in df.columns if c not in leave]
    whole = F.struct(*[df[f"`{c}`"].alias(c) for c in rest]) if rest else F.lit(None).cast("string")
    return df.select(*[df[f"`{c}`"] for c in leave], whole.alias(name))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts have at most `limit` bytes (or one document), as (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = text_arrays(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
