"""Shared helpers: tables in the shared folder, Arrow columns as numpy, whole-text batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tokens import forget

#: Bytes of text that numpy code looks at together; one longer text goes alone.
SLICE_BYTES = 4 << 20
#: Stands for a null doc_id inside the operators; such rows sort before all others.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/varscope-{name}-{uuid.uuid4().hex}"


#: Session setting of the bytes that a batch to Python may hold.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors.
    ``batch_bytes``: at most about so much goes to Python at once, for rows that hold much (Spark fills 10,000 rows)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(BATCH_BYTES) if batch_bytes else None
    if batch_bytes:
        spark.conf.set(BATCH_BYTES, batch_bytes)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch_bytes:
            spark.conf.set(BATCH_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; sizes blocks and buckets."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def make_room(tokenizers: bool = True) -> None:
    """Python workers live from stage to stage and keep what they had: tokenizers, and freed memory of arrays and tables.
    Stages that need neither give it back first, as several workers share an executor's memory."""
    if tokenizers:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by bytes of ``column``, so that temporaries stay small."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(lengths(b.column(column)))
        lo = 0
        while lo < b.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column; null: 0."""
    data, off = raw(col)
    return np.diff(off)


def raw(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column in one array and the int64 offsets of its values; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def longs(col: pa.Array | pa.ChunkedArray, null: int = NULL_ID) -> np.ndarray:
    """An integer column as int64, ``null`` for null."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.int64())
    return np.asarray(col.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False), np.int64)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one byte array and its offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)),
                                  pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
