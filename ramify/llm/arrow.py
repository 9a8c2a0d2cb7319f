"""Small helpers for Arrow-batched Python stages.

Spark cuts Arrow batches by rows alone, 10,000 of them unless told otherwise, so a batch of long
texts has no bound. ``small_batches`` makes that ROWS for the session, if it still has Spark's
default; every operator that sends texts to Python calls it.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends Python at most ROWS rows at a time (a setting of the user's own stays)."""
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, str(ROWS))
    return df


def give_back() -> None:
    """Return freed memory to the system: Python workers live on when their task ends."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``max_bytes`` at most (one row may exceed it)."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            ahead = np.cumsum(sizes[start : start + max_rows])
            n = max(1, int(np.searchsorted(ahead, max_bytes, side="right")))
            yield batch.slice(start, n)
            start += n
    give_back()


def gathered(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until ``column`` holds ``max_bytes`` or so, for work with a fixed cost per batch."""
    held, size = [], 0
    for batch in slices(batches, column, max_bytes):
        held.append(batch)
        size += int(pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0)
        if size >= max_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def binary(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), type=pa.binary())


def appended(batch: pa.RecordBatch, schema: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``columns`` added, in the order and types of ``schema``."""
    arrays = [columns[f.name] if f.name in columns else batch.column(f.name) for f in schema]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def list_of(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values, type=kind))
