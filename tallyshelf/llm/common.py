"""Shared helpers: registration of queries and bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
SLICE_BYTES = 8 << 20


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text each; a longer text is a batch of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > first and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        yield batch.slice(first)


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and what they keep adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and the freed memory given back after the last one."""
    yield from batches
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts; null counts as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def string_array(values) -> pa.Array:
    return pa.array(values, pa.string())


def long_array(values) -> pa.Array:
    return pa.array(values, pa.int64())
