"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.storage import shared_dir


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; lineage ends there, so lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def in_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20, max_rows: int = 4096):
    """Cuts of a batch whose texts hold about max_bytes, so that the memory of a task doesn't follow the texts' length."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (held + size > max_bytes or i - begin >= max_rows):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)


def relieved(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory that it no longer uses back to the system at its end: workers go on to other stages."""

    def relieving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return relieving


#: Bits of the filters that keep rows without a partner out of a shuffle; they grow no further.
FILTER_BITS = 1 << 27


def bit_filter(rows: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a long column, by its lowest bits; at most FILTER_BITS / 64 words reach the driver."""
    at = rows.select(F.col(column).bitwiseAND(FILTER_BITS - 1).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS >> 6, np.uint64)
    held[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
    return held


def passing(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where values may be among those of the filter; where they aren't, they surely aren't."""
    bit = values.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return np.flatnonzero(held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
