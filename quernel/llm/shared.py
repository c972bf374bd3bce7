"""What the operators share: the shared working folder, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.constraints import written

__all__ = ["BROADCAST_BYTES", "SPACE", "in_slices", "let", "release", "small", "spread", "table", "written"]

#: The white space that separates words in every contract here: x20 and x09-x0D.
SPACE = " \t\n\x0b\x0c\r"
#: A side is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, hinted for broadcast if its measured size is under BROADCAST_BYTES; else left to a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body repeats it or uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def spread(df: DataFrame, most: int = 64) -> DataFrame:
    """A scan, dealt anew where it has fewer partitions than the session has cores (up to `most`): a small file is one row
    group, and would be one task. Tables of some size have more partitions and are read as they lie, without a shuffle."""
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, most)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_slices(batches, column: int = 1, most: int = 1 << 21):
    """Record batches whose strings in a column hold about `most` bytes at most (one row at least), of the batches.

    A batch of Spark's has many rows however long their texts are; a slice bounds what stands beside it as Python objects.
    When all are read, memory that the worker no longer uses goes back to the system: workers are used again.
    """
    for b in batches:
        column = min(column, b.num_columns - 1)
        if not b.num_rows:
            yield b
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop
    del batches
    release()


def release() -> None:
    """Gives memory that this worker no longer uses back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
