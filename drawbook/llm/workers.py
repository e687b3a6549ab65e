"""Python workers live through many stages; what one task frees must go back to the machine before the next one starts.

So does the driver: Spark's cleaner frees broadcast tables and shuffle files of ended queries only after a collection.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from drawbook.llm import shingles

#: Seconds between two clean-ups by a function that is called for every group.
PAUSE = 2.0
_last = 0.0


def give_back() -> None:
    """Drop tables kept between calls, and return free memory of Arrow and of the C library to the system."""
    shingles.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps its own counsel
        pass


def tidy_driver(spark: SparkSession) -> None:
    """Let go of ended queries on the driver, for jobs of many small ones: Python's handles first, then what they held."""
    gc.collect()
    spark._jvm.System.gc()


def tidy_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over a task's batches that leaves no memory behind."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable):
    """A function of one group (frame, or key and frame, in; frame out) that cleans up now and then."""

    def after(out):
        global _last
        if time.monotonic() - _last > PAUSE:
            give_back()
            _last = time.monotonic()
        return out

    # Spark looks at the number of arguments.
    if len(inspect.getfullargspec(run).args) == 2:
        return lambda key, frame: after(run(key, frame))
    return lambda frame: after(run(frame))
