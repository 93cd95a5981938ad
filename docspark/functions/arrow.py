"""Arrow passes whose workers stay small, whatever the input's size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that a worker gets at once, where the user has not chosen.
MOST = {"maxRecordsPerBatch": 3000, "maxBytesPerBatch": 16 << 20}


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose next pass by Arrow or pandas gets batches of bounded rows and bytes: a worker's memory follows neither the number nor the length of texts."""
    conf = df.sparkSession.conf
    for name, most in MOST.items():
        key = f"spark.sql.execution.arrow.{name}"
        if conf.get(key, None) is None:
            conf.set(key, str(most))
    return df


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a reused worker returns to the system what it has freed."""

    def then_release(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return then_release
