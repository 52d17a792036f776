"""Keeping Python workers small: they are reused, so what one step leaves behind counts against the next."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Whole texts are long: hands workers at most ``rows`` of them at a time from now on in this session."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


def tidy() -> None:
    """Returns freed memory to the system at the end of a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass
