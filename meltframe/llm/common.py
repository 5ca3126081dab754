"""Small helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Separators of words: space and the five control characters from tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words as BIGINT; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    # a separator at either end leaves one empty part there
    return F.coalesce(F.size(F.filter(parts, lambda p: p != "")), F.lit(0)).cast("bigint")


def per_worker(key: Any, make: Callable[[], Any]) -> Any:
    """Built once in each Python worker process and kept there between tasks, until a task needs another.

    Workers outlive the stages of a pipeline: one that kept every parser and encoder would hold them all beside the JVM.
    """
    state = sys.modules.setdefault("meltframe_worker_state", types.ModuleType("meltframe_worker_state")).__dict__.setdefault("held", {})
    if key not in state:
        if state:
            state.clear()
            tidy()
        state[key] = make()
    return state[key]


def maybe_broadcast(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """A table of narrow rows whose number has been counted: broadcast up to `most` rows, left to a shuffled join beyond."""
    return F.broadcast(df) if rows <= most else df


def tidy() -> None:
    """At the end of a task: give the memory it no longer uses back to the system, which an idle worker would keep from the JVM beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
