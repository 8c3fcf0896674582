"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.plans.storage import discard, fresh_dir, materialize, shared_dir

__all__ = ["discard", "documents", "free_name", "fresh_dir", "kept", "let", "let_go", "materialize", "row_ranges", "shared_dir", "text_bytes", "tidy", "trim"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; reads that one column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()["n"] or 0)


def free_name(docs: DataFrame, wish: str) -> str:
    """wish, or wish with underscores in front if docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


_KEPT: list[dict] = []


def kept() -> dict:
    """A dict for what an operator keeps in its Python worker between tasks, until let_go."""
    _KEPT.append({})
    return _KEPT[-1]


def let_go() -> None:
    """For tasks that use nothing kept: workers outlive their stage, and what an earlier one has left is memory taken from this one."""
    if any(_KEPT):
        for d in _KEPT:
            d.clear()
        trim()


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a loop: shuffle files and broadcasts of finished jobs are removed only once the
    driver's collector finds them unused, so ask it to look."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)  # there is none where the driver is elsewhere
    if jvm is not None:
        jvm.System.gc()
    trim()


def row_ranges(sizes, most: int = 1 << 22):
    """(lo, hi) ranges of rows whose sizes add up to about `most`; a larger row is one of its own."""
    lo, total = 0, 0
    for k, s in enumerate(sizes):
        if k > lo and total + s > most:
            yield lo, k
            lo, total = k, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)
