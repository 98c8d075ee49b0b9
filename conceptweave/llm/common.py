"""What several operators share: schema helpers, checked broadcasts, memory that goes back. Written tables come from the core."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop, drop_path, fresh_path, shared_dir, written  # noqa: F401  operators take them from here


def few(rows: DataFrame, most: int, width: Column | None = None) -> DataFrame:
    """A hint to broadcast rows, if they are no more than ``most``, counting each as its ``width`` in cells. Each task counts its own rows."""
    n = rows.count() if width is None else rows.agg(F.sum(F.greatest(width, F.lit(1)))).first()[0] or 0
    return F.broadcast(rows) if n <= most else rows


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under the fixed names doc_id and text, whatever other columns there are."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, though a function of array elements uses it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tidy(batches: Iterator) -> Iterator:
    """The same batches; at their end, memory that Python freed goes back to the system, as workers live on for other tasks."""
    try:
        yield from batches
    finally:
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it
            pass
