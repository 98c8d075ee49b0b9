"""Incremental ingest: documents as they arrive, counted once, the last write of each wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..operators.stats import bag_of_words, last_rows
from ..tables import drop_path


def ingest(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text", order: str | None = None, stopwords: list[str] = STOPWORDS, trigger: dict | None = None):
    """Start a query that writes each batch's bags of words as an epoch of its own under ``path``.

    An epoch that is repeated after a failure overwrites itself, so nothing counts twice. Of several rows of a key in one batch the one
    with the largest ``order`` counts, ties by the text (without ``order`` the greatest text). Each document of a batch also has a row with
    a null word, so that one that has become empty, or null, replaces its former words by none. ``current`` reads the state.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = last_rows(batch, [key], [order] if order else [])
        seen = rows.select(key, F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("cnt"))
        bag_of_words(rows, key, text, stopwords).unionByName(seen).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _folds(spark: SparkSession, path: str) -> list[int]:
    """The epochs up to which there is a complete fold."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-folded/upto=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])


def _latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of each document's latest epoch, of the last fold and the epochs after it; one pass over narrow rows finds the epochs."""
    rows = spark.read.parquet(path)
    if folds := _folds(spark, path):
        folded = spark.read.parquet(f"{path}-folded/upto={folds[-1]}").withColumn("epoch", F.lit(folds[-1]))
        rows = rows.filter(F.col("epoch") > folds[-1]).select(*folded.columns).unionByName(folded)
    last = rows.filter("word is null").groupBy(F.col(key).alias("__key")).agg(F.max("epoch").alias("__epoch"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("__key")) & (F.col("epoch") == F.col("__epoch"))).select(key, "word", "cnt", "epoch")


def current(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, word, cnt) of each document's latest epoch."""
    return _latest(spark, path, key).filter("word is not null").select(key, "word", "cnt")


def compact(spark: SparkSession, path: str, key: str = "doc_id") -> None:
    """Fold all epochs so far into one table beside them, while no query writes.

    Readers take the last complete fold and the epochs after it, so they see the same rows before, during and after; only then do older folds
    and the folded epochs go, but for the last, which tells later readers the columns. A crash in between leaves nothing but files that nobody reads."""
    epochs = sorted(r[0] for r in spark.read.parquet(path).select("epoch").distinct().collect())
    folds = _folds(spark, path)
    if len(epochs) < 2 or folds and folds[-1] >= epochs[-1]:
        return
    _latest(spark, path, key).drop("epoch").write.mode("overwrite").parquet(f"{path}-folded/upto={epochs[-1]}")
    for f in folds:
        drop_path(spark, f"{path}-folded/upto={f}")
    for e in epochs[:-1]:
        drop_path(spark, f"{path}/epoch={e}")


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts per kind; rows later than the watermark are not counted once their window is closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
