"""Documents that come again, in any order: the stream's state holds the last version of each, so no earlier epoch is ever scanned."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.text import STOPWORDS, tokens


def accepted(source: DataFrame, key: str = "doc_id", order: str = "version", text: str = "text", stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(key, version, words, gone) of each document whose text is newer than what the state holds: its words, and those of the version that it replaces.

    ``order`` is a long; of rows of one key in a batch the one with the greatest counts, ties by the text. What is not newer than the state is
    dropped, however late it comes. A null text has no words and replaces any; null keys are left out. The state of a document is its version and its
    different words, and lives as long as the query's checkpoint."""
    rows = source.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_distinct(tokens(F.col("text"), stopwords)))

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            for version, text, words in zip(pdf["version"], pdf["text"], pdf["words"]):
                if best is None or (version, text) > best[:2]:
                    best = (int(version), text, list(words))
        held = state.get if state.exists else None
        if best is not None and (held is None or best[0] > held[0]):
            state.update((best[0], best[2]))
            yield pd.DataFrame({"key": [key[0]], "version": [best[0]], "words": [best[2]], "gone": [list(held[1]) if held else []], "fresh": [held is None]})

    out = "key string, version long, words array<string>, gone array<string>, fresh boolean"
    return rows.groupBy("key").applyInPandasWithState(newest, out, "version long, words array<string>", "update", "NoTimeout")


def frequencies(source: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options):
    """Start a query that keeps document frequencies under ``path``: each batch adds an epoch of signed counts, with the number of documents beside an
    empty word. A batch that is repeated after a failure overwrites its epoch, and the state is that of the batch before."""

    def write(batch: DataFrame, epoch: int) -> None:
        mark = F.array(F.lit(""))
        more = batch.select(F.explode(F.concat("words", F.when(F.col("fresh"), mark).otherwise(F.array().cast("array<string>")))).alias("word"), F.lit(1).alias("df"))
        less = batch.select(F.explode("gone").alias("word"), F.lit(-1).alias("df"))
        more.unionByName(less).groupBy("word").agg(F.sum("df").alias("df")).filter("df <> 0").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return accepted(source, **options).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(word, df), the number of documents beside an empty word."""
    return spark.read.schema("word string, df long, epoch int").parquet(path).groupBy("word").agg(F.sum("df").alias("df")).filter("df > 0")
