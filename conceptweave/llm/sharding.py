"""Operator 4, sharding: two-pass external shuffle under the law ``key``.

Pass one scatters the rows: the shard of a row is the one whose seeded hash of (doc_id, shard) is largest, so shards are
near equal and a further shard only takes rows into itself; inside its shard a row goes to one of as many buckets as make
a bucket of this shard about ``bucket_bytes`` large, by a seeded hash of id and text. Rows that repeat one id and text until they fill a
bucket are found by a count and scattered by their position as well. Pass two sorts each bucket (for a result that a
repeated task makes again), shuffles it by Fisher-Yates and writes it, in order, under its shard's folder. A row's slot is the number of
rows in the buckets before its own plus its place in its bucket; the counts of buckets are broadcast while they are at most
``BROADCAST_ROWS`` (at 64 MB a bucket, 64 TB) and joined by a shuffle beyond.

The input should be a table that is read, not the outcome of a shuffle: a task that is repeated must meet its rows in the same order.

Defined results: a null id is a key of its own (all such rows share a shard but not a bucket); a null text has size 1 and
the checksum of no bytes; repeated rows each get a slot; an empty table gives no rows. Further columns are written along;
those named like an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, fresh_path, written

BROADCAST_ROWS = 1_000_000
MOST_PARTS = 100_000  # of the shuffle; a task takes its buckets one after another
OWN = ("size", "text_crc32", "law", "shard", "grown_shard", "bucket", "place", "slot")


def shard_of(key, n: int, seed: int):
    """The shard with the largest hash of key and shard; of equal hashes the later shard."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(n)]))["i"]


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order = np.arange(n)
    draws = rng.integers(0, np.arange(1, n + 1)) if n else []
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def buckets_of(keyed: DataFrame, n_shards: int, bucket_bytes: int) -> tuple[Column, Column, int]:
    """How many buckets the shard of a row has, from the bytes of each shard, the number of its first one, and how many there are. ``keyed``: (shard, size)."""
    total = dict(keyed.groupBy("shard").agg(F.sum("size")).collect())  # a row a shard
    counts = [max(1, -(-total.get(i, 0) // bucket_bytes)) for i in range(n_shards)]
    firsts = [sum(counts[:i]) for i in range(n_shards)]
    return F.get(F.lit(counts), F.col("shard")).cast("long"), F.get(F.lit(firsts), F.col("shard")).cast("long"), sum(counts)


def shard(docs: DataFrame, n_shards: int = 16, bucket_bytes: int = 64 << 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """All rows with shard, grown_shard (that of one shard more), bucket, place and slot; their written form is at ``path``, a folder a shard."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    key = F.col(id_col)
    docs = docs.drop(*[c for c in docs.columns if c in OWN and c not in (id_col, text_col)])
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    same = F.xxhash64(F.lit(seed + 1), key, F.col(text_col))
    rows = docs.withColumns({"size": size, "shard": shard_of(key, n_shards, seed), "grown_shard": shard_of(key, n_shards + 1, seed)})
    buckets, first_bucket, n_buckets = buckets_of(rows.select("shard", "size"), n_shards, bucket_bytes)
    hot = written(rows.groupBy(same.alias("__hot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select("__hot"), "hot-rows")
    rows = rows.withColumn("__same", same).join(few(hot, BROADCAST_ROWS), F.col("__same") == F.col("__hot"), "left") if hot.count() else rows.withColumns({"__same": same, "__hot": F.lit(None).cast("long")})
    scattered = F.when(F.col("__hot").isNull(), F.col("__same")).otherwise(F.xxhash64("__same", F.monotonically_increasing_id()))
    rows = rows.withColumn("bucket", F.pmod(scattered, buckets).cast("int")).drop("__same", "__hot").withColumn("__task", (F.pmod(first_bucket + F.col("bucket"), F.lit(MOST_PARTS))).cast("int"))
    schema = T.StructType([*rows.drop("__task").schema.fields, T.StructField("place", T.LongType())])

    def shuffled(key: tuple, table: pa.Table) -> pa.Table:
        tie = pa.chunked_array([pc.fill_null(c, "") for c in table[text_col].chunks], pa.string())
        order = pc.sort_indices(pa.table({"a": table[id_col], "b": tie}), sort_keys=[("a", "ascending"), ("b", "ascending")])
        rng = np.random.default_rng([seed, int(key[1].as_py()), int(key[2].as_py())])
        out = table.drop_columns(["__task"]).take(pa.array(order.to_numpy()[fisher_yates(len(table), rng)]))
        return out.append_column("place", pa.array(np.arange(len(table)), pa.int64()))

    dealt = rows.repartitionById(min(n_buckets, MOST_PARTS), "__task")  # a bucket a task, where a hash would give some tasks several
    placed = dealt.groupBy("__task", "shard", "bucket").applyInArrow(shuffled, schema)
    placed.sortWithinPartitions("shard", "bucket", "place").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    done = spark.read.schema(schema).parquet(path)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = done.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = written(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset")), "bucket-offsets")
    return done.join(few(offsets, BROADCAST_ROWS), ["shard", "bucket"]).withColumn("slot", F.col("__offset") + F.col("place")).drop("__offset")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard(docs).select("doc_id", "size", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
