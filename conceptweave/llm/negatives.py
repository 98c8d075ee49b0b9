"""Operator 11, hard-negative mining: a norm-bucketed search for inner products.

Components are scaled and floored to integers; a score is the integer inner product with the anchor. All vectors are sorted by their
norms, the longest first, and written as buckets: each file of the table holds up to ``bucket_rows`` vectors that follow one another
in that order, and a sparse directory keeps each bucket's greatest norm. Anchors are sorted by norm too and dealt to tasks in blocks of
at most ``block_rows``. A task goes through the directory from the longest vectors on. By Cauchy-Schwarz no score of a bucket exceeds its
greatest norm times the anchor's; so an anchor leaves the search at the first bucket where that product is below what it still
needs, and a bucket that no anchor of the block needs is not read, nor is any after it. What an anchor needs:

* first pass, positives: the score of its k-th best row of the same label so far;
* second pass, negatives: for each positive's window, the window's lower limit, or the score of its k-th best row so far if that is higher;
  of all windows the least.

A score equal to the k-th stays in the search, since of equal scores the smaller id comes first. A task holds one block of anchors
and one bucket at a time, whatever the sizes of labels and groups of equal vectors. Blocks against buckets is a stated query set (the anchors)
against all rows; no pair of rows is ever shuffled. The shared folder has to be of a kind that ``pyarrow.fs`` opens.

Defined results: rows with a null label or vector, or with any null or non-finite component, take no part; vectors of different lengths are
padded with zeros; a null id is no anchor, is last among ties and is never equal to another; rows that repeat an id are rows of their
own, but none is a positive of its own id; an anchor row that is repeated has its results repeated; an anchor without positives, and a
positive without negatives, give no row; an empty table gives no rows. Where products exceed 2^53 they are computed with Python's
integers; a score beyond a long is null. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, tidy, written

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, buckets int"
LAST = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, scale: float, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(vec_id, label, q, norm): whole doubles floor(scale * x) of the rows that take part, and their norm."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale))  # beyond that each double is whole
    cut = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.when(fine, q).alias("q")).filter("q is not null and label is not null")
    return cut.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)))


def write_buckets(vectors: DataFrame, path: str, bucket_rows: int) -> None:
    """The sorted vectors as files of at most ``bucket_rows`` rows, and the directory (file, greatest norm) of them."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("norm").desc(), F.col("vec_id").asc_nulls_last()]  # the id parts groups of equal norms
    vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", bucket_rows).option("compression", "zstd").parquet(f"{path}/buckets")
    held = spark.read.schema(vectors.schema).parquet(f"{path}/buckets")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    held.groupBy(name.alias("file")).agg(F.max("norm").alias("norm")).write.parquet(f"{path}/directory")


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers; shorter vectors end with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products, as int64, or as Python's integers where doubles do not hold them."""
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return whole(a).dot(whole(b).T)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, of equal ones the smaller id."""
    if len(scores) > 8 * k + 64 and scores.dtype != object:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
        return at[first(scores[at], ids[at], k)] if len(at) < len(scores) else np.lexsort((ids, -scores))[:k]
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    return np.lexsort((ids, -scores))[:k]


class Best:
    """The k best (score, id) of each of several searches, found so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, [[] for _ in range(n)], [[] for _ in range(n)]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        at = first(scores, ids, self.k)
        both = sorted(zip(self.scores[i] + [int(s) for s in scores[at]], self.ids[i] + ids[at].tolist()), key=lambda x: (-x[0], x[1]))[: self.k]
        self.scores[i], self.ids[i] = [s for s, _ in both], [x for _, x in both]

    def needs(self, i: int) -> float:
        return self.scores[i][-1] if len(self.scores[i]) == self.k else -math.inf


class Buckets:
    """The written buckets, as a task reads them: one at a time, the longest vectors first."""

    def __init__(self, path: str, dims: int) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(path)
        self.base, self.dims, self.pq = base, dims, pq
        known = pq.read_table(f"{base}/directory", filesystem=self.fs).to_pydict()
        self.order = sorted(zip((-n for n in known["norm"]), known["file"]))

    def scored(self, anchors: np.ndarray, norms: np.ndarray, needs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of anchors that need it, their scores, labels, ids) of each bucket that any anchor needs. ``needs`` may grow meanwhile."""
        for n, file in self.order:
            reach = -n * norms * (1 + 1e-9) + 1  # above what rounding can take away
            at = np.flatnonzero(reach >= needs)
            if not len(at):
                return
            t = self.pq.read_table(f"{self.base}/buckets/{file}", columns=["vec_id", "label", "q"], filesystem=self.fs).combine_chunks()
            q = matrix(t.column("q").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64())), self.dims)
            ids = np.array([LAST if i is None else i for i in t.column("vec_id").to_pylist()], np.int64)
            yield at, products(anchors[at], q, float(-n * norms.max() * 2)), np.array(t.column("label").to_pylist(), object), ids


def _mine(path: str, dims: int, positives: int, negatives: int, low: int, high: int, block_rows: int):
    def block(buckets: Buckets, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, norms: np.ndarray) -> list[tuple]:
        n = len(ids)
        codes = {x: i for i, x in enumerate(dict.fromkeys(labels.tolist()))}
        own = np.array([codes[x] for x in labels])
        best, needs = Best(n, positives), np.full(n, -math.inf)
        for at, scores, other, others in buckets.scored(q, norms, needs):
            kind = np.array([codes.get(x, -1) for x in other])
            fits = (kind[None, :] == own[at][:, None]) & (others[None, :] != ids[at][:, None]) & np.asarray(scores >= needs[at][:, None], bool)
            for r, i in enumerate(at.tolist()):
                hit = np.flatnonzero(fits[r])
                if len(hit):
                    best.add(i, scores[r, hit], others[hit])
                    needs[i] = best.needs(i)
        # A window for each positive: 100 * score from low to high hundredths of its own; scores are whole, so are the limits.
        windows = [(i, p, s, -(-low * s // 100), high * s // 100) for i in range(n) for p, s in zip(best.ids[i], best.scores[i])]
        of: list[list[int]] = [[] for _ in range(n)]
        for w, x in enumerate(windows):
            if x[3] <= x[4]:
                of[x[0]].append(w)
        found = Best(len(windows), negatives)
        limit = lambda i: min((max(windows[w][3], found.needs(w)) for w in of[i]), default=math.inf)
        needs, top, seen = np.array([float(limit(i)) for i in range(n)]), [max((windows[w][4] for w in of[i]), default=0) for i in range(n)], 0
        top = np.array(top, object if any(abs(x) >= 2**62 for x in top) else np.int64)
        for at, scores, other, others in buckets.scored(q, norms, needs):
            seen += 1
            kind = np.array([codes.get(x, -1) for x in other])
            fits = (kind[None, :] != own[at][:, None]) & np.asarray(scores >= needs[at][:, None], bool) & np.asarray(scores <= top[at][:, None], bool)
            for r, i in enumerate(at.tolist()):
                hit = np.flatnonzero(fits[r])
                if not len(hit):
                    continue
                near, names = scores[r, hit], others[hit]
                for w in of[i]:
                    inside = np.flatnonzero((near >= max(windows[w][3], found.needs(w))) & (near <= windows[w][4]))
                    if len(inside):
                        found.add(w, near[inside], names[inside])
                needs[i] = limit(i)
        name, fit = (lambda x: None if x == LAST else x), (lambda s: s if abs(s) < 2**63 else None)
        return [(int(ids[i]), name(p), rank + 1, name(x), fit(s), fit(y), seen) for w, (i, p, s, _, _) in enumerate(windows) for rank, (x, y) in enumerate(zip(found.ids[w], found.scores[w]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = None
        for batch in (b.slice(i, block_rows) for b in batches for i in range(0, b.num_rows, block_rows)):
            buckets = buckets or Buckets(path, dims)
            take = lambda name: batch.column(batch.schema.get_field_index(name))
            norms = take("norm").to_numpy(zero_copy_only=False)
            out = block(buckets, take("vec_id").to_numpy(zero_copy_only=False), np.array(take("label").to_pylist(), object), matrix(take("q"), dims), norms)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "buckets"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return lambda batches: tidy(run(batches))


def mine(rows: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, bucket_rows: int = 4096, block_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, buckets) as a written table.

    ``anchor``: a condition on the id; ``label``: an expression of the rows; a negative's score is from ``low`` to ``high`` hundredths of
    the positive's. ``buckets``: how many buckets the anchor's block read for its negatives."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, scale, id_col, vec_col, label)
    path = fresh_path(spark, "norm-buckets")
    write_buckets(vectors, path, bucket_rows)
    held = spark.read.schema(vectors.schema).parquet(f"{path}/buckets")
    anchors = held.filter(anchor & F.col("vec_id").isNotNull())
    dims, n = held.agg(F.max(F.size("q")), F.count_if(anchor & F.col("vec_id").isNotNull())).first()
    blocks = max(spark.sparkContext.defaultParallelism, -(-n // block_rows))
    order = [F.col("norm").desc(), "vec_id"]
    dealt = anchors.repartitionByRange(blocks, *order)
    found = written(dealt.mapInArrow(_mine(path, dims or 0, positives, negatives, low, high, block_rows), MINED), "mined")
    drop_path(spark, path)
    return found


def op11_hardnegatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label).drop("buckets")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p AS positive_id, (row_number() OVER w)::INT AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
WINDOW w AS (PARTITION BY p.a, p ORDER BY score DESC, b) QUALIFY rank <= 3"""
