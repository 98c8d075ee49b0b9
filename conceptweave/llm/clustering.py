"""Operator 13, centroid clustering: k-means on integer vectors, with centroids screened by the norms of blocks.

A vector of ``dims`` components is scaled and floored to integers and cut into segments of ``segment`` components. Of each segment the sum
and the squared norm are worked out once and written beside the vector: that is the compressed vector. A segment's part of an inner product is
its mean part, known from the sums, plus that of what is left, which Cauchy-Schwarz bounds by the product of both norms; so the compressed
vector and centroid give a lower bound of their distance for the price of a few numbers. Of each vector the centroid with the least bound
gets an exact integer distance, then in order of their bounds those whose bound is not above the best distance so far; the others are
pruned. A bound is lowered by far more than rounding can raise it, so no nearest centroid is ever lost; ties go to the smaller number.

Each round is a pass over the written table: tasks add up their vectors by centroid, and only those sums (a row for each centroid and
component) are shuffled and come to the driver, which holds the ``k`` centroids. Sums are exact decimals, means exact floors.

Defined results: vectors of another length, null ones and those with a null or non-finite component are left out; a null id is hashed last;
repeated rows are vectors of their own, and of rows with one id the least vector is the seed; with fewer vectors than ``k`` there are fewer
centroids; an empty table gives no rows. Components beyond 2^26 are computed with Python's integers; a distance or sum beyond a
long is null. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, tidy, written

#: Up to this size of a component, squared distances of thousands of components fit into 64 bits, and bounds into doubles.
WIDE = 1 << 26


def integers(rows: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, q): whole doubles, floor(scale * x), of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale))  # beyond that each double is whole
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, whole).alias("q")).filter("q is not null")


def compressed(vectors: DataFrame, dims: int, segment: int) -> DataFrame:
    """Adds sums and norms2 (arrays of a value for each segment) and most, the largest component's size."""
    parts = F.transform(F.sequence(F.lit(1), F.lit(dims), F.lit(segment)), lambda i: F.slice("q", i, F.lit(segment)))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    return vectors.withColumn("__parts", parts).select(
        "vec_id", "q", F.transform("__parts", lambda s: total(s, lambda x: x)).alias("sums"), F.transform("__parts", lambda s: total(s, lambda x: x * x)).alias("norms2"), F.array_max(F.transform("q", F.abs)).alias("most"))


class Screen:
    """The centroids, compressed, and the search for the nearest of a block of vectors."""

    def __init__(self, centroids: list[list[int]], segment: int) -> None:
        self.exact, self.n = centroids, len(centroids)
        self.wide = any(abs(v) > WIDE for c in centroids for v in c)
        c = np.array(centroids, float).reshape(self.n, -1)
        cuts = range(0, c.shape[1], segment)
        self.widths = np.array([min(segment, c.shape[1] - i) for i in cuts], float)
        self.c = c
        self.sums, self.norms2 = np.stack([c[:, i : i + segment].sum(1) for i in cuts], 1), np.stack([(c[:, i : i + segment] ** 2).sum(1) for i in cuts], 1)

    def _rest(self, sums: np.ndarray, norms2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms2 - sums**2 / self.widths, 0))

    def bounds(self, sums: np.ndarray, norms2: np.ndarray) -> np.ndarray:
        """No more than the squared distance of each vector to each centroid."""
        x2, c2 = norms2.sum(1)[:, None], self.norms2.sum(1)[None, :]
        inner = (sums / self.widths) @ self.sums.T + self._rest(sums, norms2) @ self._rest(self.sums, self.norms2).T
        return x2 + c2 - 2 * inner - 1e-9 * (x2 + c2) - 1

    def nearest(self, q: np.ndarray, sums: np.ndarray, norms2: np.ndarray, most: np.ndarray) -> tuple[list, list, np.ndarray]:
        """(cluster, squared distance, number of exact distances) of each row."""
        if self.wide or most.max(initial=0) > WIDE:  # rare: no bound in doubles, all distances in Python's integers
            found = [min((sum((int(a) - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(self.exact)) for x in q.tolist()]
            return [j for _, j in found], [d for d, _ in found], np.full(len(q), self.n)
        low = self.bounds(sums, norms2)
        order = np.argsort(low, axis=1, kind="stable")
        at = np.arange(len(q))
        best = order[:, 0].copy()
        distance = ((q - self.c[best]) ** 2).sum(1)
        tried = np.ones(len(q), np.int64)
        for r in range(1, self.n):
            at = at[low[at, order[at, r]] <= distance[at]]
            if not len(at):
                break
            j = order[at, r]
            d = ((q[at] - self.c[j]) ** 2).sum(1)
            tried[at] += 1
            better = (d < distance[at]) | ((d == distance[at]) & (j < best[at]))
            best[at[better]], distance[at[better]] = j[better], d[better]
        return best.tolist(), [int(d) for d in distance], tried


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            wide = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield batch, wide("q"), wide("sums"), wide("norms2"), batch.column("most").to_numpy(zero_copy_only=False)


def _sums(screen: Screen, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [[0] * dims for _ in range(screen.n)], [0] * screen.n
        for _, q, sums, norms2, most in _blocks(batches, dims):
            cluster = np.array(screen.nearest(q, sums, norms2, most)[0])
            for j in np.unique(cluster).tolist():
                own = q[cluster == j]
                part = own.sum(0).tolist() if most.max() <= WIDE else [sum(map(int, col)) for col in own.T.tolist()]
                total[j], count[j] = [a + int(b) for a, b in zip(total[j], part)], count[j] + len(own)
        rows = [(j, i, str(total[j][i]), count[j]) for j in range(screen.n) if count[j] for i in range(dims)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["cluster", "dim", "part", "n"])

    return lambda batches: tidy(run(batches))


def _assign(screen: Screen, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, q, sums, norms2, most in _blocks(batches, dims):
            cluster, distance, tried = screen.nearest(q, sums, norms2, most)
            fits = [d if d < 2**63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64()), pa.array(tried, pa.int32())], names=["vec_id", "cluster", "distance", "exact_distances"])

    return lambda batches: tidy(run(batches))


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in that order: k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [[int(v) for v in r.q] for r in vectors.select(order.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()]


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0, segment: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, exact_distances) as a written table, and the final centroids. ``exact_distances``: how many of the k were worked out."""
    spark = rows.sparkSession
    table = written(compressed(integers(rows, id_col, vec_col, dims, scale), dims, segment), "compressed-vectors")
    centroids = seeds(table, k, seed)
    if not centroids:
        drop(table)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, exact_distances int"), []
    for _ in range(rounds):
        partial = table.mapInArrow(_sums(Screen(centroids, segment), dims), "cluster int, dim int, part string, n long")
        for r in partial.groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            centroids[r.cluster][r.dim] = int(r.total) // r.n
    assigned = written(table.mapInArrow(_assign(Screen(centroids, segment), dims), "vec_id long, cluster int, distance long, exact_distances int"), "clusters")
    drop(table)
    return assigned, centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256: joined from a row for each centroid."""
    spark = assigned.sparkSession
    own = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: int(v) if v is not None and v < 2**63 else None
    total = sum(int(v or 0) for v in own.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(j, fits(s), fits(total), sha[j]) for j, s in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact_distances")


def op13_clustering(spark, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(assigned, centroids).drop("exact_distances")


def oracle(k: int = 16, rounds: int = 3) -> str:
    """All distances, in long form: (vec_id, dim, v) against (c, dim, v)."""
    kept = """kept AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
long AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(q) AS v FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < %d),
c0 AS (SELECT c, dim, v FROM long JOIN first USING (vec_id))""" % k
    steps = []
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, c, sum((l.v - m.v) * (l.v - m.v))::BIGINT AS d FROM long l JOIN c{r} m USING (dim) GROUP BY 1, 2), a{r} AS (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            mean = "(sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"m{r} AS (SELECT c, dim, ({mean})::BIGINT AS v FROM long JOIN a{r} USING (vec_id) GROUP BY 1, 2), c{r + 1} AS (SELECT c, dim, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} n USING (c, dim))")
    return f"""WITH {kept}, {', '.join(steps)},
sha AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY dim)) AS h FROM c{rounds} GROUP BY 1)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN sha USING (c)"""
