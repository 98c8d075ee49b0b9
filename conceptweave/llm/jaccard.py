"""Operator 3, n-gram Jaccard join: grouped prefix join, and the classes its links make.

A document's set holds 64-bit hashes of its word shingles. Equal sets are one document from the start. A set is ordered by
(count of the hash's cell in a fixed-size count sketch over all documents, hash): rare shingles first, and a total order whatever the
sketch's errors, which therefore change only the speed. Two sets as similar as asked for share a hash in their prefixes.

1. Documents with an identical prefix and size make a group; a group is one row in the buckets of its prefix's hashes.
2. In each bucket the row with the hash nearest to its front is the pivot. Rows whose size and position allow a link with the
   pivot give group pairs, which are expanded to members (as are groups in themselves) and verified on the whole sets. Linked
   documents get a common class label.
3. Buckets that still hold different labels are joined with themselves, by the parts they were split into: of the pairs that size and position allow, those in
   different classes that were not verified yet are verified now. Pairs within one class need no test, as they can't
   change it. So all links that matter are found, and a large group of near copies costs a star, not all its pairs.

Buckets of hashes whose cell counts more than ``salt_rows`` are split; the pivots of the parts are paired with each other. Classes are
found by alternating large and small stars; every round is a written table. A pivot's set meets its partners' in parts of at most
about ``chunk`` rows, so that one pivot of many near copies is spread over tasks. Hashes find the pairs; what they call a link is counted
again on words. Set sizes are counts of 64-bit hashes.

Defined results: a null text, or one without a word, has an empty set and is linked with nothing; its class is its own id. Rows
that repeat an id are one document: a link of any is a link of all. Rows with a null id link nothing; they have the class of
the documents with an equal set, or null. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, few, keyed, tidy, written

CELLS = 1 << 20
BROADCAST_ROWS = 500_000


class Shingler:
    """Sorted 64-bit shingle hashes of texts; words as ``split`` gives them."""

    def __init__(self, size: int, split) -> None:
        import xxhash

        self.size, self.split, self.hash, self.known = size, split, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.split(text) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([self.hash(b" ".join(words), len(words))], np.uint64)
        if len(self.known) > 150_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.size + 1
        x = np.zeros(n, np.uint64)
        for k in range(self.size):  # mixed at each word: sums alone would give x y y x and y x x y one hash
            x += h[k : k + n]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.unique(x ^ (x >> np.uint64(31)))


def ascii_words(text: str) -> list[bytes]:
    """A-Z in lower case; runs of other characters than space and U+0009 to U+000D."""
    return text.encode().lower().split()


def count_sketch(docs: DataFrame, size: int, split, fan_in: int = 64) -> np.ndarray:
    """How many documents hold a hash of each cell, over all documents."""
    schema = "counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, shingles = np.zeros(CELLS, np.int64), Shingler(size, split)
        for batch in batches:
            for text in batch.column(1):
                np.add.at(cells, (shingles(text.as_py()) >> np.uint64(44)).astype(np.int64), 1)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([np.minimum(cells, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                cells += np.frombuffer(x.as_py(), "<i4")
        yield pa.RecordBatch.from_pydict({"counts": pa.array([np.minimum(cells, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    rows = written(docs.mapInArrow(lambda batches: tidy(count(batches)), schema), "sketch")
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        rows = written(rows.coalesce(parts).mapInArrow(add, schema), "sketch")
    total = np.zeros(CELLS, np.int64)
    for r in rows.collect():  # one row of 4 MB
        total += np.frombuffer(r[0], "<i4")
    return total


def connected(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of the edges (a, b) reaches. Alternating large and small stars.

    The least neighbours are tables, so that they are broadcast while they are few, and a hot node's join can be split beyond; a round's
    tables are deleted once the next one's are written."""
    state = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    seen = None
    while True:
        # large star: larger neighbours of each node go to the smallest of its neighbours and itself
        both = state.union(state.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.filter("v > u").join(few(least, BROADCAST_ROWS), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")
        # small star: smaller neighbours of each node, and it, go to the smallest of them
        near = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(few(near, BROADCAST_ROWS), "u")
        after = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near).filter("u <> v").distinct(), "stars")
        drop(state, least, large, near)
        state = after
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return state.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")).union(state.select("v", "v").distinct())


def verified(docs: DataFrame, pairs: DataFrame, similar: tuple[int, int], size: int, split, chunk: int = 250) -> DataFrame:
    """Written (a, b) of those pairs whose sets are as similar. The set of an ``a`` meets those of its ``b`` in parts of about ``chunk``.

    Whole texts are shuffled, which compress to less than half of their sets of hashes, and the sets are made where they meet. Pairs
    that the hashes call similar are counted again on the shingles' words."""
    most, of = similar
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct(), "pair-ids")
    held = written(docs.join(few(ids, BROADCAST_ROWS), F.col("doc_id") == F.col("of")).select("doc_id", "text"), "pair-texts")
    parts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("long").alias("parts")), "pair-parts")
    dealt = written(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part")), "pair-parts")
    right = held.join(few(dealt, BROADCAST_ROWS), F.col("b") == F.col("doc_id")).select("a", "part", "b", "text")
    left = held.join(few(parts, BROADCAST_ROWS), F.col("a") == F.col("doc_id")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")

    def words_of(text: str) -> set[tuple]:
        words = split(text)
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}

    def alike(one: str, two: str) -> bool:
        x, y = words_of(one), words_of(two)
        shared = len(x & y)
        return of * shared >= most * (len(x) + len(y) - shared)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, shingles = None, [], Shingler(size, split)
        for batch in batches:
            found = []
            for a, part, b, text in zip(*batch.columns):
                a, part, b, text = a.as_py(), part.as_py(), b.as_py(), text.as_py()
                s = shingles(text)
                if (a, part) != key:
                    key, own = (a, part), []
                if b is None:
                    own.append((s, text))
                    continue
                for o, other in own:
                    few_, many = (s, o) if len(s) < len(o) else (o, s)
                    if len(few_) * of < most * len(many):
                        continue
                    at = np.minimum(np.searchsorted(many, few_), len(many) - 1)
                    shared = int((many[at] == few_).sum())
                    if of * shared >= most * (len(few_) + len(many) - shared) and (text == other or alike(text, other)):
                        found.append((a, b))
                        break
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    ordered = left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    links = written(ordered.mapInArrow(lambda batches: tidy(check(batches)), "a long, b long").distinct(), "links")
    drop(ids, held, parts, dealt)
    return links


def classes(docs: DataFrame, similar: tuple[int, int] = (85, 100), size: int = 4, split=ascii_words, salt_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id reachable by links, of every row."""
    spark = docs.sparkSession
    docs = keyed(docs, id_col, text_col)
    most, of = similar
    cells = spark.sparkContext.broadcast(np.minimum(count_sketch(docs, size, split), 2**31 - 1).astype(np.int32))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shingles = cells.value, Shingler(size, split)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py())
                n = len(s)
                if not n:
                    rows.append((doc_id, 0, b"", b"", [], []))
                    continue
                c = counts[(s >> np.uint64(44)).astype(np.int64)]
                front = np.argsort(c, kind="stable")[: n - -(-n * most // of) + 1]
                p = s[front]
                rows.append((doc_id, n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), hashlib.blake2b(p.tobytes(), digest_size=16).digest(), p.view(np.int64), c[front] // salt_rows + 1))
            d, n, digest, group, p, parts = zip(*rows)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "prefix_digest": pa.array(group, pa.binary()), "prefix": pa.array(p, pa.list_(pa.int64())), "parts": pa.array(parts, pa.list_(pa.int32()))})

    sized = written(docs.mapInArrow(lambda batches: tidy(prefixes(batches)), "doc_id long, n long, digest binary, prefix_digest binary, prefix array<long>, parts array<int>"), "prefixes")
    reps = written(sized.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "representatives")
    singles = sized.select("doc_id", "n", "digest", "prefix_digest").join(few(reps.withColumnRenamed("digest", "d"), BROADCAST_ROWS), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")))
    singles = singles.select("doc_id", "n", "prefix_digest").distinct()
    groups = singles.groupBy("prefix_digest", "n").agg(F.min("doc_id").alias("g"))
    members = written(singles.join(groups, ["prefix_digest", "n"]).select("g", "n", F.col("doc_id").alias("m"), "prefix_digest"), "members")

    heads = members.filter("g = m").select("g", F.col("prefix_digest").alias("d"))
    rows = sized.join(few(heads, BROADCAST_ROWS), (F.col("doc_id") == F.col("g")) & (F.col("prefix_digest") == F.col("d"))).select("g", "n", "parts", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.select("token", F.pmod(F.xxhash64("g"), F.get("parts", F.col("pos"))).cast("int").alias("part"), "pos", "n", "g", (F.get("parts", F.col("pos")) > 1).alias("split"))

    bucket_schema = pa.schema([("token", pa.int64()), ("part", pa.int32()), ("pos", pa.int32()), ("n", pa.int64()), ("g", pa.int64()), ("pivot_pos", pa.int32()), ("pivot_n", pa.int64()), ("pivot", pa.int64())])

    def shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of buckets with two groups or more, each with its bucket's first row; only one row is held between batches."""
        last = None  # the last row seen, its pivot, and whether it was given out
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]  # token, part, pos, n, g, split
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(last[0], cols)]
            token, part = cols[0], cols[1]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            pivots = [c[start] for c in (cols[2], cols[3], cols[4])]
            if last is not None:  # the first run goes on from the batch before
                for p, x in zip(pivots, last[1]):
                    p[start == 0] = x
            given = (np.bincount(start, minlength=len(token))[start] > 1) | cols[5]  # all rows of a split bucket are given: the others lie in its other parts
            out = given.copy()
            if last is not None and last[2]:
                out[0] = False  # it was given with the batch before
            last = ([c[-1] for c in cols], [p[-1] for p in pivots], bool(given[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[out], f.type) for c, f in zip([*cols[:5], *pivots], bucket_schema)], schema=bucket_schema)

    dealt = rows.repartition("token", "part").sortWithinPartitions("token", "part", "pos", "n", "g")
    shared = written(dealt.mapInArrow(shared_buckets, "token long, part int, pos int, n long, g long, pivot_pos int, pivot_n long, pivot long"), "buckets")

    def possible(n1: str, pos1: str, n2: str, pos2: str) -> Column:
        """Sizes near enough, and enough hashes left if this were the first that both hold."""
        lo, hi, rest = F.least(n1, n2), F.greatest(n1, n2), F.least(F.col(n1) - F.col(pos1), F.col(n2) - F.col(pos2))
        return (lo * of >= hi * most) & (rest * (most + of) >= (F.col(n1) + F.col(n2)) * most)

    star = shared.filter("g <> pivot").filter(possible("n", "pos", "pivot_n", "pivot_pos")).select(F.col("pivot").alias("a"), "g")
    parted = shared.select("token", "part", "pivot", "pivot_n", "pivot_pos").distinct()
    firsts = parted.groupBy("token").agg(F.min(F.struct("pivot_pos", "pivot_n", "pivot")).alias("f"), F.count("*").alias("k")).filter("k > 1").select("token", F.col("f.pivot").alias("a"), F.col("f.pivot_n").alias("an"), F.col("f.pivot_pos").alias("ap"))
    across = parted.join(firsts, "token").filter("a <> pivot").filter(possible("pivot_n", "pivot_pos", "an", "ap")).select("a", F.col("pivot").alias("g"))
    member = members.select("g", F.col("m").alias("b"))
    inside = member.filter("g <> b").select(F.col("g").alias("a"), "b")
    tested = written(star.union(across).distinct().join(member, "g").select("a", "b").union(inside).filter("a <> b").distinct(), "pairs")
    links = verified(docs, tested, similar, size, split)

    labels = written(connected(links), "labels")
    labelled = members.join(labels, F.col("m") == F.col("id"), "left").select("g", "m", F.coalesce("label", "m").alias("label"))
    of_group = written(labelled.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")), "group-labels")
    marked = shared.select("token", "part", "pos", "n", "g").join(of_group, "g")
    mixed = marked.groupBy("token").agg(F.min("lo").alias("t_lo"), F.max("hi").alias("t_hi"), (F.max("part") + 1).alias("parts")).filter("t_lo <> t_hi").select("token", "parts")
    # Parts of a split bucket meet two by two, each two (one, two) in a place of their own: a row goes to all that its part is one of.
    placed = marked.join(mixed, "token").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"one": F.least("part", "with"), "two": F.greatest("part", "with")})
    left = placed.filter("part = one")
    right = placed.filter("part = two").select("token", "one", "two", *[F.col(c).alias(f"{c}2") for c in ("pos", "n", "g", "lo", "hi")])
    differ = ~((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2")))
    group_pairs = left.join(right, ["token", "one", "two"]).filter("one < two or g < g2").filter(differ & possible("n", "pos", "n2", "pos2")).select("g", "g2").distinct()
    own = of_group.filter("lo <> hi and k > 1").select("g", F.col("g").alias("g2"))
    one, two = labelled.select("g", F.col("m").alias("a"), F.col("label").alias("la")), labelled.select(F.col("g").alias("g2"), F.col("m").alias("b"), F.col("label").alias("lb"))
    rest = group_pairs.union(own).join(one, "g").join(two, "g2").filter("a <> b and la <> lb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(rest.join(known, ["a", "b"], "left_anti"), "pairs")
    links = links.union(verified(docs, rest, similar, size, split))
    final = written(connected(links), "labels")

    ends = written(reps.join(few(final, BROADCAST_ROWS), F.col("rep") == F.col("id"), "left").select(F.col("digest").alias("d"), F.coalesce("label", "rep").alias("component")), "components")
    drop(shared, tested, rest, labels, of_group, members)
    return sized.select("doc_id", "n", "digest").join(few(ends, BROADCAST_ROWS), F.col("digest") == F.col("d"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)"""
