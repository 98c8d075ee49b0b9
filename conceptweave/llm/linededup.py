"""Operator 8, line dedup: content-defined chunks of lines, by DataFrame functions only.

Lines without a character above U+0020 are blank; they belong to no chunk and part none. A rolling hash goes over the hashes of each two
lines that follow one another, and the hashes choose the boundaries: one lies between two lines whose rolling hash occurs once in all
texts. What stands between two boundaries is a chunk of two lines or more: the longest stretch all of whose pairs of lines are repeated.
Boundaries depend on nothing but the lines beside them, so an inserted or changed line moves none but its own, and every passage of
two lines or more that occurs twice lies whole within a chunk wherever it occurs, however short it is and whatever stands around it. (A hash
chosen by a divisor would miss passages shorter than its chunks; the README has figures.) Within a chunk, a line that equals both lines
before it is left out.

Equal chunks are found by digests and compared byte by byte; the one with the smallest (doc_id, place) stays and the others are removed whole.
A chunk that is part of a longer one is removed too, as it is kept there. So a chunk that stays keeps all its lines, and each passage that
occurs twice is still somewhere in one piece. Passages that two different chunks share, neither of which holds the other, stay in both.

Parts are found without comparing chunks in pairs. For each power of two the hashes of windows of so many lines are made from those of
half the size. A chunk of n lines is known by n and its first and last window of the largest such size w, which cover it; wherever a
longer chunk has the same first window, its window n - w lines further on must be the same as the last. Only the lengths of chunks that begin
with a window are tried at it, so a thousand variants of a text cost their lines and lengths, not their pairs. One holder of each part,
the shortest, is compared byte by byte.

Text is moved only as far as needed: narrow lists of up to ``BROADCAST_ROWS`` rows are broadcast after they were counted, longer ones
are joined by a shuffle, whose hot keys Spark can split.

Defined results: a null text stays null; a text of one line, or empty, stays as it is; rows that repeat an id and a text
keep and lose the same chunks; rows of one id with different texts are different documents; a null id counts as the smallest; an empty
table gives no rows. Should a digest stand for two texts, none of them is removed. Blank lines within a removed chunk go with it. Further columns
are kept; those named like ``made`` (the numbers of chunks, of removed ones, of lines cut) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, few, let, written

BROADCAST_ROWS = 200_000
VISIBLE = "[^\\x00-\\x20]"
#: Windows of two to the power of 1 to TOP lines; longer chunks are known by windows of the largest size, and their bytes.
TOP = 14


def visible(text: Column) -> Column:
    """(at, line) of the lines that are not blank; ``at`` counts all lines from 1."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("at"), x.alias("line")))
    return F.filter(lines, lambda x: F.rlike(x["line"], F.lit(VISIBLE)))


def rolled(text: Column) -> Column:
    """The rolling hash of each two visible lines that follow one another."""
    neighbours = lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    return let(F.transform(visible(text), lambda x: F.xxhash64(x["line"])), neighbours)


def chunks_of(text: Column, places: Column) -> Column:
    """(place, first, last, extra, lines) of the chunks, given the sorted places of pairs that are repeated; first, last and extra number all lines."""

    def cut(seen: Column) -> Column:
        def stretches(p: Column) -> Column:
            first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
            last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
            return F.zip_with(first, last, lambda x, y: F.struct(x.alias("x"), (y + 1).alias("y")))  # a pair has its line and the next

        def chunk(r: Column) -> Column:
            def made(own: Column) -> Column:
                third = lambda x, i: (i > 1) & (F.get(own, i - 1)["line"] == x["line"]) & (F.get(own, i - 2)["line"] == x["line"])
                return F.struct(
                    r["x"].alias("place"), F.get(own, F.lit(0))["at"].alias("first"), F.element_at(own, -1)["at"].alias("last"),
                    F.transform(F.filter(own, third), lambda x: x["at"]).alias("extra"), F.transform(F.filter(own, lambda x, i: ~third(x, i)), lambda x: x["line"]).alias("lines"))

            return let(F.slice(seen, r["x"] + 1, r["y"] - r["x"] + 1), made)

        return F.transform(let(places, stretches), chunk)

    return let(visible(text), cut)


def window_hashes(lines: Column) -> Column:
    """For 0 to TOP the hashes of windows of two to that power of lines, at each place; an empty array where there are fewer lines."""

    def doubled(done: Column, k: Column) -> Column:
        x, half = F.element_at(done, -1), F.pow(F.lit(2), k - 1).cast("int")
        n = F.greatest(F.size(x) - half, F.lit(0))
        return F.concat(done, F.array(F.zip_with(F.slice(x, 1, n), F.slice(x, half + 1, n), lambda a, b: F.xxhash64(a, b))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TOP)), F.array(F.transform(lines, lambda x: F.xxhash64(x))), doubled)


def parts(chunks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(digest) of the chunks whose lines stand together in a longer chunk, and the tables that it reads. ``chunks``: (digest, n, text), a row a digest."""
    k = F.least(F.length(F.bin("n")) - 1, F.lit(TOP))
    held = chunks.withColumns({"levels": window_hashes(F.split("text", "\n", -1)), "k": k.cast("int"), "w": F.pow(F.lit(2), k).cast("int")})
    own = F.get("levels", F.col("k"))
    known = written(held.select("digest", "n", "k", F.get(own, F.lit(0)).alias("head"), F.get(own, F.col("n") - F.col("w")).alias("tail")), "line-chunks")
    windows = written(held.select("digest", "n", F.posexplode("levels").alias("k", "hashes")).filter("k > 0").select("digest", "n", "k", F.posexplode("hashes").alias("at", "hash")), "line-windows")
    wanted = known.select("k", F.col("head").alias("hash"), F.col("n").alias("short")).distinct()
    begun = windows.join(few(wanted, BROADCAST_ROWS), ["k", "hash"]).filter("short < n and at + short <= n")
    begun = begun.select("digest", "n", "k", "short", F.col("hash").alias("head"), (F.col("at") + F.col("short") - F.pow(F.lit(2), "k").cast("int")).alias("at"))
    ended = begun.join(windows.select("digest", "k", "at", F.col("hash").alias("tail")), ["digest", "k", "at"]).select("head", "tail", F.col("short").alias("n"), F.struct(F.col("n").alias("size"), F.col("digest").alias("of")).alias("holder"))
    found = ended.join(few(known.withColumnRenamed("digest", "part"), BROADCAST_ROWS), ["head", "tail", "n"]).groupBy("part").agg(F.min("holder").alias("h"))
    pairs = found.select("part", F.col("h.of").alias("holder"))
    texts = chunks.select("digest", "text")
    both = pairs.join(texts.withColumnsRenamed({"digest": "part", "text": "small"}), "part").join(texts.withColumnsRenamed({"digest": "holder", "text": "large"}), "holder")
    lines = lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    return both.filter(F.contains(lines(F.col("large")), lines(F.col("small")))).select(F.col("part").alias("digest")), [known, windows]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: tuple[str, str, str] = ("n_chunks", "n_removed", "n_cut")) -> DataFrame:
    """All rows with the text as it remains, the number of repeated chunks, how many of them were removed, and the number of lines cut."""
    text = F.col(text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    key = ["doc_id", "text_hash"]

    pairs = named.filter("text is not null").select(*key, F.posexplode(rolled(F.col("text"))).alias("place", "hash"))
    again = written(pairs.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "line-hashes")
    wanted = written(pairs.join(few(again, BROADCAST_ROWS), "hash").groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text")).agg(F.sort_array(F.collect_set("place")).alias("places")), "line-places")

    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text"))
    found = named.join(few(wanted, BROADCAST_ROWS), same).select(*key, F.explode(chunks_of(F.col("text"), F.col("places"))).alias("c"))
    found = found.select(*key, "c.place", "c.first", "c.last", "c.extra", F.size("c.lines").alias("n"), F.array_join("c.lines", "\n").alias("text"))
    found = written(found.withColumn("digest", F.xxhash64("text", "n")), "line-occurrences")
    place = F.struct(*key, "place")
    chunks = found.groupBy("digest").agg(F.min("text").alias("text"), F.max("text").alias("most"), F.first("n").alias("n"), F.min(place).alias("keeper")).filter("text = most").drop("most")
    chunks = written(chunks, "line-chunks")
    held, read = parts(chunks)
    keepers = written(chunks.select("digest", "keeper").join(held.withColumn("held", F.lit(True)), "digest", "left").select("digest", F.when(F.col("held").isNull(), F.col("keeper")).alias("keeper"), F.lit(True).alias("known")), "line-keepers")
    judged = found.drop("text").join(few(keepers, BROADCAST_ROWS), "digest", "left").withColumn("gone", F.coalesce(F.col("known") & (F.col("keeper").isNull() | ~place.eqNullSafe(F.col("keeper"))), F.lit(False)))
    cut = F.when(F.col("gone"), F.sequence("first", "last")).otherwise(F.col("extra"))
    per_doc = judged.groupBy(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__of_text")).agg(
        F.countDistinct("place").cast("int").alias("__n"), F.countDistinct(F.when(F.col("gone"), F.col("place"))).cast("int").alias("__gone"), F.flatten(F.collect_set(cut)).alias("__cut"))
    per_doc = written(per_doc, "line-removals")
    drop(again, wanted, found, chunks, keepers, *read)

    rows = docs.drop(*[c for c in made if c not in (id_col, text_col)])
    rows = rows.join(few(per_doc, BROADCAST_ROWS), F.col(id_col).eqNullSafe(F.col("__of")) & (F.xxhash64(text) == F.col("__of_text")) & text.isNotNull(), "left")
    left = lambda xs: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(xs)), F.col("__cut")), lambda i: F.get(xs, i - 1)), "\n")
    out = {text_col: F.when(F.size("__cut") > 0, let(F.split(text, "\n", -1), left)).otherwise(text), made[0]: F.coalesce("__n", F.lit(0)), made[1]: F.coalesce("__gone", F.lit(0)), made[2]: F.coalesce(F.size(F.array_distinct("__cut")), F.lit(0))}
    return rows.withColumns(out).drop("__of", "__of_text", "__n", "__gone", "__cut")


def op8_linededup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "text", "n_chunks", "n_removed", "n_cut")


#: No hashes: pairs of lines by their text, stretches of repeated ones, and chunks compared as texts.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL),
seen AS (SELECT doc_id, i, line, row_number() OVER w AS o, lead(line) OVER w AS below, coalesce(lag(line) OVER w = line AND lag(line, 2) OVER w = line, false) AS third
  FROM lines WHERE regexp_matches(line, '[^\x00-\x20]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT line, below FROM seen WHERE below IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
pairs AS (SELECT doc_id, o, o - row_number() OVER (PARTITION BY doc_id ORDER BY o) AS stretch FROM seen JOIN twice USING (line, below)),
spans AS (SELECT doc_id, min(o) AS x, max(o) + 1 AS y FROM pairs GROUP BY doc_id, stretch),
inside AS (SELECT s.doc_id, x, i, line, third, o FROM spans s JOIN seen e ON e.doc_id = s.doc_id AND o BETWEEN x AND y),
occ AS (SELECT doc_id, x, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY o) FILTER (WHERE NOT third) AS chunk FROM inside GROUP BY doc_id, x),
chunks AS (SELECT chunk, min((doc_id, x)) AS keeper FROM occ GROUP BY 1),
held AS (SELECT DISTINCT r.chunk FROM chunks r JOIN chunks s ON length(s.chunk) > length(r.chunk) AND contains(chr(10) || s.chunk || chr(10), chr(10) || r.chunk || chr(10))),
judged AS (SELECT o.*, h.chunk IS NOT NULL OR keeper <> (doc_id, x) AS gone FROM occ o JOIN chunks USING (chunk) LEFT JOIN held h ON h.chunk = o.chunk),
cut AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM judged WHERE gone UNION SELECT doc_id, i FROM inside WHERE third),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN cut USING (doc_id, i) GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS n_removed FROM judged GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text, coalesce(n_chunks, 0)::INT AS n_chunks, coalesce(n_removed, 0)::INT AS n_removed, coalesce(n_cut, 0)::INT AS n_cut
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_cut FROM cut GROUP BY 1) USING (doc_id)"""
