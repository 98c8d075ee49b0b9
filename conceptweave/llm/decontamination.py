"""Operator 9, benchmark decontamination: size-partitioned MinHash containment, by DataFrame functions only.

Words are runs of letters and digits in lower case; shingles are five words, and an item of fewer words is one shingle of them all. A
document with n shingles belongs to the size partition p with 2^(p-1) < n <= 2^p, whose one-permutation MinHash has 2^p bins: the hashes of
its shingles are dealt to bins by their leading bits, and each bin keeps its smallest. An item is sketched for all partitions at once: of
sorted hashes, one that is the first of its bin with p leading bits is so with more, so its row holds the least such p, one row for each
hash, and it meets the documents of that partition and all above. The density of hashes in a document's bins is at most one for any length,
and a shingle of a contained item is its bin's minimum with a probability of at least 1 - 1/e whatever the length of the document. A
document is a candidate for an item if one bin agrees. Items with fewer than ``exact_below`` shingles, where all bins could miss, are sought
among all shingles instead. Candidates are verified on the shingles' words: those that hold at least ``threshold`` of an item's different
shingles are returned. With n shingles held, all bins miss at most e^-n of the time (16 held: 1e-7).

While the items have at most ``SET_HASHES`` different hashes, documents that hold none of them are left out before anything is sorted: they
can be no candidates. Narrow rows of the item side are broadcast up to ``BROADCAST_ROWS``, which are counted first; beyond, they are joined by a shuffle.

Defined results: a text without a word, or null, takes part in no pair, nor does a document of fewer words than an item's shingle has; rows
that repeat an id give a pair once, with the most shared shingles of any of them; null ids take part; empty tables give no pairs. Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, keyed, let, written

BROADCAST_ROWS = 500_000
SET_HASHES = 20_000
SHINGLE = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes in the order of the text, repeated ones too; empty for fewer words than a shingle has."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(n >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column, size: int = SHINGLE) -> Column:
    n = F.size(w)
    texts = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(n >= size, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def bin_minima(hashes: Column, p: Column) -> Column:
    """Of sorted hashes those that come first in their bin; p: as many leading bits number the bin."""
    return F.filter(hashes, lambda h, i: first_in_bin(hashes, h, i, p))


def first_in_bin(hashes: Column, h: Column, i: Column, p: Column) -> Column:
    bin_of = lambda h: F.call_function("shiftrightunsigned", h, (F.lit(64) - p).cast("int"))
    return (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1)))


def first_bins(hashes: Column) -> Column:
    """(m, first_p) of sorted different hashes: one more than the leading bits that a hash shares with the one before it."""
    shared = lambda h, i: F.lit(64) - F.char_length(F.bin(h.bitwiseXOR(F.get(hashes, i - 1))))
    return F.transform(hashes, lambda h, i: F.struct(h.alias("m"), F.when(i == 0, F.lit(1)).otherwise(shared(h, i) + 1).alias("first_p")))


def short_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that hold all words of an item of fewer than five in order. ``items``: (item_id, w)."""
    found = None
    for (size,) in sorted(items.select(F.size("w")).distinct().collect()):  # four rows at most
        wanted = items.filter(F.size("w") == size).select("item_id", F.array_join("w", " ").alias("s"))
        held = docs.select("doc_id", F.explode(let(words(F.col("text")), lambda w: shingle_texts(w, size))).alias("s"))
        pairs = held.join(few(written(wanted, "short-items"), BROADCAST_ROWS), "s").select("doc_id", "item_id")
        found = pairs if found is None else found.union(pairs)
    return found


def contaminated(docs: DataFrame, items: DataFrame, threshold: tuple[int, int] = (4, 5), exact_below: int = 16, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of all pairs with n_shared / n_item at least ``threshold``."""
    docs = keyed(docs, id_col, text_col)
    items = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text).cast("string")).alias("w")).filter(F.size("w") > 0)
    whole = items.filter(F.size("w") >= SHINGLE)
    hashes = whole.select("item_id", F.sort_array(F.array_distinct(let(F.col("w"), lambda w: shingle_hashes(w)))).alias("h"))
    large = hashes.filter(F.size("h") >= exact_below).select("item_id", F.explode(let(F.col("h"), first_bins)).alias("s")).select("item_id", "s.m", "s.first_p")
    small = hashes.filter(F.size("h") < exact_below).select("item_id", F.explode("h").alias("m"), F.lit(0).alias("first_p"))  # 0: met by all hashes
    sketch = written(large.unionByName(small), "item-sketch")
    short = written(items.filter(F.size("w") < SHINGLE), "short-items")

    sized = docs.select("doc_id", let(words(F.col("text")), lambda w: shingle_hashes(w)).alias("h")).filter(F.size("h") > 0)
    everywhere = sketch.filter("first_p = 0").select("m").distinct()
    wanted = [r[0] for r in sketch.select("m").distinct().limit(SET_HASHES + 1).collect()]
    if len(wanted) <= SET_HASHES:
        sized = sized.filter(F.exists("h", lambda h: h.isin(wanted)))
        sought = [r[0] for r in everywhere.collect()]
        also = lambda h: h.isin(sought) if sought else F.lit(False)
    else:
        any_small = everywhere.count() > 0
        also = lambda h: F.lit(any_small)
    sized = sized.withColumn("p", F.greatest(F.lit(1), F.ceil(F.log2(F.size("h")))).cast("int"))
    marked = lambda hs: F.filter(F.transform(hs, lambda h, i: F.struct(h.alias("m"), first_in_bin(hs, h, i, F.col("p")).alias("least"))), lambda x: x["least"] | also(x["m"]))
    rows = sized.select("doc_id", "p", F.explode(let(F.sort_array("h"), marked)).alias("x")).select("doc_id", "p", "x.m", "x.least")
    pairs = rows.join(few(sketch, BROADCAST_ROWS), "m").filter("first_p = 0 or least and p >= first_p").select("doc_id", "item_id")
    candidates = written(pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items")), "leak-candidates")

    # The items' shingles go to their candidates, as they are short; a document's own are made once, where they meet.
    own = written(whole.select("item_id", let(F.col("w"), lambda w: shingle_texts(w)).alias("t")), "item-shingles")
    asked = candidates.select("doc_id", F.explode("items").alias("item_id")).join(few(own, BROADCAST_ROWS, F.size("t")), "item_id")
    asked = written(asked.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("item_id", "t")).alias("items")), "leak-items")
    asked = few(asked, BROADCAST_ROWS, F.aggregate("items", F.lit(0), lambda n, i: n + F.size(i["t"])))
    counted = lambda s: F.transform("items", lambda i: F.struct(i["item_id"].alias("item_id"), F.size(F.array_intersect(s, i["t"])).cast("long").alias("n_shared"), F.size(i["t"]).cast("long").alias("n_item")))
    held = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", F.explode(let(let(words(F.col("text")), lambda w: shingle_texts(w)), counted)).alias("x"))
    shared = held.select("doc_id", "x.item_id", "x.n_shared", "x.n_item")
    most, of = threshold
    shared = shared.filter(F.col("n_shared") * of >= F.col("n_item") * most)
    if short.count():
        shared = shared.union(short_pairs(docs, short).select("doc_id", "item_id", F.lit(1).cast("long"), F.lit(1).cast("long")))
    best = shared.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _words_sql(id_col: str, table: str) -> str:
    return f"SELECT {id_col}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}"


ORACLE = f"""
WITH dw AS ({_words_sql('doc_id', 'documents')}), bw AS (SELECT *, least(len(w), 5) AS k FROM ({_words_sql('item_id', 'benchmark')}) WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
d AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item FROM d JOIN b USING (k, s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) * 5 >= any_value(n_item) * 4"""
