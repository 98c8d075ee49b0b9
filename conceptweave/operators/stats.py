"""Corpus statistics: bags of words in long form, document frequencies, IDF, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, tokens
from ..tables import written


def word_rows(docs: DataFrame, key: str, text: str = "text", stopwords: list[str] = STOPWORDS, **options: bool) -> DataFrame:
    return docs.select(F.col(key), F.explode(tokens(F.col(text), stopwords, **options)).alias("word"))


def bag_of_words(docs: DataFrame, key: str, text: str = "text", stopwords: list[str] = STOPWORDS, **options: bool) -> DataFrame:
    """(key, word, cnt); only words that occur."""
    return word_rows(docs, key, text, stopwords, **options).groupBy(key, "word").agg(F.count("*").alias("cnt"))


def document_frequency(bow: DataFrame) -> DataFrame:
    """(word, df). ``bow`` has one row per key and word, so counting rows is counting keys."""
    return bow.groupBy("word").agg(F.count("*").alias("df"))


def inverse_frequency(df: DataFrame, n: int) -> DataFrame:
    """ln(N / (df + 1)), N the number of all texts; zero or negative for words of nearly all texts."""
    return df.withColumn("idf", F.log(F.lit(float(n)) / (F.col("df") + 1)))


def term_frequency(bow: DataFrame, key: str) -> DataFrame:
    return bow.withColumn("tf", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(key)))


def in_vocabulary(bow: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return bow.join(vocabulary.select("word").distinct(), "word", "left_semi")


def out_of_vocabulary(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The words that have no vector, once each."""
    return words.select("word").distinct().join(vocabulary.select("word"), "word", "left_anti")


def roll_up(bow: DataFrame, ancestors: DataFrame, key: str = "id") -> DataFrame:
    """Counts of each node and all below it in one pass. ``ancestors``: (key, ancestor), with each node its own ancestor."""
    return bow.join(ancestors, key).groupBy("ancestor", "word").agg(F.sum("cnt").alias("cnt")).withColumnRenamed("ancestor", key)


def roll_up_text(texts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Texts of a parent's children in order, one to a line."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return texts.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n").alias(text))


def last_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the one with the largest order columns, ties by all other columns, so that a repeated task takes the same."""
    rest = [F.col(c).desc_nulls_last() for c in rows.columns if c not in key and c not in order]
    last = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order], *rest)
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key: ``new``'s last by ``order`` (see ``last_rows``), else ``old``'s. Null keys are keys."""
    last = last_rows(new, key, order or [])
    taken = last.select(*[F.col(c).alias(f"__{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return old.join(taken, same, "left_anti").unionByName(last)


def add_documents(sentences: DataFrame, new: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Sentences (key, text, ...) with those of ``new`` in place of older ones of the same key, and the idf of them all."""
    rows = upsert(sentences, new, [key])
    return rows, idf_of(rows, key)


def idf_of(sentences: DataFrame, key: str, text: str = "text", stopwords: list[str] = STOPWORDS, **options: bool) -> DataFrame:
    """(word, df, idf) of texts in one pass: the number of texts is the frequency of a mark that each of them holds."""
    mark = F.array(F.lit(""))
    rows = sentences.select(F.explode(F.concat(F.array_distinct(F.coalesce(tokens(F.col(text), stopwords, **options), F.array().cast("array<string>"))), mark)).alias("word"))
    counts = rows.groupBy("word").agg(F.count("*").alias("df"))
    n = counts.filter("word = ''").select(F.col("df").alias("__n"))  # one row
    return counts.filter("word <> ''").join(F.broadcast(n)).select("word", "df", F.log(F.col("__n") / (F.col("df") + 1)).alias("idf"))


#: Characters of texts whose words one task counts, and words whose frequencies go to all tasks.
TASK_CHARACTERS = 4_000_000
BROADCAST_WORDS = 200_000


def common_from(words: DataFrame, most: int) -> int:
    """The least power of two so that no more than so many of the words (word, df) have that frequency."""
    sizes = {r.digits: r["count"] for r in words.groupBy(F.length(F.bin("df")).alias("digits")).count().collect()}  # 63 at most
    digits = max(sizes, default=0) + 1
    while digits > 1 and sum(n for d, n in sizes.items() if d >= digits - 1) <= most:
        digits -= 1
    return 1 << (digits - 1)


def top_terms(docs: DataFrame, key: str = "doc_id", k: int = 5, **options: bool) -> DataFrame:
    """The most characteristic words of each text by tf * idf; ties by word.

    Texts are dealt to tasks by key, and their words counted there; bags are neither shuffled nor written. Frequencies of common words go to
    all tasks; of a rarer word it is known that its frequency is less. So each word of a text has a least and a greatest score, and only words
    that can be among the first k by them are looked up by a shuffle."""
    n, characters = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    tasks = max(-(-(characters or 0) // TASK_CHARACTERS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bow = bag_of_words(docs.select(key, "text").repartition(tasks, key), key, **options)
    words = written(document_frequency(bow), "words")
    least = common_from(words, BROADCAST_WORDS)

    def score(df: Column) -> Column:
        return F.round(F.col("tf") * F.log(F.lit(float(n)) / (df + 1)), 6)

    rows = term_frequency(bow, key).join(F.broadcast(words.filter(F.col("df") >= least)), "word", "left")
    rows = rows.withColumns({"low": score(F.coalesce("df", F.lit(max(1, least - 1)))), "high": score(F.coalesce("df", F.lit(1)))})
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("low").desc())))
    rows = rows.withColumn("bound", F.max(F.when(F.col("rank") == k, F.col("low"))).over(Window.partitionBy(key)))
    kept = written(rows.filter("bound is null or high >= bound").select(key, "word", "tf", "df"), "candidates")
    rare = kept.filter("df is null").drop("df").join(words.hint("merge"), "word")  # not by its compressed size to the driver
    scored = kept.filter("df is not null").unionByName(rare).withColumn("score", score(F.col("df")))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "word")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "rank", "word", "score")
