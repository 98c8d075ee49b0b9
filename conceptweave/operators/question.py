"""Free-text questions: their sentences, bags of words and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, sentences, tokens
from ..functions.vectors import long_form, weighted_vectors


def question_words(queries: DataFrame, vocabulary: DataFrame, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(query_id, i, word, cnt, known) of (query_id, text): the words of each sentence, those without a vector too."""
    said = queries.select("query_id", F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    words = said.select("query_id", "i", F.explode(tokens(F.col("s"), stopwords)).alias("word")).groupBy("query_id", "i", "word").agg(F.count("*").cast("double").alias("cnt"))
    known = vocabulary.select("word", F.lit(True).alias("known")).distinct()
    return words.join(known, "word", "left").select("query_id", "i", "word", "cnt", F.coalesce("known", F.lit(False)).alias("known"))


def question_bag(words: DataFrame) -> DataFrame:
    """(query_id, word, cnt, known) over the sentences that have a word with a vector; words without one stay in the bag."""
    heard = words.filter("known").select("query_id", "i").distinct()
    return words.join(heard, ["query_id", "i"], "left_semi").groupBy("query_id", "word").agg(F.sum("cnt").alias("cnt"), F.max("known").alias("known"))


def question_vectors(queries: DataFrame, words: DataFrame, idf: DataFrame, n: int, word_vectors: DataFrame) -> DataFrame:
    """(query_id, vec): the sum of the sentences' TF-IDF centroids over the number of all sentences.

    ``idf``: (word, idf) of a corpus of ``n`` texts; a word that none of them has weighs ln((n + 1) / 2). ``word_vectors``: (word, vec).
    """
    weighed = words.filter("known").join(idf.select("word", "idf"), "word", "left").withColumn("w", F.col("cnt") * F.coalesce("idf", F.log(F.lit((n + 1) / 2))))
    centroid = weighted_vectors(weighed.join(word_vectors, "word").withColumn("at", F.struct("query_id", "i")), "at", "vec", F.col("w")).filter("vec[0] is not null")
    total = weighted_vectors(centroid.select("at.query_id", "vec"), "query_id", "vec", F.lit(1.0))  # the mean over sentences with a vector
    counts = queries.select("query_id", F.size(sentences(F.col("text"))).alias("n_all")).join(centroid.groupBy("at.query_id").agg(F.count("*").alias("n_some")), "query_id")
    return total.join(counts, "query_id").select("query_id", F.transform("vec", lambda x: x * F.col("n_some") / F.col("n_all")).alias("vec"))


def long_vectors(vectors: DataFrame, digits: int = 6) -> DataFrame:
    return long_form(vectors, "query_id", digits)
