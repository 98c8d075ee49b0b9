"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage gets the table that its predecessor wrote and returns rows with the columns of ``documents``, the last one the
packed pieces. It counts as part of the subpackage ``llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptweave.llm.common import few, written
from conceptweave.llm.decontamination import contaminated
from conceptweave.llm.jaccard import classes
from conceptweave.llm.language import fit, keep_identified
from conceptweave.llm.linededup import VISIBLE, dedup_lines
from conceptweave.llm.packing import pack

BROADCAST_ROWS = 500_000
KEY = "__document"


def with_key(docs: DataFrame) -> DataFrame:
    """Documents with a key that is never null: the id, and for a null id a hash of the text above 2^62, so that it is no least id."""
    return docs.withColumn(KEY, F.coalesce(F.col("doc_id"), F.xxhash64("text").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose key is none of ``gone``'s (doc_id): by broadcast while those are few, else by a shuffle."""
    gone = written(gone.select(F.col("doc_id").alias("__of")).distinct(), "dropped")
    return docs.join(few(gone, BROADCAST_ROWS), F.col(KEY) == F.col("__of"), "left_anti").drop(KEY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language: it is trained on their own labels; texts without a letter, or of no language for the most part, go.

    Null texts go. Repeated rows stay or go together; without any label no text has a language, and all go."""
    return keep_identified(docs, fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated chunks of lines out; documents of which only blank lines are left go.

    Null texts stay. Rows that repeat an id and text keep the same lines. A column n_chars follows the text where there is one."""
    done = dedup_lines(docs, made=("__chunks", "__removed", "__lines"))
    changed = F.col("__lines") > 0
    done = done.filter(~changed | F.rlike("text", F.lit(VISIBLE)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of documents that share 0.8 of their shingles of five words.

    Of rows that repeat an id and text one stays; rows of one id with different texts are one document and stay or go together. Null ids
    are documents by their text and stay only where no document with an id is in their class. Texts without a word all stay."""
    keyed = with_key(docs)
    found = classes(keyed.drop("doc_id").withColumnRenamed(KEY, "doc_id"), similar=(80, 100), size=5)
    kept = without(keyed, found.filter("doc_id <> component_id"))
    again = written(with_key(kept).groupBy(KEY, F.xxhash64("text").alias("__text")).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(KEY).alias("__of")).distinct(), "repeated")
    if not again.count():
        return kept
    hit = F.col(KEY) == F.col("__of")
    single = with_key(kept).join(few(again, BROADCAST_ROWS), hit, "left_anti")
    several = with_key(kept).join(few(again, BROADCAST_ROWS), hit, "left_semi").dropDuplicates([KEY, "text"])
    return single.unionByName(several).drop(KEY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 of a benchmark item's shingles of five words; rows that share an id go together, null ids by their text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = with_key(docs)
    return without(keyed, contaminated(keyed, items, id_col=KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 4096 tokens; null texts are empty, null ids are kept."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", packing)]

#: The language model is not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
