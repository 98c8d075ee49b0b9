"""Scans and sinks: law documents as JSON, word lists, text corpora, gold sets, table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema


def law_documents(spark: SparkSession, path: str, urls: DataFrame | None = None) -> DataFrame:
    """Documents landed as JSON arrays; the first element of each file counts. The type is the short name up to its first space.

    ``urls`` (url, file) names each file's source; a URL that occurs twice is taken once, with its last file by name.
    """
    raw = spark.read.schema(schema.LAW_JSON).json(path, multiLine=True).withColumn("file", F.input_file_name()).withColumn("row", F.monotonically_increasing_id())
    first = raw.groupBy("file").agg(F.min_by(F.struct(*[c for c in raw.columns if c not in ("file", "row")]), "row").alias("d")).select("file", "d.*")
    if urls is not None:
        first = first.join(urls.groupBy("url").agg(F.max("file").alias("file")), "file")
    else:
        first = first.withColumn("url", F.col("file"))
    return _law_columns(first)


def fetched_laws(fetched: DataFrame) -> DataFrame:
    """Documents of the bodies (url, body) that ``http.fetch`` brought: the first element of each JSON array. Bodies that are none have null columns."""
    first = fetched.filter("body is not null").select("url", F.get(F.from_json("body", f"array<struct<{schema.LAW_JSON}>>"), F.lit(0)).alias("d"))
    return _law_columns(first.select("url", "d.*"))


def _law_columns(first: DataFrame) -> DataFrame:
    return first.select(
        F.col("id").alias("doc_id"), "url", F.col("shortName").alias("short_name"), doc_type(F.col("shortName")).alias("doc_type"), F.coalesce("popularTitle", "title").alias("name"), "title",
        F.get("metadata", F.lit(0))["displayValue"].alias("date_of_publication"), "ressort", F.col("documentHtml").alias("html"),
    )


def doc_type(short_name):
    return F.split(short_name, " ", 2)[0]


def stopwords(spark: SparkSession, path: str) -> list[str]:
    """One word per line. A list that fits a driver by its nature."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value")).filter("trim(value) <> ''").collect()]


def text_corpus(spark: SparkSession, path: str, done: DataFrame | None = None, skip: str = r"LICENSE|\.json") -> DataFrame:
    """(file, line) of all files whose name does not match ``skip`` and that are not in ``done`` (file)."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("line")).filter(~F.col("file").rlike(skip))
    return lines if done is None else lines.join(done.select("file").distinct(), "file", "left_anti")


def write_clean_text(lines: DataFrame, path: str) -> None:
    """One folder per source file; empty lines are dropped. A file that is written again replaces its folder, so a repeated job adds nothing twice."""
    lines.filter("length(line) > 0").select("file", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").text(path)


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.evaluate import normal_target

    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).toDF("query_text", "target")
    rows = rows.withColumn("target", normal_target(F.col("target")))
    order = Window.orderBy("query_text", "target")  # a hand-made list; numbered by its content, so that a second reading gives equal numbers
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("query_id"), "query_text", "target")


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A snapshot of the database: one Parquet table each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of a snapshot by name; all of them by default."""
    if names is None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = sorted(f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.isDirectory())
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_results(results: DataFrame, path: str) -> None:
    """Results of queries, by measure."""
    results.write.mode("overwrite").partitionBy("measure").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def word_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """Vectors in text form: a word and its numbers on each line; a head line of two numbers is skipped."""
    parts = F.split("value", " ")
    return spark.read.text(path).filter(F.size(parts) > 2).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("float")).alias("vec"))
