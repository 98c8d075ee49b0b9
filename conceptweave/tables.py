"""Intermediate tables in the shared folder: they cut the lineage and outlive any executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) gets one of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="conceptweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


#: Folders made within the open scopes, the innermost last.
_SCOPES: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within it are deleted at its end. Results are lazy, so what is to outlive it has to be written elsewhere within it."""
    _SCOPES.append(made := [])
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            drop_path(spark, path)


@contextmanager
def shuffled_joins(spark: SparkSession, most: int = -1) -> Iterator[None]:
    """Joins that run within it are broadcast only where they say so, or where a side has at most so many bytes. Spark takes a written table's
    compressed size for its own, and would send what is a hundred times as large to the driver."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(most))
        yield
    finally:
        for n, was in before.items():
            spark.conf.unset(n) if was is None else spark.conf.set(n, was)


def side_by_side(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """What independent steps return, in their order. Their jobs run at once: where each is small, one after the other leaves most cores idle.
    All have ended when it returns or raises what the first failed one raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written, when nothing reads them any more."""
    drop_path(spark, session_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` as a written table, and the values of aggregates that the pass which writes it has filled."""
    seen = Observation(name)
    return written(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name), seen.get


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            drop_path(t.sparkSession, folder)
