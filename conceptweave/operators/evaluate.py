"""Scores of found concepts against a gold set by their distance in the containment tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_name(node: Column) -> Column:
    """The name of the node at the top, which an id ends with."""
    return F.substring_index(node, "_", -1)


def tree_distance(a: Column, b: Column, ends: tuple[Column, Column] | None = None) -> Column:
    """Steps to the longest common end of two ids, 10 if they have none. Lists of names are compared only where the last names are the same;
    ``ends``: the last names, where they have been worked out before the ids were paired."""

    def shared(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        ends = F.filter(F.sequence(F.lit(1), n), lambda k: F.slice(x, -k, k) == F.slice(y, -k, k))
        k = F.coalesce(F.array_max(ends), F.lit(0))
        return F.when(k == 0, F.lit(10)).otherwise(F.size(x) + F.size(y) - 2 * k)

    near = F.get(F.transform(F.array(F.struct(F.split(a, "_").alias("x"), F.split(b, "_").alias("y"))), lambda s: shared(s["x"], s["y"])), F.lit(0))
    of_a, of_b = ends or (last_name(a), last_name(b))
    return F.when(of_a != of_b, F.lit(10)).otherwise(near)


def tree_score(distance: Column) -> Column:
    return F.when(distance <= 3, 3 - distance).otherwise(F.lit(0))


def accuracy(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean score of each measure over all gold rows; a row without a result, or whose target is in no database, counts as zero."""
    measures = results.select("measure").distinct()
    asked = gold.select("query_id", "target").crossJoin(measures)  # a handful of measures
    first = results.filter("rank = 1").select("query_id", "measure", "concept_id")
    scored = asked.join(first, ["query_id", "measure"], "left").withColumn("score", F.coalesce(tree_score(tree_distance(F.col("target"), F.col("concept_id"))), F.lit(0)))
    return scored.groupBy("measure").agg(F.round(F.sum("score") / F.count("*"), 6).alias("accuracy"), F.count("*").alias("n"))


def normal_target(target: Column) -> Column:
    """The written-out escape of a no-break space becomes one."""
    return F.replace(target, F.lit("\\xa0"), F.lit("\u00a0"))


def with_membership(gold: DataFrame, concepts: DataFrame) -> DataFrame:
    return gold.join(concepts.select(F.col("id").alias("target"), F.lit(True).alias("__in")).distinct(), "target", "left").withColumn("in_database", F.coalesce("__in", F.lit(False))).drop("__in")
