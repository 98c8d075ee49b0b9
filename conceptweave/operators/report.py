"""What a dashboard shows: visual frames, travel tables, word highlights, LaTeX rows, a two-dimensional layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def highlights(words: DataFrame, key: str, idf: DataFrame, stopwords: list[str], fallback: float) -> DataFrame:
    """(key, pos, word, style, intensity) of (key, pos, word): stopwords struck through, others coloured by idf over the text's largest.

    Where at most one word of a text has an idf, ``fallback`` is the largest.
    """
    rows = words.join(idf.select("word", "idf"), "word", "left")
    own = Window.partitionBy(key)
    largest = F.when(F.count("idf").over(own) > 1, F.max("idf").over(own)).otherwise(F.lit(fallback))
    stop = F.col("word").isin(stopwords)
    return rows.select(key, "pos", "word", F.when(stop, F.lit("strike")).otherwise(F.lit("colour")).alias("style"), F.when(~stop, F.round(F.col("idf") / F.nullif(largest, F.lit(0.0)), 6)).alias("intensity"))


def travel_table(pairs: DataFrame, key: list[str], n: int) -> DataFrame:
    """The ``n`` cheapest rows of each key in order, or for a negative ``n`` the dearest."""
    order = [F.col("cost"), "input_word", "lc_word"] if n > 0 else [F.col("cost").desc(), F.col("input_word").desc(), F.col("lc_word").desc()]
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col("place") <= abs(n))


def visual_frame(results: DataFrame, pairs: DataFrame, sizes: DataFrame, n: int = 10) -> DataFrame:
    """Points of a query's picture: the query, its neighbours, and of each the ``n`` nearest and farthest words; a name once.

    ``results``: (query_id, concept_id, rank, distance); ``pairs``: (query_id, concept_id, input_word, lc_word, cost, euclid).
    """
    none = F.lit(None)
    start = results.select("query_id").distinct().select("query_id", F.lit("input").alias("name"), F.lit("Input").alias("neighbour_type"), F.lit("input").alias("point_type"), none.cast("int").alias("wordpair_rank"), F.lit(0.0).alias("distance"), none.cast("double").alias("bow_size"), F.lit(0).alias("priority"))
    near = results.join(sizes, "concept_id", "left").select("query_id", F.col("concept_id").alias("name"), F.concat("rank", F.lit(". closest")).alias("neighbour_type"), F.lit("concept").alias("point_type"), none.cast("int").alias("wordpair_rank"), "distance", F.col("bow_size").cast("double").alias("bow_size"), F.col("rank").alias("priority"))
    ranked = pairs.join(results.select("query_id", "concept_id", "rank"), ["query_id", "concept_id"])
    own = Window.partitionBy("query_id", "concept_id")
    cost = F.round("cost", 9)
    ranked = ranked.withColumns({"up": F.row_number().over(own.orderBy(cost, "input_word", "lc_word")), "down": F.row_number().over(own.orderBy(cost.desc(), "input_word", "lc_word"))}).filter((F.col("up") <= n) | (F.col("down") <= n))
    words = ranked.select("query_id", F.col("lc_word").alias("name"), F.concat("rank", F.lit(". closest")).alias("neighbour_type"), F.lit("word").alias("point_type"), F.least("up", "down").alias("wordpair_rank"), F.round("euclid", 6).alias("distance"), none.cast("double").alias("bow_size"), (F.lit(100) + F.col("rank")).alias("priority"))
    rows = start.unionByName(near).unionByName(words)
    first = F.row_number().over(Window.partitionBy("query_id", "name").orderBy("priority", "wordpair_rank", "distance"))
    return rows.withColumn("__k", first).filter("__k = 1").drop("__k", "priority")


def sorted_rows(rows: DataFrame, by: list[tuple[str, bool]]) -> DataFrame:
    """Rows by several columns (name, ascending), as a table's heads are clicked; nulls last."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in by])


def row_of(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a point by its name, as when it is clicked."""
    return rows.filter(F.col("name") == name)


def latex_row(*cells: Column) -> Column:
    escaped = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "([&%$#_{}])", r"\\$1") for c in cells]
    return F.concat(F.concat_ws(" & ", *escaped), F.lit(r" \\"))


def latex_table(rows: DataFrame, order: str, caption: str, label: str, float_format: str | None = None) -> str:
    """A table of a small frame; its rows come to the driver. ``float_format`` like ``%.2f`` is for columns of floating point."""
    floats = {f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")} if float_format else set()
    cells = [F.when(F.col(c).isNotNull(), F.format_string(float_format, F.col(c).cast("double"))) if c in floats else F.col(c) for c in rows.columns]
    body = "\n".join(r[0] for r in rows.orderBy(order).select(latex_row(*cells)).collect())
    head = " & ".join(rows.columns)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{{'l' * len(rows.columns)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}"


def stress_layout(distance: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Points in the plane whose distances come near the given ones, by majorising the weighted stress."""
    inverse = np.linalg.pinv(np.diag(weight.sum(1)) - weight)
    xy = start
    for _ in range(rounds):
        now = np.linalg.norm(xy[:, None] - xy[None, :], axis=2)
        b = -weight * np.divide(distance, now, out=np.zeros_like(now), where=now > 1e-12)
        b[np.diag_indices(len(b))] = -b.sum(1)
        xy = inverse @ (b @ xy)
    return xy


def layout(points: DataFrame, rounds: int = 60, seed: int = 42) -> DataFrame:
    """(query_id, name, x, y): points of a query, drawn so that distances in the picture come near those of their vectors; the focus is the origin.

    ``points``: (query_id, name, point_type, distance, vec). Two points are as far from one another as their vectors; a point without a vector
    has only its distance from the focus. A query has as many points as its frame, a few hundred.
    """

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name").reset_index(drop=True)
        n = len(pdf)
        rng = np.random.default_rng([seed, int(pdf["query_id"].iloc[0]) & 0xFFFFFFFF])
        want = pdf["distance"].fillna(0.0).to_numpy(float)
        dims = max((len(v) for v in pdf["vec"] if v is not None), default=0)
        there = np.array([v is not None and len(v) == dims for v in pdf["vec"]])
        vec = np.array([v if t else np.zeros(dims) for v, t in zip(pdf["vec"], there)], float).reshape(n, dims)
        gap = np.sqrt(np.maximum((vec**2).sum(1)[:, None] + (vec**2).sum(1)[None, :] - 2 * vec @ vec.T, 0))
        weight = (there[:, None] & there[None, :]).astype(float)
        for f in pdf.index[pdf["point_type"] == "input"]:  # the focus has a known distance to every point
            loose = ~there if there[f] else np.ones(n, bool)
            gap[f, loose] = gap[loose, f] = want[loose]
            weight[f, loose] = weight[loose, f] = 1
        np.fill_diagonal(weight, 0)
        xy = stress_layout(gap, weight, rng.uniform(-1, 1, (n, 2)), rounds)
        focus = pdf.index[pdf["point_type"] == "input"]
        xy -= xy[focus[0]] if len(focus) else xy.mean(0)
        return pd.DataFrame({"query_id": pdf["query_id"], "name": pdf["name"], "x": xy[:, 0], "y": xy[:, 1]})

    return points.select("query_id", "name", "point_type", "distance", "vec").groupBy("query_id").applyInPandas(place, "query_id long, name string, x double, y double")


def picture(points: DataFrame, places: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The points of a query with their coordinates, and the text (name, text) of those that have one."""
    rows = points.drop("vec").join(places, ["query_id", "name"])
    return rows.withColumn("text", F.lit(None).cast("string")) if texts is None else rows.join(texts.select("name", "text"), "name", "left")


def default_selection(neighbour_type: Column) -> Column:
    return F.contains(neighbour_type, F.lit("Input")) | F.contains(neighbour_type, F.lit("closest"))


def neighbour_options(frame: DataFrame, measure: str) -> DataFrame:
    """The neighbours of a word-mover measure, or the one row that says it is none."""
    if "wmd" not in measure and measure not in ("fwd", "rev", "fwd_idf", "rev_idf"):
        return frame.sparkSession.createDataFrame([("Not a WMD",)], "option string")
    return frame.filter("point_type = 'concept'").select(F.col("neighbour_type").alias("option")).distinct()
