"""The engine as a whole: take laws in, finish the base, ask questions.

A base is a dictionary of tables:

    documents  (doc_id, doc_type, short_name, name, ...)        quarantine: those of types without an extractor
    concepts   (id, name, kind, subkind, position, parents, parent_id, level, law_id, law, short_name, raw_text)
    edges      (src, dst, type, law), within laws                pending: citations of other laws (ref_no, src, law, name, need)
    sentences  (id, law_id, text)                               leaves: (id, word, cnt), words with a vector
    frequencies (word, df), the number of texts beside an empty word        oov: (word), words without a vector

``law`` is a law's short name, by which it is replaced. A base lies in a folder (``path``): each ingest writes the rows of its own laws as
an epoch of each table, then the list of those laws, which commits the epoch. Of a law the rows of its last committed epoch count, so
nothing that is there already is written again, and an ingest that fails leaves the base as it was. Document frequencies are kept as
signed counts: an epoch adds those of its texts and takes away those of the texts that it replaces. ``compact`` folds the epochs into one.

``finalise`` adds idf (word, df, idf), bow and concept_bow (id, word, cnt), the frames concept_vector, concept_bow_meanvector and
bow_meanvector (id, vec), links citations between laws into edges (src, dst, type), and leaves in pending those that found nothing. As
the base keeps all citations, one that comes again with a replaced law, or to it, is linked anew by the next call.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import STOPWORDS
from .functions.vectors import weighted_vectors
from .operators import cite, evaluate as scores, graph, question, search, stats, structure
from .sources import files
from .tables import drop, fresh_path, measured, shuffled_joins, side_by_side, written

#: Laws whose list is broadcast to pick current rows; checked by a count.
BROADCAST_LAWS = 20_000

#: Compressed bytes of what ``finalise`` and ``answer`` send to all tasks in a join without counting it first.
BROADCAST_BYTES = 256 * 1024


class Base(dict):
    """Tables by name. ``path``: where they lie; ``epoch``: the last ingest; ``metrics``: what its passes counted."""

    def __init__(self, tables: dict[str, DataFrame], path: str | None = None, epoch: int = -1, metrics: dict | None = None) -> None:
        super().__init__(tables)
        self.path, self.epoch, self.metrics = path, epoch, metrics or {}


def references(concepts: DataFrame, cues: cite.Cues = cite.EXTERNAL_CUES) -> tuple[DataFrame, DataFrame]:
    """Citations (src, dst) within laws, and pending ones (ref_no, src, law, name, need) of other laws, of the sentences among the concepts."""
    said = written(concepts.filter("kind = 'sentence'").select("id", "law_id", "parents", F.concat(F.lit(" "), F.lower("raw_text")).alias("text")), "sentences")
    law = concepts.filter("kind = 'lov'").select("law_id", F.col("id").alias("law"))
    pars = concepts.filter("kind = 'paragraf'").select("law_id", "name", "id")
    inside, outside = cite.law_citations(said, pars, cues=cues)
    whole = written(cite.whole_law_refs(said, "id", "text", cues), "whole-laws")
    own = whole.filter("internal").select("id").join(said.select("id", "law_id"), "id").join(law, "law_id").select("id", F.col("law").alias("target_id"))
    under = concepts.filter("kind = 'stk'").select(F.col("parent_id").alias("paragraph_id"), F.col("id").alias("stk_id"))
    at = F.array_min(F.filter(F.transform("parents", lambda p, i: F.when(F.startswith(p, F.lit("§")), i)), lambda i: i.isNotNull()))
    placed = said.withColumn("at", at).filter("at > 0").select("id", "text", F.concat_ws("_", F.slice("parents", F.col("at") + 1, F.size("parents"))).alias("paragraph_id"), F.concat_ws("_", F.slice("parents", F.col("at"), F.size("parents"))).alias("stk_id"))
    relative = cite.relative_refs(placed, under).select("id", F.col("target").alias("target_id"))
    parts = [cite.sibling_targets(said), cite.local_targets(said), relative, inside, own]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    outside = outside.select("id", "law", F.get("names", F.lit(0)).alias("name"), F.slice("names", F.lit(2), F.size("names")).alias("need"))
    others = whole.filter("law is not null").join(outside.select("id").distinct(), "id", "left_anti").select("id", "law", F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("need"))
    pending = outside.unionByName(others).distinct().select(F.xxhash64("id", "law", "name", "need").alias("ref_no"), F.col("id").alias("src"), "law", "name", "need")
    return every.filter("id <> target_id").select(F.col("id").alias("src"), F.col("target_id").alias("dst")).distinct(), pending


def _epoch(table: DataFrame, path: str, name: str, epoch: int) -> None:
    table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/epoch={epoch}")


def _view(spark: SparkSession, path: str, epoch: int, vocabulary: DataFrame | None) -> dict[str, DataFrame]:
    """The base's tables as of an epoch: of each law the rows of its last one."""
    read = lambda name, **o: spark.read.options(mergeSchema=name == "documents", **o).parquet(f"{path}/{name}").filter(F.col("epoch") <= epoch)
    last = read("laws").groupBy(F.col("law").alias("__law")).agg(F.max("epoch").alias("__epoch"))
    last = F.broadcast(last) if last.count() <= BROADCAST_LAWS else last.hint("merge")
    current = lambda name: read(name).join(last, F.col("law").eqNullSafe(F.col("__law")) & (F.col("epoch") == F.col("__epoch"))).drop("__law", "__epoch", "epoch")
    documents, concepts, words = current("documents").drop("law"), current("concepts"), current("words").select("id", "word", "cnt")
    frequencies = read("frequencies").groupBy("word").agg(F.sum("df").alias("df")).filter("df > 0")
    return {
        "documents": documents, "quarantine": documents.filter(structure.dialect(F.col("doc_type")) == "quarantine"), "concepts": concepts, "edges": current("edges"),
        "pending": current("pending").drop("law").withColumnRenamed("cited", "law"), "sentences": concepts.filter("kind = 'sentence'").select("id", "law_id", F.col("raw_text").alias("text")), "frequencies": frequencies,
        "leaves": words if vocabulary is None else stats.in_vocabulary(words, vocabulary), "oov": words.select("word").limit(0) if vocabulary is None else stats.out_of_vocabulary(words, vocabulary), "words": words,
    }


def ingest(laws: DataFrame, vocabulary: DataFrame | None = None, stopwords: list[str] = STOPWORDS, base: Base | None = None, path: str | None = None, order: list[str] | None = None, cues: cite.Cues = cite.EXTERNAL_CUES) -> Base:
    """A base of the laws (doc_id, doc_type, short_name, html, ...), with those of ``base`` that they do not replace.

    Laws are replaced as a whole by short name. Of several editions of a law in one batch the one with the greatest ``order`` columns counts,
    ties by the other columns. ``vocabulary``: (word), the words that have a vector; without it all words count as such. ``path``: the folder of
    a new base, a fresh one by default. ``cues``: names of laws in texts, with the laws' short names. Only the batch is read and written, and of the base the words of the laws that it replaces.
    """
    spark = laws.sparkSession
    with shuffled_joins(spark):
        if base is not None and base.path is None:
            base = _adopted(spark, base)
        path, epoch = (base.path, base.epoch + 1) if base is not None else (path or fresh_path(spark, "base"), 0)
        kind = structure.dialect(F.col("doc_type"))
        taken, seen = measured(stats.last_rows(laws, ["short_name"], order or []), "laws", laws=F.count("*"), quarantined=F.count_if(kind == "quarantine"))
        blocks = written(structure.law_blocks(taken), "blocks")
        names = taken.join(blocks.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("short_name").alias("law_name"))
        nodes = structure.concept_rows(blocks, names).join(names.select(F.col("doc_id").alias("law_id"), F.col("law_name").alias("law")), "law_id")
        concepts, counted = measured(nodes, "concepts", concepts=F.count("*"), sentences=F.count_if(F.col("kind") == "sentence"))
        said = concepts.filter("kind = 'sentence'").select("id", "law", F.col("raw_text").alias("text"))
        counting = said.select("id", "law", F.explode(stats.tokens(F.col("text"), stopwords)).alias("word")).groupBy("id", "law", "word").agg(F.count("*").cast("double").alias("cnt"))
        (refs, pending), words = side_by_side(spark, lambda: references(concepts, cues), lambda: written(counting, "words"))
        law_of = concepts.select(F.col("id").alias("src"), "law")
        edges = graph.containment_edges(concepts).unionByName(graph.reference_edges(refs, concepts).select("src", "dst", "type")).join(law_of, "src").select("src", "dst", "type", "law")

        counts = lambda rows, n, sign: rows.groupBy("word").agg((F.lit(sign) * F.count("*")).alias("df")).unionByName(n.agg((F.lit(sign) * F.count("*")).alias("df")).select(F.lit("").alias("word"), "df"))
        delta = counts(words, said, 1)
        if base is not None:
            replaced = taken.select(F.col("short_name").alias("__new"))
            old = base["concepts"].filter("kind = 'sentence'").join(replaced, F.col("law").eqNullSafe(F.col("__new")), "left_semi").select("id")
            delta = delta.unionByName(counts(base["words"].join(old, "id", "left_semi"), old, -1))
        rows = {"documents": taken.drop("html").withColumn("law", F.col("short_name")), "concepts": concepts, "edges": edges, "pending": pending.withColumnRenamed("law", "cited").join(law_of, "src"), "words": words}
        rows["frequencies"] = delta.groupBy("word").agg(F.sum("df").alias("df")).filter("df <> 0 or word = ''")
        side_by_side(spark, *[partial(_epoch, table, path, name, epoch) for name, table in rows.items()])
        _epoch(taken.select(F.col("short_name").alias("law")), path, "laws", epoch)  # from here on the epoch counts
        drop(taken, blocks, concepts, words)
    return Base(_view(spark, path, epoch, vocabulary), path, epoch, {**seen, **counted})


def _adopted(spark: SparkSession, base: dict[str, DataFrame]) -> Base:
    """A base that was loaded from a snapshot, in a folder of its own, so that laws can be added to it."""
    path = fresh_path(spark, "base")
    law_of = base["concepts"].select(F.col("id").alias("src"), "law")
    rows = {"documents": base["documents"].withColumn("law", F.col("short_name")), "concepts": base["concepts"], "words": base["words"].join(law_of.withColumnRenamed("src", "id"), "id")}
    rows |= {"edges": base["own_edges"] if "own_edges" in base else base["edges"], "pending": base["citations" if "citations" in base else "pending"].withColumnRenamed("law", "cited").join(law_of, "src"), "frequencies": base["frequencies"], "laws": base["documents"].select(F.col("short_name").alias("law"))}
    with shuffled_joins(spark):
        for name, table in rows.items():
            _epoch(table, path, name, 0)
    return Base(_view(spark, path, 0, None), path, 0)


def compact(base: Base, spark: SparkSession, vocabulary: DataFrame | None = None) -> Base:
    """The base folded into one epoch of a new folder, without replaced rows; the old folder can go once nothing reads it."""
    return Base(_view(spark, (new := _adopted(spark, base)).path, 0, vocabulary), new.path, 0)


def linked(base: Base) -> Base:
    """The base with the citations between its laws as edges; pending keeps those that found nothing, missing the edges that lead nowhere.

    All citations are linked, whatever an earlier call has found, so a law that was replaced loses and gets its edges like any other."""
    own, citations = (base[k] if k in base else base[other] for k, other in (("own_edges", "edges"), ("citations", "pending")))
    spark = base["concepts"].sparkSession
    nodes = written(base["concepts"], "concepts")
    links, pending = cite.link_deferred(citations, nodes.select("id", F.col("law").alias("law_id"), "name", "parents"))
    there = links.distinct().select("src", "dst", F.lit("ref_to").alias("type"))
    edges = own.select("src", "dst", "type").unionByName(there).unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("ref_from").alias("type")))
    with shuffled_joins(spark):
        pruned = written(graph.prune(edges, nodes), "edges")
    made = {"own_edges": own, "citations": citations, "concepts": nodes, "edges": pruned, "pending": pending, "missing": graph.missing_neighbours(edges, nodes)}
    return Base({**base, **made}, base.path, base.epoch)


def finalise(base: Base, word_vectors: DataFrame, threshold: float = 0.1, theta: float = 0.08, max_sweeps: int = 50) -> tuple[Base, dict[str, list[dict]]]:
    """The base with roll-ups, linked citations, smoothed vectors and bags, and reports of both loops. ``word_vectors``: (word, vec)."""
    with shuffled_joins(base["concepts"].sparkSession, BROADCAST_BYTES):
        return _finalised(base, word_vectors, threshold, theta, max_sweeps)


def _finalised(base: Base, word_vectors: DataFrame, threshold: float, theta: float, max_sweeps: int) -> tuple[Base, dict[str, list[dict]]]:
    base = linked(base)
    nodes, edges = base["concepts"], base["edges"]
    spark = nodes.sparkSession
    leaves, n, texts = side_by_side(spark, lambda: written(base["leaves"], "leaves"), lambda: texts_of(base), lambda: written(rolled_text(nodes), "texts"))
    idf, bow = side_by_side(
        spark, lambda: written(stats.inverse_frequency(base["frequencies"].join(leaves.select("word").distinct(), "word", "left_semi"), n), "idf"),
        lambda: written(stats.roll_up(leaves, graph.ancestors(nodes)).select("id", "word", "cnt"), "bow"),
    )
    linked_laws = written(graph.linked_roots(nodes, edges, bow, law_of_id), "linked-laws")
    vectors = word_vectors.select("word", "vec")

    def centroids(bag: DataFrame) -> DataFrame:
        return weighted_vectors(bag.join(idf.select("word", "idf"), "word").join(vectors, "word"), "id", "vec", F.col("cnt") * F.col("idf")).filter("vec[0] is not null")

    def smoothed() -> tuple[DataFrame, list[dict]]:
        start = written(centroids(bow).join(nodes.select("id", "level"), "id").select("id", "level", "vec"), "centroids")
        return graph.propagate_roots(start, edges, law_of_id, linked_laws, nodes.count(), threshold, max_sweeps, written)

    def diffused() -> tuple[DataFrame, list[dict], DataFrame]:
        spread, sweeps = graph.diffuse_roots(bow, edges, idf, law_of_id, linked_laws, bow.count(), max_sweeps, written, theta)
        return spread, sweeps, written(centroids(spread), "frame")

    (smooth, moves), (spread, sweeps, frame), means = side_by_side(spark, smoothed, diffused, lambda: written(weighted_vectors(bow.join(vectors, "word"), "id", "vec", F.col("cnt")).filter("vec[0] is not null"), "frame"))
    frames = {"concept_vector": smooth.select("id", "vec"), "concept_bow_meanvector": frame, "bow_meanvector": means}
    return Base({**base, **frames, "idf": idf, "bow": bow, "concept_bow": spread, "texts": texts}, base.path, base.epoch), {"propagate": moves, "diffuse": sweeps}


def law_of_id(node: str) -> Column:
    """The end of an id, which all concepts of a law share: its short name, or what follows the last ``_`` in it."""
    return F.substring_index(node, "_", -1)


def texts_of(base: dict[str, DataFrame]) -> int:
    """The number of sentences, as the frequencies keep it."""
    row = base["frequencies"].filter("word = ''").first()
    return int(row.df) if row else 0


def rolled_text(nodes: DataFrame) -> DataFrame:
    """(id, text): the sentences of each node and all below it, a line each, in their order in the law: by number at each level, an element's own sentences first."""
    place = F.transform(F.reverse(F.concat(F.array("name"), F.slice("parents", 1, F.size("parents")))), lambda x: F.struct((~F.endswith(x, F.lit(" pkt."))).alias("deeper"), F.regexp_extract(x, "([0-9]+)", 1).try_cast("long").alias("k"), x.alias("x")))
    said = nodes.filter("kind = 'sentence'").select("id", "parents", "name", place.alias("place"), "raw_text")
    up = said.join(graph.ancestors(nodes), "id").groupBy("ancestor").agg(F.array_sort(F.collect_list(F.struct("place", "raw_text"))).alias("rows"))
    return up.select(F.col("ancestor").alias("id"), F.array_join(F.transform("rows", lambda r: r["raw_text"]), "\n").alias("text"))


def answer(base: Base, word_vectors: DataFrame, queries: DataFrame, k: int = 3, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(query_id, measure, rank, concept_id, distance) of all ten measures for each of the queries (query_id, text), in one go.

    Query words without a vector take part in no distance; ``question.question_bag`` names them. What is asked in the same words is sought once.
    The answers are written here, since joins that ran later would be broadcast by the session's limit."""
    with shuffled_joins(queries.sparkSession, BROADCAST_BYTES):
        return written(_answered(base, word_vectors, queries, k, stopwords), "answers")


def _answered(base: Base, word_vectors: DataFrame, queries: DataFrame, k: int, stopwords: list[str]) -> DataFrame:
    said = queries.groupBy("query_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    first = said.groupBy("texts").agg(F.min("query_id").alias("asked_by"))
    askers = written(said.join(first, "texts").select("query_id", "asked_by"), "askers")
    queries = queries.join(askers.filter("query_id = asked_by").select("query_id"), "query_id", "left_semi")
    vectors = word_vectors.select("word", "vec")
    words = written(question.question_words(queries, vectors, stopwords), "question-words")
    asked = written(question.question_vectors(queries, words, base["idf"], texts_of(base), vectors), "question-vectors").withColumnRenamed("vec", "query_vec")
    numbered = vectors.withColumn("vec_id", F.col("word"))
    share = lambda bag, key: stats.term_frequency(bag.join(vectors.select("word"), "word", "left_semi"), key).select(F.col(key), "word", F.col("tf").alias("p"), F.col("word").alias("vec_id"))
    q = written(share(question.question_bag(words).filter("known").select("query_id", "word", "cnt"), "query_id"), "query-words")
    def concept_words(name: str) -> DataFrame:
        return written(share(base[name], "id").withColumnRenamed("id", "concept_id").join(base["idf"].select("word", "idf"), "word"), "concept-words")

    bow, concept_bow, tree = side_by_side(vectors.sparkSession, lambda: concept_words("bow"), lambda: concept_words("concept_bow"), lambda: written(base["concepts"].select(F.col("id").alias("concept_id"), "parent_id", "level"), "tree"))
    bags = {"bow": bow, "concept_bow": concept_bow}
    levels = (tree.agg(F.max("level")).first()[0] or 0) + 1
    frames = {name: base[name].select(F.col("id").alias("concept_id"), "vec") for name in ("concept_vector", "concept_bow_meanvector")}
    found = search.measures(q, tree, bags, numbered.select("vec_id", "vec"), asked, frames, levels, written, k)
    return found.withColumnRenamed("query_id", "asked_by").join(askers, "asked_by").select("query_id", "measure", "rank", "concept_id", "distance")


def evaluate(base: dict[str, DataFrame], word_vectors: DataFrame, gold: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """A gold set (query_id, query_text, target) asked of the base: (measure, accuracy, n), and (query_id, measure, concept_id, distance, target,
    in_database, steps, score) of each query's best concept by each measure; where it found none, these are null and the score is zero."""
    asked = gold.select("query_id", F.col("query_text").alias("text"))
    found = answer(base, word_vectors, asked, k)
    known = scores.with_membership(gold.select("query_id", "target"), base["concepts"])
    measured_by = known.crossJoin(F.broadcast(found.select("measure").distinct()))  # ten at most
    rows = measured_by.join(found.filter("rank = 1").drop("rank"), ["query_id", "measure"], "left").withColumn("steps", scores.tree_distance(F.col("target"), F.col("concept_id")))
    rows = rows.withColumn("score", F.coalesce(scores.tree_score(F.col("steps")), F.lit(0)))
    return scores.accuracy(found, gold), rows.select("query_id", "measure", "concept_id", "distance", "target", "in_database", "steps", "score")


def save(base: Base, path: str) -> None:
    files.save_tables(base, path)


def load(spark: SparkSession, path: str) -> Base:
    """A snapshot; the first ingest into it writes it to a folder of its own."""
    return Base(files.load_tables(spark, path))
