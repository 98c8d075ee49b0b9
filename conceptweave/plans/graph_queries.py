"""Queries of the graph, vector, search, citation, evaluation and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import EXTERNAL_CUES, RELATIVE_CUES, WHOLE_LAW_CUES
from ..functions.text import quoted, sentences_sql, tokens, tokens_sql
from ..functions.vectors import long_form, looked_up_vectors, on_axes, principal_axes
from ..operators import cite, evaluate, graph, question, report, search, stats
from ..tables import shuffled_joins, written
from .base import CONV, Conversations, Tree, centroid_sql, query, table, vec_id_sql, word_vec_id


# Tree and roll-up


@query("containment_edges", f"WITH {CONV} SELECT src, dst, CASE WHEN length(src) > length(dst) THEN 'parent' ELSE 'child' END AS type FROM edges")
def containment_edges(spark, sf):
    return Tree(spark, sf).edges


@query("rollup_bow", f"WITH {CONV} SELECT id, word, cnt FROM cbow")
def rollup_bow(spark, sf):
    return Conversations(spark, sf).bow.select("id", "word", "cnt")


@query("missing_neighbours", f"WITH {CONV} SELECT src, dst, 'ref_to' AS type FROM (SELECT 'C' || (conv_id + 7) AS dst, 'C' || conv_id AS src FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE dst NOT IN (SELECT id FROM nodes)")
def missing_neighbours(spark, sf):
    c = Tree(spark, sf)
    refs = c.nodes.filter("level = 0").select(F.col("id").alias("src"), F.concat(F.lit("C"), (F.substring("id", 2, 20).cast("long") + 7).cast("string")).alias("dst"), F.lit("ref_to").alias("type"))
    return graph.missing_neighbours(refs, c.nodes)


@query("reference_edges", f"""WITH {CONV}, r AS (SELECT 'C' || conv_id AS src, 'C' || (conv_id + 7) AS dst FROM (SELECT DISTINCT conv_id FROM conversations)), k AS (SELECT r.*, id IS NOT NULL AS known FROM r LEFT JOIN nodes ON dst = id)
SELECT src, dst, CASE WHEN known THEN 'ref_to' ELSE 'ref_to_UNKNOWN' END AS type FROM k UNION ALL SELECT dst, src, 'ref_from' FROM k WHERE known""")
def reference_edges(spark, sf):
    c = Tree(spark, sf)
    refs = c.nodes.filter("level = 0").select(F.col("id").alias("src"), F.concat(F.lit("C"), (F.substring("id", 2, 20).cast("long") + 7).cast("string")).alias("dst"))
    return graph.reference_edges(refs, c.nodes).select("src", "dst", "type")


# Vectors


@query("sentence_mean_vec", f"""WITH {CONV} SELECT id, dim::INT AS dim, round(sum(x * cnt) / sum(cnt), 6) AS value FROM
(SELECT id, cnt, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM leaf JOIN embeddings ON vec_id = {vec_id_sql('word')}) GROUP BY 1, 2""")
def sentence_mean_vec(spark, sf):
    c = Conversations(spark, sf)
    return long_form(c.means(c.leaves, F.col("cnt")), "id", 6)


@query("bow_mean_vec", f"""WITH {CONV} SELECT id, dim::INT AS dim, round(sum(x * cnt) / sum(cnt), 6) AS value FROM
(SELECT id, cnt, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM cbow JOIN embeddings ON vec_id = {vec_id_sql('word')}) GROUP BY 1, 2""")
def bow_mean_vec(spark, sf):
    c = Conversations(spark, sf)
    return long_form(c.means(c.bow, F.col("cnt")), "id", 6)


@query("tfidf_centroid", f"WITH {CONV} SELECT id, dim::INT AS dim, round(value, 6) AS value FROM ({centroid_sql('cbow')})")
def tfidf_centroid(spark, sf):
    return long_form(Conversations(spark, sf).centroids(), "id", 6)


FRAME_DIMS = 64  # of the given vectors


@query("vector_frame", f"WITH {CONV}, c AS ({centroid_sql('cbow')}), v AS (SELECT id, list(value ORDER BY dim) AS v FROM c GROUP BY 1) SELECT id, level, parent_id, {', '.join(f'round(v[{i}], 6) AS dim_{i}' for i in range(1, FRAME_DIMS + 1))} FROM nodes JOIN v USING (id)")
def vector_frame(spark, sf):
    c = Conversations(spark, sf)
    return c.nodes.join(c.centroids(), "id").select("id", "level", "parent_id", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"dim_{i + 1}") for i in range(FRAME_DIMS)])


@query("frame_pca")
def frame_pca(spark, sf):
    """The centroids on their two principal components; tested against a plain decomposition. What is averaged are the words' places on the axes."""
    c = Conversations(spark, sf)
    axes = principal_axes(c.centroids())
    if not len(axes):
        return c.bow.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    placed = looked_up_vectors(c.with_vec_id(c.bow), on_axes(c.vectors, "vec_id", axes), "vec_id", "id", F.col("cnt") * F.col("idf")).filter("vec[0] is not null")
    return placed.select("id", F.round(F.get("vec", F.lit(0)), 6).alias("x"), F.round(F.get("vec", F.lit(1)), 6).alias("y"))


# The queries are the benchmark's texts; words without a vector stay in their bags, take no part in distances, and are reported by oov_words.
QSQL = f"""
qsent AS (SELECT item_id AS id, unnest(range(0, len({sentences_sql('text')}))) AS i, unnest({sentences_sql('text')}) AS s FROM benchmark),
qtok AS (SELECT id, i, unnest({tokens_sql('s')}) AS word FROM qsent),
qsw AS (SELECT id, i, word, count(*)::DOUBLE AS cnt, word IN (SELECT word FROM voc) AS known FROM qtok GROUP BY 1, 2, 3),
qall AS (SELECT id, word, sum(cnt) AS cnt, bool_or(known) AS known FROM qsw SEMI JOIN (SELECT DISTINCT id, i FROM qsw WHERE known) USING (id, i) GROUP BY 1, 2),
qbow AS (SELECT id, word, cnt FROM qall WHERE known)"""


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def question_words(spark, sf, c):
    return question.question_words(questions(spark, sf), c.vocabulary)


def known_bag(spark, sf, c):
    return question.question_bag(question_words(spark, sf, c)).filter("known").select(F.col("query_id").alias("id"), "word", "cnt")


@query("query_bow", f"WITH {CONV}, {QSQL} SELECT id AS query_id, word, cnt, known FROM qall")
def query_bow(spark, sf):
    return question.question_bag(question_words(spark, sf, Conversations(spark, sf)))


# idf of a word that no text of the corpus has: ln((N + 1) / 2)
QVEC = f"""qsv AS (SELECT id, i, dim, sum(x * w) / nullif(sum(w), 0) AS value FROM
  (SELECT id, i, cnt * coalesce(idf, ln(((SELECT count(*) FROM csent)::DOUBLE + 1) / 2)) AS w, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x
   FROM qsw LEFT JOIN cidf USING (word) JOIN embeddings ON vec_id = {vec_id_sql('word')} WHERE known) GROUP BY 1, 2, 3),
qv AS (SELECT id, dim, sum(value) / any_value(n) AS value FROM qsv JOIN (SELECT id, count(*) AS n FROM qsent GROUP BY 1) USING (id) GROUP BY 1, 2)"""


def question_vectors(spark, sf, c):
    words = written(question_words(spark, sf, c), "question-words")
    vectors = c.with_vec_id(words.select("word").distinct()).join(c.vectors, "vec_id").select("word", "vec")
    return question.question_vectors(questions(spark, sf), words, c.idf, c.n, vectors)


@query("query_vec", f"WITH {CONV}, {QSQL}, {QVEC} SELECT id AS query_id, dim::INT AS dim, round(value, 6) AS value FROM qv")
def query_vec(spark, sf):
    return question.long_vectors(question_vectors(spark, sf, Conversations(spark, sf)))


KNN = """k AS (SELECT query_id, concept_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, concept_id) AS rank FROM
  (SELECT q.id AS query_id, v.id AS concept_id, round(sqrt(sum((q.value - v.value) * (q.value - v.value))), 6) AS distance FROM qv q JOIN v ON q.dim = v.dim GROUP BY 1, 2))"""


def knn(spark, sf, c, vectors):
    q = question_vectors(spark, sf, c).withColumnRenamed("vec", "query_vec")
    return search.nearest(q, vectors.select(F.col("id").alias("concept_id"), "vec"))


@query("knn10", f"WITH {CONV}, {QSQL}, {QVEC}, v AS (SELECT * FROM ({centroid_sql('cbow')}) WHERE value IS NOT NULL), {KNN} SELECT query_id, concept_id, rank::INT AS rank, distance FROM k WHERE rank <= 10")
def knn10(spark, sf):
    c = Conversations(spark, sf)
    return knn(spark, sf, c, c.centroids().filter("vec[0] is not null"))


# Relaxed word-mover distance of every benchmark text to every turn

WORDS = f"q AS (SELECT id AS query_id, word AS input_word, cnt / sum(cnt) OVER (PARTITION BY id) AS pq, {vec_id_sql('word')} AS va FROM qbow)"


def bag_sql(bag: str = "cbow", t: str = "") -> str:
    """The words of the concepts' bags, and the distances of the queries' words to them."""
    return f"""c{t} AS (SELECT id AS concept_id, word AS lc_word, cnt / sum(cnt) OVER (PARTITION BY id) AS pc, {vec_id_sql('word')} AS vb, idf FROM {bag} JOIN cidf USING (word)),
d{t} AS (SELECT a.vec_id AS va, b.vec_id AS vb, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM (SELECT * FROM embeddings SEMI JOIN q ON vec_id = va) a CROSS JOIN (SELECT * FROM embeddings SEMI JOIN c{t} ON vec_id = vb) b)"""


WSQL = f"{WORDS}, {bag_sql()}"


def pairs_sql(name: str, candidates: str, t: str = "") -> str:
    return f"{name} AS (SELECT query_id, concept_id, input_word, lc_word, d AS euclid, pq * pc AS weight, d * (pq * pc) AS cost, idf FROM {candidates} JOIN q USING (query_id) JOIN c{t} USING (concept_id) JOIN d{t} USING (va, vb))"


def chosen_sql(measure: str, pairs: str) -> str:
    own, other = ("input_word", "lc_word") if measure.startswith("fwd") else ("lc_word", "input_word")
    by = "idf" if measure.endswith("_idf") else "1.0::DOUBLE"
    return f"""(SELECT query_id, concept_id, {own}, m.o AS {other}, m.k AS cost, m.w AS weight, m.e AS euclid FROM
  (SELECT query_id, concept_id, {own}, min(struct_pack(c := floor(cost * {by} * 1e10 + 0.5), o := {other}, k := cost * {by}, w := weight * {by}, e := euclid)) AS m FROM {pairs} GROUP BY 1, 2, 3))"""


def wmd_sql(measure: str, pairs: str) -> str:
    return f"(SELECT query_id, concept_id, round(sum(cost) / nullif(round(sum(weight), 12), 0), 6) AS distance FROM {chosen_sql(measure, pairs)} GROUP BY 1, 2 HAVING nullif(round(sum(weight), 12), 0) IS NOT NULL)"


TURNS = "(SELECT DISTINCT query_id, concept_id FROM (SELECT DISTINCT query_id FROM q), (SELECT id AS concept_id FROM nodes WHERE level = 1))"
WMD = f"WITH {CONV}, {QSQL}, {WSQL}, {pairs_sql('p', TURNS)}"


def wmd_inputs(spark, sf, c, level=None):
    """Words of the queries and of the concepts, of one level or of all."""
    q = c.with_vec_id(stats.term_frequency(known_bag(spark, sf, c), "id")).select(F.col("id").alias("query_id"), "word", F.col("tf").alias("p"), "vec_id")
    return written(q, "query-words"), concept_words(c, c.bow if level is None else c.bow.filter(F.col("level") == level))


def concept_words(c, bag):
    """(block, concept_id, word, p, vec_id, idf) of a bag in the form of ``Conversations.bow``."""
    rows = c.with_vec_id(stats.term_frequency(bag, "id"))
    return written(rows.select("block", F.col("id").alias("concept_id"), "word", F.col("tf").alias("p"), "vec_id", "idf"), "concept-words")


def turn_scores(spark, sf, c, measure):
    q, con = wmd_inputs(spark, sf, c, 1)
    return q, con, search.wmd_scores(q, con, c.vectors, (measure,)).drop("measure")


def _wmd(measure):
    @query(f"rwmd_{measure}", f"{WMD} SELECT * FROM {wmd_sql(measure, 'p')}")
    def run(spark, sf):
        return turn_scores(spark, sf, Conversations(spark, sf), measure)[2]


for _m in search.MEASURES:
    _wmd(_m)


@query("wmd_top3", f"{WMD} SELECT query_id, concept_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, concept_id DESC)::INT AS rank FROM {wmd_sql('fwd', 'p')} QUALIFY rank <= 3")
def wmd_top3(spark, sf):
    return search.top(turn_scores(spark, sf, Conversations(spark, sf), "fwd")[2])


TOP = f"t3 AS (SELECT query_id, concept_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, concept_id DESC)::INT AS rank FROM {wmd_sql('fwd', 'p')} QUALIFY rank <= 3)"
TRAVEL = f"{WMD}, {TOP}, tp AS (SELECT s.* FROM {chosen_sql('fwd', 'p')} s SEMI JOIN t3 USING (query_id, concept_id))"


def travel(spark, sf, c=None):
    """The best turns of each query, and the partners of its words in them: only these pairs of texts get a row for each word."""
    c = c or Conversations(spark, sf)
    q, con, scores = turn_scores(spark, sf, c, "fwd")
    best = written(search.top(scores), "best")
    con = written(con.drop("block").join(best.select("concept_id").distinct(), "concept_id", "left_semi"), "best-words")
    return best, search.selected(q, con, search.distance_tables(c.vectors, q, con, written), "fwd", best.select("query_id", "concept_id"))


@query("travel_pairs", f"{TRAVEL} SELECT query_id, concept_id, input_word, lc_word, round(cost, 9) AS cost, round(euclid, 6) AS euclid FROM tp")
def travel_pairs(spark, sf):
    return travel(spark, sf)[1].select("query_id", "concept_id", "input_word", "lc_word", F.round("cost", 9).alias("cost"), F.round("euclid", 6).alias("euclid"))


ROUNDED = "tr AS (SELECT query_id, concept_id, input_word, lc_word, round(cost, 9) AS cost FROM tp)"


def _travel_table(name, n):
    order = "cost, input_word, lc_word" if n > 0 else "cost DESC, input_word DESC, lc_word DESC"

    @query(name, f"{TRAVEL}, {ROUNDED} SELECT *, row_number() OVER (PARTITION BY query_id, concept_id ORDER BY {order})::INT AS place FROM tr QUALIFY place <= {abs(n)}")
    def run(spark, sf):
        rows = travel(spark, sf)[1].select("query_id", "concept_id", "input_word", "lc_word", F.round("cost", 9).alias("cost"))
        return report.travel_table(rows, ["query_id", "concept_id"], n)


_travel_table("travel_table_head", 10)
_travel_table("travel_table_tail", -10)

SIZES = "sizes AS (SELECT id AS concept_id, sum(cnt) AS bow_size FROM cbow GROUP BY 1)"
FRAME = f"""{TRAVEL}, {SIZES},
rk AS (SELECT tp.*, rank, row_number() OVER (PARTITION BY query_id, concept_id ORDER BY round(cost, 9), input_word, lc_word) AS up, row_number() OVER (PARTITION BY query_id, concept_id ORDER BY round(cost, 9) DESC, input_word, lc_word) AS down FROM tp JOIN t3 USING (query_id, concept_id)),
rows AS (SELECT DISTINCT query_id, 'input' AS name, 'Input' AS neighbour_type, 'input' AS point_type, NULL::INT AS wordpair_rank, 0.0::DOUBLE AS distance, NULL::DOUBLE AS bow_size, 0 AS priority FROM t3
UNION ALL SELECT query_id, concept_id, rank || '. closest', 'concept', NULL, distance, bow_size, rank FROM t3 LEFT JOIN sizes USING (concept_id)
UNION ALL SELECT query_id, lc_word, rank || '. closest', 'word', least(up, down)::INT, round(euclid, 6), NULL, 100 + rank FROM rk WHERE up <= 10 OR down <= 10),
frame AS (SELECT * EXCLUDE (priority) FROM rows QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY priority, wordpair_rank NULLS FIRST, distance) = 1)"""


def frame(spark, sf):
    c = Conversations(spark, sf)
    best, rows = travel(spark, sf, c)
    rows = written(rows, "chosen")
    sizes = c.bow.join(best.select(F.col("concept_id").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("concept_id")).agg(F.sum("cnt").alias("bow_size"))
    return report.visual_frame(best, rows, sizes)


@query("visual_frame", f"{FRAME} SELECT * FROM frame")
def visual_frame(spark, sf):
    return frame(spark, sf)


@query("neighbour_filter", f"{FRAME} SELECT query_id, name, distance FROM frame WHERE neighbour_type IN ('1. closest', '2. closest') AND point_type = 'word'")
def neighbour_filter(spark, sf):
    return frame(spark, sf).filter(F.col("neighbour_type").isin("1. closest", "2. closest") & (F.col("point_type") == "word")).select("query_id", "name", "distance")


@query("default_selection", f"{FRAME} SELECT DISTINCT neighbour_type FROM frame WHERE contains(neighbour_type, 'Input') OR contains(neighbour_type, 'closest')")
def default_selection(spark, sf):
    return frame(spark, sf).filter(report.default_selection(F.col("neighbour_type"))).select("neighbour_type").distinct()


@query("neighbour_options", f"{FRAME} SELECT DISTINCT neighbour_type AS option FROM frame WHERE point_type = 'concept'")
def neighbour_options(spark, sf):
    return report.neighbour_options(frame(spark, sf), "wmd_bow")


def with_vectors(points, spark, sf):
    """Points with the vector of the word, the concept or the query that each stands for."""
    c = Conversations(spark, sf)
    words = c.with_vec_id(points.filter("point_type = 'word'").select(F.col("name").alias("word")).distinct()).join(c.vectors, "vec_id")
    of = words.select(F.lit("word").alias("point_type"), F.lit(None).cast("long").alias("of"), F.col("word").alias("name"), F.col("vec").cast("array<double>").alias("vec"))
    of = of.unionByName(c.centroids().select(F.lit("concept").alias("point_type"), F.lit(None).cast("long").alias("of"), F.col("id").alias("name"), "vec"))
    of = of.unionByName(question_vectors(spark, sf, c).select(F.lit("input").alias("point_type"), F.col("query_id").alias("of"), F.lit("input").alias("name"), "vec"))
    hit = (points["point_type"] == of["point_type"]) & (points["name"] == of["name"]) & (of["of"].isNull() | (of["of"] == points["query_id"]))
    return points.join(of, hit, "left").select(*[points[x] for x in points.columns], of["vec"])


@query("layout_2d")
def layout_2d(spark, sf):
    """Points with coordinates, and the texts of the turns among them: one table for the picture. Tested by points of known distances."""
    points = written(with_vectors(written(frame(spark, sf), "frame"), spark, sf), "points")
    texts = table(spark, sf, "conversations").select(F.concat(F.lit("T"), "turn", F.lit("_C"), "conv_id").alias("name"), "text")
    return report.picture(points, report.layout(points), texts)


@query("latex_rows", r"SELECT p_partkey, concat_ws(' & ', regexp_replace(p_name, '([&%$#_{}])', '\\\1', 'g'), regexp_replace(p_brand, '([&%$#_{}])', '\\\1', 'g'), p_size) || ' \\' AS line FROM part")
def latex_rows(spark, sf):
    return table(spark, sf, "part").select("p_partkey", report.latex_row(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("line"))


def beam_parts(t: str = "") -> tuple[list[str], str]:
    """CTEs of a beam over the bag that ``bag_sql`` named so, and the last one's name."""
    parts, best = [], None
    for level in range(3):
        if best is None:
            cand = "(SELECT query_id, id AS concept_id FROM (SELECT DISTINCT query_id FROM q), nodes WHERE level = 0)"
        else:
            cand = f"(SELECT DISTINCT query_id, n.id AS concept_id FROM nodes n JOIN {best} b ON n.parent_id = b.concept_id WHERE n.level = {level} AND b.measure = 'fwd' AND b.moved)"
        here = f"p{t}{level}"
        scored = " UNION ALL ".join(f"SELECT query_id, '{m}' AS measure, concept_id, distance, true AS fresh FROM {wmd_sql(m, here)} WHERE distance <= 1000" for m in search.MEASURES)
        older = f" UNION ALL SELECT query_id, measure, concept_id, distance, false FROM {best}" if best else ""
        parts.append(pairs_sql(here, cand, t))
        parts.append(f"b{t}{level}a AS (SELECT *, row_number() OVER (PARTITION BY query_id, measure ORDER BY distance, fresh DESC, concept_id DESC) AS rank FROM ({scored}{older}) QUALIFY rank <= 3)")
        parts.append(f"b{t}{level} AS (SELECT * EXCLUDE (fresh), bool_or(fresh) OVER (PARTITION BY query_id) AS moved FROM b{t}{level}a)")
        best = f"b{t}{level}"
    return parts, best


def beam(spark, sf):
    c = Conversations(spark, sf)
    q, con = wmd_inputs(spark, sf, c)
    tree = written(c.nodes.select(F.col("id").alias("concept_id"), "parent_id", "level"), "tree")
    return search.beam(q, con, tree, {"vectors": c.vectors}, 3, written=written)


@query("beam_search", ", ".join([f"WITH {CONV}, {QSQL}, {WSQL}", *beam_parts()[0]]) + f" SELECT query_id, measure, rank::INT AS rank, concept_id, distance FROM {beam_parts()[1]}")
def beam_search(spark, sf):
    return beam(spark, sf)


# Propagation and diffusion


def sweeps_parts(n: int) -> tuple[list[str], str]:
    """CTEs of so many sweeps from the centroids, and the last one's name."""
    parts, now = [f"v0 AS (SELECT id, level, dim, value FROM ({centroid_sql('cbow')}) JOIN nodes USING (id) WHERE value IS NOT NULL)"], "v0"
    for i in range(2 * n):
        new = f"SELECT e.src AS id, t.level, v.dim, avg(v.value) AS value FROM edges e JOIN (SELECT DISTINCT id, level FROM {now} WHERE level % 2 = {i % 2}) t ON e.src = t.id JOIN {now} v ON v.id = e.dst GROUP BY 1, 2, 3"
        parts.append(f"n{i} AS ({new})")
        parts.append(f"v{i + 1} AS (SELECT * FROM n{i} UNION ALL SELECT * FROM {now} WHERE id NOT IN (SELECT id FROM n{i}))")
        now = f"v{i + 1}"
    return parts, now


def start_values(c):
    level = F.length("id") - F.length(F.translate("id", "_", ""))  # ids name all nodes above
    return c.centroids().filter("vec[0] is not null").select("id", level.alias("level"), "vec")


def root(node):
    return F.substring_index(node, "_", -1)


def root_sizes(c):
    """The number of all nodes, and of those of the largest conversation."""
    n = c.nodes.groupBy(root("id")).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    return n[0] or 0, n[1] or 0


def long_values(values):
    return values.select("id", "level", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 6))


def two_sweeps(c):
    nodes, largest = root_sizes(c)
    if largest <= graph.LARGEST_ROOT:
        return graph.propagate_within(start_values(c), c.edges, root, nodes, 2)
    values, edges = written(start_values(c), "values"), written(c.edges, "edges")
    for parity in (0, 1, 0, 1):
        values = written(graph.half_sweep(values, edges, parity), "values")
    return values


@query("propagate_2sweeps", ", ".join([f"WITH {CONV}", *sweeps_parts(2)[0]]) + f" SELECT id, level, dim::INT AS dim, round(value, 6) AS value FROM {sweeps_parts(2)[1]}")
def propagate_2sweeps(spark, sf):
    return long_values(two_sweeps(Conversations(spark, sf)))


@query("propagate_converged")
def propagate_converged(spark, sf):
    c = Conversations(spark, sf)
    nodes, largest = root_sizes(c)
    if largest <= graph.LARGEST_ROOT:
        return long_values(graph.propagate_within(start_values(c), c.edges, root, nodes, 30, 0.1))
    return long_values(graph.propagate(written(start_values(c), "values"), written(c.edges, "edges"), 0.1, 30, written)[0])


DIFF = """deg AS (SELECT src AS id, count(*) AS deg FROM edges GROUP BY 1),
nb AS (SELECT id, word, s / deg AS nb FROM (SELECT src AS id, word, sum(cnt) AS s FROM edges JOIN cbow ON cbow.id = dst GROUP BY 1, 2) JOIN deg USING (id)),
kept AS (SELECT id, word, nb FROM (SELECT *, nb / sum(nb) OVER (PARTITION BY id) AS share FROM nb) JOIN cidf USING (word) WHERE round(share * idf, 9) > 0.08),
diff AS (SELECT id, word, CASE WHEN nb IS NULL THEN cnt ELSE (nb + coalesce(cnt, 0)) / 2 END AS cnt FROM kept FULL JOIN cbow USING (id, word))"""
DIFFUSE = f"WITH {CONV}, {DIFF}"


def one_diffusion(c):
    """(block, id, word, cnt, idf) after one sweep."""
    if c.largest_root() <= graph.LARGEST_BAGS:
        return graph.diffuse_within(c.bow, c.edges, c.block, c.blocks)
    spread = graph.diffuse(c.bow.select("id", "word", "cnt"), c.edges, c.idf)
    return spread.join(c.idf.select("word", "idf"), "word").select(c.block("id").alias("block"), "id", "word", "cnt", "idf")


@query("diffuse_1sweep", f"{DIFFUSE} SELECT id, word, round(cnt, 6) AS cnt FROM diff")
def diffuse_1sweep(spark, sf):
    c = Conversations(spark, sf)
    return one_diffusion(c).select("id", "word", F.round("cnt", 6).alias("cnt"))


@query("concept_bow_mean_vec", f"{DIFFUSE} SELECT id, dim::INT AS dim, round(value, 6) AS value FROM ({centroid_sql('diff')})")
def concept_bow_mean_vec(spark, sf):
    c = Conversations(spark, sf)
    return long_form(c.centroids(written(one_diffusion(c), "bags")), "id", 6)


@query("diffuse_converged")
def diffuse_converged(spark, sf):
    """Until every node was unchanged twice; tested against loops."""
    c = Conversations(spark, sf)
    if c.largest_root() <= graph.LARGEST_BAGS:
        return graph.diffuse_within(c.bow, c.edges, c.block, c.blocks, 30, freeze=True).select("id", "word", "cnt")
    return graph.diffuse_all(c.bow, written(c.edges, "edges"), c.idf, 30, written)[0]


# Evaluation

GOLD_SQL = "gold AS (SELECT item_id AS query_id, 'S' || (item_id % 3) || '_T' || (item_id % 4) || '_C' || (item_id % 100) AS target FROM benchmark)"
GOLD = "concat('S', item_id % 3, '_T', item_id % 4, '_C', item_id % 100)"
DIST_SQL = """CASE WHEN len(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[-k:] = y[-k:])) = 0 THEN 10
  ELSE len(x) + len(y) - 2 * list_max(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[-k:] = y[-k:])) END"""


def gold(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(GOLD).alias("target"))


@query("tree_distance", f"""WITH {CONV}, {GOLD_SQL}, p AS (SELECT query_id, id, string_split(target, '_') AS x, string_split(id, '_') AS y FROM gold, nodes), d AS (SELECT query_id, id, {DIST_SQL} AS distance FROM p)
SELECT query_id, id, distance::INT AS distance, CASE WHEN distance <= 3 THEN 3 - distance ELSE 0 END::INT AS score FROM d""")
def tree_distance(spark, sf):
    """Of every gold row to every node: a stated set of queries against all."""
    nodes = search.spread(Tree(spark, sf).nodes.select("id", evaluate.last_name(F.col("id")).alias("end")), "id")
    d = evaluate.tree_distance(F.col("target"), F.col("id"), (F.col("target_end"), F.col("end")))
    return search.small_side(gold(spark, sf).withColumn("target_end", evaluate.last_name(F.col("target")))).crossJoin(nodes).select("query_id", "id", d.alias("distance")).withColumn("score", evaluate.tree_score(F.col("distance")))


def ten_measures(spark, sf):
    """All measures over the conversations, with vectors after two sweeps and bags after one."""
    c = Conversations(spark, sf)
    share = lambda bag: c.with_vec_id(stats.term_frequency(bag, "id"))
    q = written(share(known_bag(spark, sf, c)).select(F.col("id").alias("query_id"), "word", F.col("tf").alias("p"), "vec_id"), "query-words")
    diffused = written(one_diffusion(c), "bags")
    words = lambda bag: written(share(bag).select(F.col("id").alias("concept_id"), "word", F.col("tf").alias("p"), "vec_id", "idf"), "concept-words")
    frames = {"concept_vector": written(two_sweeps(c), "frame"), "concept_bow_meanvector": written(c.centroids(diffused).filter("vec[0] is not null"), "frame")}
    frames = {k: v.select(F.col("id").alias("concept_id"), "vec") for k, v in frames.items()}
    tree = written(c.nodes.select(F.col("id").alias("concept_id"), "parent_id", "level"), "tree")
    asked = written(question_vectors(spark, sf, c).withColumnRenamed("vec", "query_vec"), "question-vectors")
    return search.measures(q, tree, {"bow": words(c.bow), "concept_bow": words(diffused)}, c.vectors, asked, frames, 3, written)


def measures_sql() -> str:
    plain, plain_best = beam_parts()
    spread, spread_best = beam_parts("x")
    sweeps, now = sweeps_parts(2)
    label = lambda b: "CASE measure " + " ".join(f"WHEN '{m}' THEN '{search.LABELS[m]}_{b}'" for m in search.MEASURES) + " END"
    near = lambda v, n: f"""SELECT query_id, '{n}' AS measure, rank, concept_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, concept_id) AS rank FROM
  (SELECT q.id AS query_id, v.id AS concept_id, round(sqrt(sum((q.value - v.value) * (q.value - v.value))), 6) AS distance FROM qv q JOIN {v} v ON q.dim = v.dim WHERE v.value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 10"""  # noqa: E731
    parts = [f"WITH {CONV}, {QSQL}, {QVEC}, {WSQL}", *plain, DIFF, bag_sql("diff", "x"), *spread, *sweeps, f"vb AS ({centroid_sql('diff')})"]
    return ", ".join(parts) + f""", best AS (SELECT query_id, {label('bow')} AS measure, rank, concept_id, distance FROM {plain_best} UNION ALL SELECT query_id, {label('concept_bow')}, rank, concept_id, distance FROM {spread_best}
UNION ALL {near(now, 'concept_vector')} UNION ALL {near('vb', 'concept_bow_meanvector')})"""


@query("ten_measures", f"{measures_sql()} SELECT query_id, measure, rank::INT AS rank, concept_id, distance FROM best")
def ten_measures_(spark, sf):
    return ten_measures(spark, sf)


@query("gold_accuracy", f"""{measures_sql()}, {GOLD_SQL},
a AS (SELECT query_id, measure, string_split(target, '_') AS x, string_split(concept_id, '_') AS y FROM gold CROSS JOIN (SELECT DISTINCT measure FROM best) LEFT JOIN (SELECT * FROM best WHERE rank = 1) USING (query_id, measure)),
s AS (SELECT measure, CASE WHEN y IS NULL THEN 10 ELSE {DIST_SQL} END AS d FROM a) SELECT measure, round(sum(CASE WHEN d <= 3 THEN 3 - d ELSE 0 END) / count(*), 6) AS accuracy, count(*) AS n FROM s GROUP BY 1""")
def gold_accuracy(spark, sf):
    """All ten measures, among them the three that are reported: concept_vector, reverse_wmd_concept_bow, wmd_concept_bow."""
    return evaluate.accuracy(ten_measures(spark, sf), gold(spark, sf))


@query("in_database_flag", f"WITH {CONV}, {GOLD_SQL} SELECT query_id, target, target IN (SELECT id FROM nodes) AS in_database FROM gold")
def in_database_flag(spark, sf):
    return evaluate.with_membership(gold(spark, sf), Conversations(spark, sf).nodes).select("query_id", "target", "in_database")


@query("target_normalise", "SELECT p_partkey, replace('Stk. 1._§\\xa0' || p_size || '._LBK', '\\xa0', chr(160)) AS target FROM part")
def target_normalise(spark, sf):
    return table(spark, sf, "part").select("p_partkey", evaluate.normal_target(F.concat(F.lit("Stk. 1._§\\xa0"), "p_size", F.lit("._LBK"))).alias("target"))


# Citations, in texts made of the keys of ``part``; both engines build them by the same expression

N = "p_partkey"
CITE = f"""CASE WHEN {N} % 89 = 3 THEN concat('Efter § 5, stk. 9999999999', {N}, ', gælder § ', {N} % 7 + 1, ', stk. 1-2000000000, nr. 3-1, og stk. 99999999999, jf. 8888888888', {N}, '. pkt.')
WHEN {N} % 97 = 5 THEN concat('Se §§ ', {N} % 5 + 1, '-', {N} % 5 + 4, ' i loven og §§ 1-2000000000', {N}, ', nr. 1-1000.')
ELSE CASE {N} % 12
WHEN 8 THEN concat('Efter § ', {N} % 30 + 1, ', stk. 2 og ', {N} % 3 + 3, ', og § ', {N} % 25 + 1, ', nr. 1, 3 og ', {N} % 5 + 4, ', samt § 2, stk. 1-3, gælder § 4, stk. 2, 1., 2. og 3. pkt.')
WHEN 9 THEN concat('Jf. §§ ', {N} % 20 + 1, ', stk. 2, og ', {N} % 20 + 3, ', nr. 3, i loven.')
WHEN 10 THEN concat('Uanset §§ ', {N} % 9 + 1, '-', {N} % 9 + 5, ' og ', {N} % 9 + 9, ', stk. 2 og 3, finder stk. 2, 1. og 2. pkt., anvendelse.')
WHEN 11 THEN concat('Reglerne i §§ ', {N} % 9 + 1, ' a, ', {N} % 9 + 4, ', stk. 1 eller 2, og ', {N} % 9 + 7, ' a, stk. 1, 2. pkt., og stk. 3, nr. 2-4, gælder.')
WHEN 0 THEN concat('Efter § ', {N} % 40 + 1, ', stk. ', {N} % 3 + 1, ', gælder § ', {N} % 12 + 1, ' a, stk. 2, nr. ', {N} % 5 + 1, ', jf. loven.')
WHEN 1 THEN concat('Se § ', {N} % 40 + 1, ', stk. 1, ', {N} % 4 + 1, '. pkt., sammenholdt med lov om social service.')
WHEN 2 THEN concat('Reglerne i §§ ', {N} % 10 + 1, '-', {N} % 10 + 4, ' og ', {N} % 10 + 8, ' finder anvendelse efter SU-loven.')
WHEN 3 THEN concat('Bestemmelserne i §§ ', {N} % 10 + 1, ', ', {N} % 10 + 3, ' og ', {N} % 10 + 5, ' gælder, jf. ferieloven.')
WHEN 4 THEN concat('Uanset stk. ', {N} % 3 + 1, '-', {N} % 3 + 3, ' gælder stk. 2, nr. ', {N} % 6, ', og stk. 1 eller 4.')
WHEN 5 THEN concat('Det følger af 1. og ', {N} % 5 + 2, '. pkt. i denne lov.')
WHEN 6 THEN concat('Opfyldt er litra a), b) og ', {N} % 7 + 1, ') efter Straffeloven.')
ELSE concat('Ved overtrædelse af denne bestemmelse (§ ', {N} % 9, ') finder EF-forordninger om koordinering af de sociale sikringsordninger sted.') END END"""


def cited(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(CITE).alias("text"))


CTE = f"t AS (SELECT p_partkey AS id, {CITE} AS text FROM part)"
G = {k: quoted(v) for k, v in cite.GRAMMAR.items()}


def each(form: str, names: list[str], source: str = "t", text: str = "text", keep: str = "id") -> str:
    """A select with one row per match and a column per group. For DuckDB a word ends before a letter that is not ASCII, so those are replaced."""
    text = f"translate({text}, 'æøåÆØÅ', 'eoaEOA')"
    cols = ", ".join(f"unnest(regexp_extract_all({text}, {G[form]}, {i + 1})) AS {n}" for i, n in enumerate(names))
    return f"(SELECT {keep}, unnest(range(0, len(regexp_extract_all({text}, {G[form]}))))::INT AS {'place' if form == 'part' else 'ord'}, {cols} FROM {source})"


def nums_sql(x: str) -> str:
    listed = f"list_filter(list_transform(regexp_extract_all({x}, '[0-9]+'), lambda z: TRY_CAST(z AS INT)), lambda z: z IS NOT NULL)"
    usable = f"{listed}[1] <= {listed}[2] AND {listed}[2] - {listed}[1] < {cite.WIDEST}"
    ranged = f"regexp_full_match({x}, '[0-9]+-[0-9]+') AND len({listed}) = 2"
    return f"CASE WHEN coalesce({x}, '') = '' OR len({listed}) = 0 THEN [NULL::INT] WHEN {ranged} AND {usable} THEN range({listed}[1], {listed}[2] + 1)::INT[] ELSE {listed} END"


def named_sql(source: str, more: str = "ref_string") -> str:
    """A row a target of rows with number, letter, stk, nr, pkt."""
    return f"""(SELECT id, ord, {more}, paragraph, s AS stk, n AS nr, p AS pkt, names[1] AS target_name, array_to_string(names[2:], '_') AS target_parents FROM (SELECT *,
  list_filter([p || '. pkt.', n || ')', CASE WHEN s IS NOT NULL OR n IS NOT NULL OR p IS NOT NULL THEN 'Stk. ' || coalesce(s, 1) || '.' END, paragraph], lambda x: x IS NOT NULL) AS names FROM
  (SELECT *, '§' || chr(160) || number || CASE WHEN coalesce(letter, '') <> '' THEN ' ' || letter ELSE '' END || '.' AS paragraph FROM {source} src, unnest({nums_sql('stk')}) AS a(s), unnest({nums_sql('nr')}) AS b(n), unnest({nums_sql('pkt')}) AS c(p))))"""


PART = cite.PART_NAMES
SINGLE = f"refs AS {named_sql(each('single', ['ref_string', *PART]))}"
RANGES = each("range", ["ref_string", "fa", "fl", "la", "ll", *PART])
TARGETS = "paragraph, stk, nr, pkt, target_name, target_parents"


@query("cite_paragraph", f"WITH {CTE}, {SINGLE} SELECT id, ord, ref_string, {TARGETS} FROM refs")
def cite_paragraph(spark, sf):
    return cite.paragraph_refs(cited(spark, sf), "id", "text").withColumn("target_parents", F.array_join("target_parents", "_"))


def name_sql(number: str, letter: str) -> str:
    return f"'§' || chr(160) || {number} || CASE WHEN coalesce({letter}, '') <> '' THEN ' ' || {letter} ELSE '' END || '.'"


@query("cite_range", f"WITH {CTE} SELECT id, ord, ref_string, {name_sql('fa', 'fl')} AS first, {name_sql('la', 'll')} AS last FROM {RANGES}")
def cite_range(spark, sf):
    return cite.range_refs(cited(spark, sf), "id", "text")


@query("cite_range_extra", f"WITH {CTE} SELECT id, ord, {TARGETS} FROM {named_sql(f"(SELECT * FROM {RANGES} WHERE number <> '')")}")
def cite_range_extra(spark, sf):
    return cite.range_extras(cited(spark, sf), "id", "text").withColumn("target_parents", F.array_join("target_parents", "_")).drop("ref_string")


@query("cite_list", f"WITH {CTE}, l AS {each('list', ['ref_string'])} SELECT id, ord, place, {TARGETS} FROM {named_sql(each('part', ['whole', *PART], 'l', 'ref_string', 'id, ord'), 'place')}")
def cite_list(spark, sf):
    return cite.list_refs(cited(spark, sf), "id", "text").withColumn("target_parents", F.array_join("target_parents", "_")).drop("ref_string")


@query("cite_stk", f"WITH {CTE} SELECT id, ord, s AS stk, n AS nr, p AS pkt FROM {each('stk', ['whole', 'stk', 'nr', 'pkt'])} src, unnest({nums_sql('stk')}) AS a(s), unnest({nums_sql('nr')}) AS b(n), unnest({nums_sql('pkt')}) AS c(p)")
def cite_stk(spark, sf):
    return cite.stk_refs(cited(spark, sf), "id", "text")


PKT = quoted(f"(^|[^0-9], |[^, ] |[^0-9 ], ?){cite.GRAMMAR['pkt']}")


@query("cite_pkt", f"WITH {CTE}, x AS (SELECT id, unnest(range(0, len(regexp_extract_all(text, {PKT}, 2))))::INT AS ord, unnest(regexp_extract_all(text, {PKT}, 2)) AS l FROM t) SELECT * FROM (SELECT id, ord, unnest({nums_sql('l')}) AS pkt FROM x) WHERE pkt IS NOT NULL")
def cite_pkt(spark, sf):
    return cite.pkt_refs(cited(spark, sf), "id", "text")


@query("cite_item", f"WITH {CTE} SELECT id, ord, item, CASE WHEN regexp_full_match(item, '[0-9]+') THEN 'nr' ELSE 'litra' END AS kind, false AS in_graph FROM {each('item', ['item'])}")
def cite_item(spark, sf):
    return cite.item_refs(cited(spark, sf), "id", "text")


@query("cite_dispatch", f"WITH {CTE} SELECT id, CASE WHEN regexp_matches(text, {G['range']}) THEN 'range' WHEN regexp_matches(text, {G['list']}) THEN 'list' WHEN regexp_matches(text, {G['single']}) THEN 'single' ELSE 'none' END AS form FROM t")
def cite_dispatch(spark, sf):
    return cited(spark, sf).select("id", cite.reference_form(F.col("text")).alias("form"))


REL = " OR ".join(f"contains(lower(text), {quoted(c)})" for c in RELATIVE_CUES)


@query("cite_relative", f"WITH t AS (SELECT p_partkey AS id, p_partkey // 8 AS paragraph_id, p_partkey % 4 AS stk_id, {CITE} AS text FROM part), s AS (SELECT DISTINCT paragraph_id, stk_id FROM t) SELECT t.id, s.stk_id AS target FROM t JOIN s ON s.paragraph_id = t.paragraph_id AND s.stk_id <> t.stk_id WHERE {REL}")
def cite_relative(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 8").alias("paragraph_id"), F.expr("p_partkey % 4").alias("stk_id"), F.expr(CITE).alias("text"))
    return cite.relative_refs(rows, rows.select("paragraph_id", "stk_id").distinct())


CUES = "cues(cue_no, cue, law) AS (VALUES " + ", ".join(f"({i}, {quoted(c)}, {quoted(w or c.strip())})" for i, (c, w) in enumerate(EXTERNAL_CUES)) + ")"


@query("external_detect", f"WITH {CTE}, {CUES} SELECT id, cue_no, cue, law FROM t JOIN cues ON contains(lower(text), lower(cue))")
def external_detect(spark, sf):
    return cite.external_hits(cited(spark, sf), "id", "text")


WHOLE = quoted("|".join(f"{c}\\b" for c in WHOLE_LAW_CUES))


@query("whole_law_refs", f"""WITH {CTE}, {CUES}, h AS (SELECT id, arg_min(law, cue_no) AS law FROM t JOIN cues ON contains(lower(text), lower(cue)) GROUP BY 1), r AS (SELECT id, regexp_matches(lower(text), {WHOLE}) AS internal, law FROM t LEFT JOIN h USING (id))
SELECT * FROM r WHERE internal OR law IS NOT NULL""")
def whole_law_refs(spark, sf):
    return cite.whole_law_refs(cited(spark, sf), "id", "text")


# Laws of 30 paragraphs, of which every fifth is a lettered one
PARS = "pars AS (SELECT *, name || '_' || law_id AS id FROM (SELECT 'L' || (k % 3) AS law_id, (k // 3 + 1) * 100 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS pos, '§' || chr(160) || (k // 3 + 1) || CASE WHEN k % 5 = 0 THEN ' a' ELSE '' END || '.' AS name FROM range(90) r(k)))"
RESOLVED = f"""r0 AS (SELECT refs.*, 'L' || (id % 3) AS law_id, regexp_replace(paragraph, ' [a-z][.]$', '.') AS plain FROM refs),
res AS (SELECT r0.id, ord, ref_string, paragraph, target_name, r0.law_id, coalesce(e.id, p.id) AS target_id FROM r0 LEFT JOIN pars e ON e.law_id = r0.law_id AND e.name = paragraph LEFT JOIN pars p ON p.law_id = r0.law_id AND p.name = plain)"""


def paragraphs(spark):
    name = "concat('§', chr(160), id div 3 + 1, CASE WHEN id % 5 = 0 THEN ' a' ELSE '' END, '.')"
    return spark.range(90).selectExpr("concat('L', id % 3) AS law_id", f"{name} AS name", f"concat({name}, '_L', id % 3) AS id")


def with_law(refs):
    return refs.withColumn("law_id", F.concat(F.lit("L"), (F.col("id") % 3).cast("string")))


def resolved(spark, texts):
    refs = with_law(cite.paragraph_refs(texts, "id", "text"))
    return cite.resolve(refs.withColumnRenamed("id", "src"), F.broadcast(paragraphs(spark))).withColumnRenamed("src", "id")  # 90 of them


@query("cite_range_expand", f"""WITH {CTE}, {PARS}, r AS (SELECT id AS src, ord, 'L' || (id % 3) AS law_id, TRY_CAST(fa AS BIGINT) * 100 + CASE WHEN fl <> '' THEN ascii(fl) - 96 ELSE 0 END AS a, TRY_CAST(la AS BIGINT) * 100 + CASE WHEN ll <> '' THEN ascii(ll) - 96 ELSE 0 END AS b FROM {RANGES})
SELECT src, ord, name AS paragraph, pars.id AS target_id FROM r JOIN pars ON pars.law_id = r.law_id AND pos BETWEEN a AND b""")
def cite_range_expand(spark, sf):
    ranges = with_law(cite.range_refs(cited(spark, sf), "id", "text")).withColumnRenamed("id", "src")
    return cite.expand_ranges(ranges, paragraphs(spark)).select("src", "ord", "paragraph", "target_id")


@query("ref_resolve", f"WITH {CTE}, {SINGLE}, {PARS}, {RESOLVED} SELECT id, ord, paragraph, target_name, law_id, target_id FROM res")
def ref_resolve(spark, sf):
    return resolved(spark, cited(spark, sf)).select("id", "ord", "paragraph", "target_name", "law_id", "target_id")


@query("ref_classify", f"""WITH {CTE}, {SINGLE}, {PARS}, {RESOLVED}, {CUES},
seg AS (SELECT id, unnest(string_split_regex(text, '(,| efter | sammenholdt med )')) AS part FROM t),
hit AS (SELECT id, part, cue_no, law FROM seg JOIN cues ON contains(lower(part), lower(cue))),
one AS (SELECT id, ord, ref_string, bool_and(target_id IS NOT NULL) AS all_found FROM res GROUP BY 1, 2, 3),
near AS (SELECT res.id, ord, arg_min(law, cue_no) AS law FROM one res JOIN hit ON hit.id = res.id AND contains(part, string_split_regex(ref_string, '(,| efter | sammenholdt med )')[1]) GROUP BY 1, 2),
anyc AS (SELECT id, arg_min(law, cue_no) AS law FROM hit GROUP BY 1)
SELECT res.id, res.ord, CASE WHEN near.law IS NOT NULL THEN 'external' WHEN all_found THEN 'internal' WHEN anyc.law IS NOT NULL THEN 'external' ELSE 'unresolved' END AS ref_class,
  CASE WHEN near.law IS NOT NULL THEN near.law WHEN NOT all_found THEN anyc.law END AS law
FROM one res LEFT JOIN near ON near.id = res.id AND near.ord = res.ord LEFT JOIN anyc ON anyc.id = res.id""")
def ref_classify(spark, sf):
    """The joins run here, since a result whose joins ran later would send texts and segments to the driver by an estimate of their size."""
    with shuffled_joins(spark):
        texts = search.spread(cited(spark, sf), "id")
        rows = written(resolved(spark, texts), "resolved")
        found = rows.groupBy("id", "ord").agg(F.bool_and(F.col("target_id").isNotNull()).alias("all_found"))
        return written(cite.classify(rows.select("id", "ord", "ref_string").distinct(), texts, "id", "text", found), "classified")


@query("deferred_link", f"""WITH {CTE}, {SINGLE}, pend AS (SELECT DISTINCT id AS src, ord, 'L' || (id % 4) AS law, CASE WHEN id % 10 = 1 THEN NULL ELSE paragraph END AS name FROM refs), {PARS}
SELECT src, law AS dst FROM pend WHERE name IS NULL AND law IN ('L0', 'L1', 'L2')
UNION ALL SELECT src, coalesce(e.id, p.id) FROM pend LEFT JOIN pars e ON e.law_id = law AND e.name = pend.name LEFT JOIN pars p ON p.law_id = law AND p.name = regexp_replace(pend.name, ' [a-z][.]$', '.') WHERE coalesce(e.id, p.id) IS NOT NULL""")
def deferred_link(spark, sf):
    refs = cite.paragraph_refs(cited(spark, sf), "id", "text").select("id", "ord", "paragraph").distinct()
    pending = refs.select(F.xxhash64("id", "ord").alias("ref_no"), F.col("id").alias("src"), F.concat(F.lit("L"), (F.col("id") % 4).cast("string")).alias("law"), F.when(F.col("id") % 10 != 1, F.col("paragraph")).alias("name"), F.array(F.concat(F.lit("L"), (F.col("id") % 4).cast("string"))).alias("need"))
    pars = paragraphs(spark).select("id", "law_id", "name", F.array("law_id").alias("parents"))
    laws = pars.select(F.col("law_id").alias("id"), "law_id", F.col("law_id").alias("name"), F.array().cast("array<string>").alias("parents")).distinct()
    return cite.link_deferred(pending, pars.unionByName(laws))[0]


# Word vectors


def corpus_tokens(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select(tokens(F.col("text")).alias("tokens"))


def corpus_words(rows):
    """(word, cnt) of the words that occur twice."""
    return written(rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).filter("cnt >= 2"), "vocabulary")


#: Words whose weights the driver can hold; beyond them they are a table.
CBOW_WORDS = 1_000_000
SKIP_GRAM_WORDS = 400_000


@query("word2vec_skipgram")
def word2vec_skipgram(spark, sf):
    """By Spark ML, which holds all weights and the words' codes on the driver; beyond so many words by negative sampling, with the weights in a table."""
    from ..operators import train

    rows = written(corpus_tokens(spark, sf), "tokens")
    words = corpus_words(rows)
    if words.count() > SKIP_GRAM_WORDS:
        return train.cbow_table(rows, words, size=32, epochs=1, rate=0.025, skip_grams=True)
    return train.vectors_of(train.skip_gram(rows, size=32))


@query("word_vector_lookup", f"SELECT word, dim::INT AS dim, round(x, 6) AS value FROM (SELECT word, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM benchmark) JOIN embeddings ON vec_id = {vec_id_sql('word')})")
def word_vector_lookup(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    words = stats.word_rows(table(spark, sf, "benchmark"), "item_id").select("word").distinct().withColumn("vec_id", word_vec_id(F.col("word"), vectors.count()))
    return words.join(vectors, "vec_id").select("word", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("word2vec_cbow")
def word2vec_cbow(spark, sf):
    from ..operators import train

    rows = written(corpus_tokens(spark, sf), "tokens")
    words = corpus_words(rows)
    if words.count() > CBOW_WORDS:  # too many for weights on the driver
        return train.cbow_table(rows, words, size=32, epochs=1)
    return train.cbow(search.spread(rows.withColumn("h", F.xxhash64("tokens")), "h"), words, size=32, epochs=1, most_words=CBOW_WORDS)


@query("word2vec_cbow_table")
def word2vec_cbow_table(spark, sf):
    """The same with the weights in a table, for a vocabulary of any size."""
    from ..operators import train

    rows = written(corpus_tokens(spark, sf), "tokens")
    return train.cbow_table(rows, corpus_words(rows), size=32, epochs=1)
