import uuid

import numpy as np
from pyspark.sql import functions as F

from conceptweave.operators import evaluate, graph, search, stats


def written(spark, tmp_path):
    def write(df, name):
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


NODES = [("L", []), ("P1", ["L"]), ("P2", ["L"]), ("S1", ["P1", "L"]), ("S2", ["P1", "L"]), ("S3", ["P2", "L"]), ("S4", ["P2", "L"])]


def tree(spark):
    return graph.with_ids(spark.createDataFrame(NODES, "name string, parents array<string>"))


def test_edges_come_in_pairs(spark):
    edges = {(r.src, r.dst, r.type) for r in graph.containment_edges(tree(spark)).collect()}
    assert len(edges) == 12 and all((d, s, {"parent": "child", "child": "parent"}[t]) in edges for s, d, t in edges)


def test_roll_up_conserves_counts(spark):
    leaves = spark.createDataFrame([("S1_P1_L", "a", 2.0), ("S2_P1_L", "a", 1.0), ("S3_P2_L", "b", 5.0)], "id string, word string, cnt double")
    up = {(r.id, r.word): r.cnt for r in stats.roll_up(leaves, graph.ancestors(tree(spark))).collect()}
    assert up == {("S1_P1_L", "a"): 2, ("S2_P1_L", "a"): 1, ("S3_P2_L", "b"): 5, ("P1_L", "a"): 3, ("P2_L", "b"): 5, ("L", "a"): 3, ("L", "b"): 5}


def test_propagation_settles_and_keeps_isolated_nodes(spark, tmp_path):
    nodes = tree(spark)
    rows = [(r.id, r.level, [float(i), 1.0]) for i, r in enumerate(nodes.orderBy("id").collect())] + [("X", 0, [9.0, 1.0])]
    values = spark.createDataFrame(rows, "id string, level int, vec array<double>")
    out, report = graph.propagate(values, graph.containment_edges(nodes), 1e-3, 60, written(spark, tmp_path))
    found = {r.id: r.vec[0] for r in out.collect()}
    assert found.pop("X") == 9.0 and np.ptp(list(found.values())) < 0.05 and 2 < len(report) + 1 < 60
    assert report[-1]["active"] == 0 and report[0]["largest_move"] > 1e-3


def test_propagation_against_loops_and_its_frontier(spark, tmp_path):
    """Nodes freeze at different times; what they give goes on, and the rows written fall with the nodes that can still move."""
    rng = np.random.default_rng(7)
    ids = [f"n{i}" for i in range(60)]
    level = {i: k % 4 for k, i in enumerate(ids)}
    vec = {i: (rng.normal(size=3) * (50 if k < 8 else 1)).tolist() if k != 5 else None for k, i in enumerate(ids)}
    edges = [(ids[k], ids[k + d]) for k in range(59) for d in (1, 5) if k + d < 60] + [("n3", "gone"), ("n3", "n4"), ("n3", "n4")]
    edges += [(d, s) for s, d in edges if d != "gone"]
    now, stable, active, counts = {i: np.array(v) for i, v in vec.items() if v}, {i: 0 for i, v in vec.items() if v}, {i for i, v in vec.items() if v}, []
    for sweep in range(40):
        before = dict(now)
        for parity in (0, 1):
            new = {}
            for i in active:
                near = [now[d] for s, d in edges if s == i and d in now]
                if level[i] % 2 == parity and near:
                    new[i] = sum(near) / len(near)
            now |= new
        if sweep:
            for i in list(active):
                stable[i] += bool(np.linalg.norm(now[i] - before[i]) < 0.5)
                if stable[i] == 2:
                    active.discard(i)
            counts.append(len(active))
            if not active:
                break
    values = spark.createDataFrame([(i, level[i], vec[i]) for i in ids], "id string, level int, vec array<double>")
    out, report = graph.propagate(values, spark.createDataFrame(edges, "src string, dst string"), 0.5, 40, written(spark, tmp_path))
    found = {r.id: r.vec for r in out.collect()}
    assert found.pop("n5") is None and len(found) == 59 and all(np.allclose(found[i], now[i], atol=1e-9) for i in found)
    assert [r["active"] for r in report] == counts and len(set(counts)) > 3 and counts[-1] == 0
    assert [r["written"] for r in report] == [59, *counts[:-1]]


def test_nearest_by_cells(spark):
    from conceptweave.operators.search import CellIndex, nearest

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 20
    rows = [(f"c{i}", (centres[i % 20] + rng.normal(size=6)).tolist()) for i in range(1500)] + [(f"same{i}", [1.0] * 6) for i in range(700)] + [("none", None)]
    asked = [(q, (centres[q] + 0.3).tolist()) for q in range(20)] + [(50, [1.0] * 6), (51, [1e4] * 6), (52, None)]
    concepts = spark.createDataFrame(rows, "concept_id string, vec array<double>")
    queries = spark.createDataFrame(asked, "query_id long, query_vec array<double>")
    want = []
    for q, v in asked:
        if v:
            far = sorted((round(float(np.linalg.norm(np.array(x) - v)), 6), c) for c, x in rows if x)[:7]
            want += [(q, c, r + 1, d) for r, (d, c) in enumerate(far)]
    index = CellIndex.build(concepts, cells=24, sample=500)
    out, report = index.nearest(queries, 7)
    got = sorted((r.query_id, r.concept_id, r["rank"], r.distance) for r in out.collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=2e-6)
    assert report["read"] < report["possible"] / 4  # most cells are read for no query
    cell = index.scored(queries.filter("query_id = 3").selectExpr("query_id", "query_vec", "0 as cell", "double(0) as to", "double(1e9) as reach"), 6)
    assert cell.count() == index.stats[0][0] < 2200 and "PartitionFilters: [isnotnull(cell" in cell._jdf.queryExecution().toString()
    few = nearest(queries, concepts.limit(3), 7).collect()
    assert len(few) == 3 * 22 and nearest(queries, concepts.limit(0)).count() == 0 and nearest(queries.limit(0), concepts).count() == 0


def test_diffusion_by_hand(spark):
    bow = spark.createDataFrame([("a", "x", 4.0), ("b", "x", 2.0), ("b", "y", 2.0)], "id string, word string, cnt double")
    edges = spark.createDataFrame([("a", "b"), ("a", "missing"), ("b", "a")], "src string, dst string")
    idf = spark.createDataFrame([("x", 1.0), ("y", 0.1)], "word string, idf double")
    found = {(r.id, r.word): r.cnt for r in graph.diffuse(bow, edges, idf).collect()}
    # a gets x from b: 2 / 2 neighbours, kept; y is not characteristic enough; b gets x from a
    assert found == {("a", "x"): 2.5, ("b", "x"): 3.0, ("b", "y"): 2.0}


def test_diffusion_to_the_end_against_loops(spark, tmp_path):
    import random

    rng = random.Random(3)
    ids = "abcdefg"
    bow = {(i, w): float(rng.randrange(1, 9)) for i in ids[:6] for w in "uvwxyz" if rng.random() < 0.5}
    edges = [(i, j) for i in ids for j in ids + "?" if i != j and rng.random() < 0.4]
    idf = {w: k / 5 for k, w in enumerate("uvwxyz")}
    bags, left = {i: {w: c for (j, w), c in bow.items() if i == j} for i in ids}, dict.fromkeys(ids, 0)
    sweeps = 0
    while left and sweeps < 30:
        sweeps, new = sweeps + 1, {i: dict(b) for i, b in bags.items()}
        for i in left:
            near = [j for s, j in edges if s == i]
            nb = {}
            for j in near:
                for w, c in bags.get(j, {}).items():
                    nb[w] = nb.get(w, 0) + c / len(near)
            for w, c in nb.items():
                if round(c / sum(nb.values()) * idf[w], 9) > 0.08:
                    new[i][w] = (c + bags[i].get(w, 0)) / 2
        left = {i: n for i in left if (n := left[i] + (len(new[i]) == len(bags[i]))) < 2}
        bags = new
    out, report = graph.diffuse_all(
        spark.createDataFrame([(i, w, c) for (i, w), c in bow.items()], "id string, word string, cnt double"), spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame(list(idf.items()), "word string, idf double"), 30, written(spark, tmp_path))
    assert report[-1]["written"] <= report[0]["written"]
    found = {(r.id, r.word): round(r.cnt, 9) for r in out.collect()}
    assert found == {(i, w): round(c, 9) for i, b in bags.items() for w, c in b.items()} and len(report) == sweeps and report[-1]["active"] == 0


def test_prune(spark):
    edges = spark.createDataFrame([("S1_P1_L", "L", "x"), ("L", "gone", "x"), ("gone", "L", "x")], "src string, dst string, type string")
    assert [tuple(r) for r in graph.prune(edges, tree(spark)).collect()] == [("S1_P1_L", "L", "x")]


def test_question_vectors_by_hand(spark):
    import math

    from conceptweave.operators import question

    queries = spark.createDataFrame([(1, "Hund kat. Ukendt ord. Hund fugl."), (2, "ukendt"), (3, None)], "query_id long, text string")
    vectors = {"hund": [1.0, 0.0], "kat": [0.0, 1.0], "fugl": [1.0, 1.0]}
    words = question.question_words(queries, spark.createDataFrame([(w,) for w in vectors], "word string"))
    bag = {(r.query_id, r.word): (r.cnt, r.known) for r in question.question_bag(words).collect()}
    assert bag == {(1, "hund"): (2, True), (1, "kat"): (1, True), (1, "fugl"): (1, True)}  # the second sentence has no vector, nor has the second query
    idf = spark.createDataFrame([("hund", 1.0), ("kat", 3.0)], "word string, idf double")
    out = question.question_vectors(queries, words, idf, 9, spark.createDataFrame(list(vectors.items()), "word string, vec array<double>")).collect()
    bird = math.log(10 / 2)
    expected = [(0.25 + 1.0) / 3, (0.75 + bird / (1 + bird)) / 3]
    assert [r.query_id for r in out] == [1] and np.allclose(out[0].vec, expected)


def test_tree_scores(spark):
    rows = [("S_T_C", "S_T_C", 0, 3), ("S_T_C", "T_C", 1, 2), ("S1_T_C", "S2_T_C", 2, 1), ("S_T_C", "U_V_C", 4, 0), ("A_B", "X_Y", 10, 0)]
    df = spark.createDataFrame(rows, "a string, b string, d int, s int").withColumn("f", evaluate.tree_distance(F.col("a"), F.col("b")))
    for r in df.withColumn("g", evaluate.tree_score(F.col("f"))).collect():
        assert (r.f, r.g) == (r.d, r.s)


def test_accuracy_counts_rows_without_result(spark):
    gold = spark.createDataFrame([(1, "S_T_C"), (2, "S_T_C")], "query_id long, target string")
    results = spark.createDataFrame([(1, "m", 1, "S_T_C")], "query_id long, measure string, rank int, concept_id string")
    assert evaluate.accuracy(results, gold).first().accuracy == 1.5


def wmd_tables(spark):
    vec = {0: [0.0, 0.0], 1: [3.0, 4.0], 2: [0.0, 1.0]}
    vectors = spark.createDataFrame(list(vec.items()), "vec_id long, vec array<double>")
    q = spark.createDataFrame([(7, "a", 0.5, 0), (7, "b", 0.5, 1)], "query_id long, word string, p double, vec_id long")
    c = spark.createDataFrame([("C", "a", 0.25, 0, 1.0), ("C", "z", 0.75, 2, 2.0), ("D", "b", 1.0, 1, 0.5)], "concept_id string, word string, p double, vec_id long, idf double")
    return vec, q, c, search.distance_tables(vectors, q, c)


def test_relaxed_wmd_against_loops(spark):
    vec, q, c, d = wmd_tables(spark)
    qs, cs = [tuple(r)[1:] for r in q.collect()], {}
    for r in c.collect():
        cs.setdefault(r.concept_id, []).append((r.word, r.p, r.vec_id, r.idf))
    for m in search.MEASURES:
        found = {r.concept_id: r.distance for r in search.relaxed_wmd(search.selected(q, c, d, m)).collect()}
        for name, words in cs.items():
            all_pairs = [(w, v, float(np.linalg.norm(np.subtract(vec[i], vec[j]))) * p * o * (f if m.endswith("idf") else 1), p * o * (f if m.endswith("idf") else 1)) for w, p, i in qs for v, o, j, f in words]
            own, other = (0, 1) if m.startswith("fwd") else (1, 0)
            best = [min((x for x in all_pairs if x[own] == k), key=lambda x: (round(x[2], 10), x[other])) for k in {x[own] for x in all_pairs}]
            assert found[name] == round(sum(x[2] for x in best) / sum(x[3] for x in best), 6)


def test_later_ties_win(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.7), (1, "d", 0.9)], "query_id long, concept_id string, distance double")
    assert [r.concept_id for r in search.top(scores).orderBy("rank").collect()] == ["b", "a", "c"]


def test_beam_follows_the_forward_measure(spark, tmp_path):
    _, q, c, d = wmd_tables(spark)
    nodes = spark.createDataFrame([("C", None, 0), ("D", "C", 1)], "concept_id string, parent_id string, level int")
    out = search.beam(q, c, nodes, d, 2, written=written(spark, tmp_path)).collect()
    assert {r.concept_id for r in out} == {"C", "D"} and {r.measure for r in out} == set(search.MEASURES)


def test_tables_of_a_scope_go_with_it(spark):
    import os

    from conceptweave import tables

    folder = tables.session_dir(spark)
    before = tables.written(spark.range(3), "kept")
    with tables.scope(spark):
        one = tables.written(spark.range(4), "gone")
        with tables.scope(spark):
            two = tables.written(one, "gone-too")
            assert two.count() == 4
        assert one.count() == 4 and not os.path.exists(two.inputFiles()[0].removeprefix("file://"))
        first = one.inputFiles()[0].removeprefix("file://")
    assert before.count() == 3 and not os.path.exists(first) and os.path.exists(folder)


def test_principal_components_against_a_plain_decomposition(spark):
    from conceptweave.functions.vectors import principal_components

    x = np.random.default_rng(4).normal(size=(200, 5)) * [5, 1, 3, 0.1, 0.5] + [1, 2, 3, 4, 5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vec array<double>")
    placed, shares = principal_components(rows, "id", 2)
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(2)])
    got = {r.id: r.vec for r in placed.collect()}
    assert len(got) == 200 and np.allclose([got[i] for i in range(200)], x @ axes, atol=1e-8) and np.allclose(shares, values[::-1][:2] / values.sum())
    assert principal_components(rows.filter("vec is null"), "id")[0].count() == 0


def test_tree_distance_of_ids_with_different_ends_compares_no_lists(spark):
    from conceptweave.operators import evaluate

    ids = ["C1", "C11", "T0_C1", "T1_C1", "S0_T1_C1", "S0_T1_C2", "T1_C2", "1", "S0_S0_T1_C1", ""]

    def loops(a, b):
        x, y = a.split("_"), b.split("_")
        k = max((k for k in range(1, min(len(x), len(y)) + 1) if x[-k:] == y[-k:]), default=0)
        return len(x) + len(y) - 2 * k if k else 10

    one = spark.createDataFrame([(i,) for i in ids], "a string")
    pairs = one.crossJoin(one.withColumnRenamed("a", "b")).select("a", "b", evaluate.tree_distance(F.col("a"), F.col("b")).alias("d"))
    assert {(r.a, r.b): r.d for r in pairs.collect()} == {(a, b): loops(a, b) for a in ids for b in ids}
    assert "substring_index" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_in_matrices_is_nearest_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", rng.integers(0, 3, 3).astype(float).tolist()) for i in range(600)]  # many ties
    concepts = spark.createDataFrame(rows, "concept_id string, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", rng.integers(0, 3, 3).astype(float).tolist()) for i in range(8)], "query_id string, query_vec array<double>")
    index = search.CellIndex.build(concepts, cells=6, sample=100)
    made = lambda: sorted(map(tuple, index.nearest(queries, 5)[0].collect()))
    plan = index.nearest(queries, 5)[0]._jdf.queryExecution().optimizedPlan().toString()
    few = made()
    assert "MapInArrow" in plan and "zip_with" not in plan and len(few) == 40
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    assert made() == few


def test_principal_axes_place_means_by_their_words(spark):
    from conceptweave.functions import vectors as V

    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5)) * [5, 3, 1, 1, 1] + 7
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [None] * 5)], "vec_id long, vec array<double>").repartition(3)
    axes = V.principal_axes(table)
    want = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.allclose(abs((axes * want).sum(0)), 1) and (axes[abs(axes).argmax(0), [0, 1]] > 0).all() and len(V.principal_axes(table.filter("vec is null"))) == 0
    rows = spark.createDataFrame([(f"n{i % 6}", i, float(i % 4)) for i in range(40)], "id string, vec_id long, w double")
    means = {r.id: r.vec for r in V.looked_up_vectors(rows, table.filter("vec_id < 90"), "vec_id", "id", F.col("w")).collect()}
    placed = {r.id: r.vec for r in V.looked_up_vectors(rows, V.on_axes(table.filter("vec_id < 90"), "vec_id", axes), "vec_id", "id", F.col("w")).collect()}
    assert set(placed) == set(means) and all(np.allclose(placed[k], np.array(means[k]) @ axes) for k in means)
