"""Steps that work in blocks, against plain loops; each would take a task, a vector a row or an hour before."""

import numpy as np
from pyspark.sql import functions as F

from conceptweave.functions import vectors as V


def test_vectors_are_shuffled_once_a_block_not_once_a_row(spark):
    rng = np.random.default_rng(5)
    vec = {i: rng.normal(size=4).tolist() for i in range(20)}
    rows = [(f"n{i % 7}", int(rng.integers(0, 25)), float(rng.integers(0, 3))) for i in range(300)] + [("zero", 3, 0.0), ("lost", 99, 1.0)]
    df = spark.createDataFrame(rows, "id string, vec_id long, w double")
    table = spark.createDataFrame([(k, v) for k, v in vec.items()] + [(21, None)], "vec_id long, vec array<double>")
    found = {r.id: r.vec for r in V.looked_up_vectors(df, table, "vec_id", "id", F.col("w")).collect()}
    assert set(found) == {f"n{i}" for i in range(7)} | {"zero"} and found["zero"] == [None] * 4
    for k in set(found) - {"zero"}:
        mine = [(w, vec[v]) for i, v, w in rows if i == k and v in vec]
        assert np.allclose(found[k], sum(w * np.array(x) for w, x in mine) / sum(w for w, _ in mine))
    plan = V.looked_up_vectors(df, table, "vec_id", "id", F.col("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Summarizer" not in plan


def test_one_task_does_not_count_all_words_of_the_conversations(spark, tmp_path, monkeypatch):
    from conceptweave.plans import base

    monkeypatch.setattr(base, "TASK_TURNS", 2)
    turns = [(c, t, "et ord og et ord til. " + f"ord nummer{c}. ") for c in range(10) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []
    monkeypatch.setattr(base, "written", lambda df, name, w=base.written: (seen.append((name, df.rdd.getNumPartitions() if name == "turn-words" else 0)), w(df, name))[1])
    c = base.Conversations(spark, str(tmp_path))
    assert dict(seen)["turn-words"] >= 15
    assert {r.word: r.cnt for r in c.bow.filter("id = 'C3'").collect()}["ord"] == 9.0


def test_word_mover_scores_need_no_row_for_each_word(spark):
    from conceptweave.operators import search

    rng = np.random.default_rng(3)
    vec = spark.createDataFrame([(i, rng.integers(0, 3, 3).astype(float).tolist()) for i in range(12)], "vec_id long, vec array<double>")  # equal ones among them
    text = lambda i, n: [(i, f"w{k:02}", 1.0 / n, int(k) % 13) for k in rng.choice(26, n, False)]  # noqa: E731  (vec_id 12 has no vector)
    q = spark.createDataFrame([r for i in range(4) for r in text(i, 5)], "query_id long, word string, p double, vec_id long")
    c = spark.createDataFrame([(f"c{i}", w, p, v, float(int(w[1:]) % 4)) for i in range(9) for _, w, p, v in text(i, 6)], "concept_id string, word string, p double, vec_id long, idf double")
    both = lambda rows: {(r.query_id, r.concept_id): r.distance for r in rows.collect()}
    known_q, known_c = q.filter("vec_id < 12"), c.filter("vec_id < 12")
    d = search.distance_tables(vec, known_q, known_c)
    made = search.wmd_scores(q, c, vec, search.MEASURES)
    for m in search.MEASURES:
        assert both(made.filter(F.col("measure") == m)) == both(search.relaxed_wmd(search.selected(known_q, known_c, d, m)))
    some = spark.createDataFrame([(0, "c3"), (2, "c3"), (3, "c8"), (9, "c1")], "query_id long, concept_id string")
    assert set(both(search.wmd_scores(q, c, vec, ("fwd",), some))) == {(0, "c3"), (2, "c3"), (3, "c8")}
    assert "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().optimizedPlan().toString()


def test_cbow_goes_on_beyond_the_words_that_the_driver_holds(spark, tmp_path, monkeypatch):
    from conceptweave.plans import graph_queries

    monkeypatch.setattr(graph_queries, "CBOW_WORDS", 2)
    spark.createDataFrame([(i, "hus vej by hus vej by skov") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = graph_queries.word2vec_cbow(spark, str(tmp_path)).collect()
    assert {r.word for r in rows} == {"hus", "vej", "by", "skov"} and all(len(r.vec) == 32 for r in rows)


def test_cheapest_partners_are_sought_once_a_vector_not_once_a_word():
    from conceptweave.operators import search

    rng = np.random.default_rng(7)
    same, lengths = np.array([0, 1, 1, 2, 0, 3, 3, 3]), np.array([4, 1, 3])  # words of three queries by vector
    starts, p = np.array([0, 4, 5]), rng.choice([0.25, 0.5], 8)
    asked = search.Asked(p, same, starts, lengths)
    row, begin = rng.integers(0, 6, 20), np.array([0, 1, 8, 14])
    pc, idf = rng.choice([0.1, 0.3], 20), rng.choice([-0.5, 0.0, 1e-12, 0.7], 20)  # words of nearly all texts among them
    near = np.round(rng.random((6, 4)) * 4) / 4  # equal and zero distances
    found = search.cheapest(asked, near)
    assert found[0].shape == (6, 3)  # a vector of a concept and a query, whatever their words
    for by in (np.ones(20), idf):
        for forward, made in ((True, search.forward(asked, near[row], pc, by, begin)), (False, search.backward(asked, near, found, row, pc, by, begin))):
            for k, b in enumerate(begin):
                rows = range(b, [*begin, 20][k + 1])
                for q, s in enumerate(starts):
                    words = range(s, s + lengths[q])
                    cost, weight = 0.0, 0.0
                    for one in words if forward else rows:
                        pairs = [(r, one) for r in rows] if forward else [(one, j) for j in words]
                        priced = [(np.floor(near[row[r], same[j]] * (pc[r] * p[j] * by[r]) * 1e10 + 0.5), r, j) for r, j in pairs]
                        _, r, j = min(priced)
                        cost, weight = cost + near[row[r], same[j]] * pc[r] * p[j] * by[r], weight + pc[r] * p[j] * by[r]
                    assert np.allclose([made[0][k, q], made[1][k, q]], [cost, weight], atol=1e-9), (forward, k, q)


def test_an_ingest_broadcasts_no_table_by_its_compressed_size(spark, monkeypatch):
    from conceptweave import engine

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before, seen = [spark.conf.get(n, None) for n in names], []
    monkeypatch.setattr(engine, "_epoch", lambda table, path, name, epoch, f=engine._epoch: (seen.append((name, "BroadcastHashJoin" in table._jdf.queryExecution().executedPlan().toString())), f(table, path, name, epoch))[1])
    html = '<p class="Paragraf"><span class="ParagrafNr">§ 1.</span> Pligten gælder efter § 1, stk. 1. Resten følger af lov om social service.</p>'
    base = engine.ingest(spark.createDataFrame([("d1", "LBK", "LBK nr 1", "Lov 1", html)], "doc_id string, doc_type string, short_name string, name string, html string"))
    assert {n for n, _ in seen} >= {"edges", "pending"} and not any(b for _, b in seen)
    assert base["pending"].count() == 1 and [spark.conf.get(n, None) for n in names] == before


def test_vectors_of_whole_trees_are_smoothed_in_one_shuffle(spark, tmp_path):
    from conceptweave.operators import graph
    from conceptweave.tables import written

    rng = np.random.default_rng(2)
    names = [(f"C{c}", []) for c in range(6)] + [(f"T{t}", [f"C{c}"]) for c in range(6) for t in range(3)] + [(f"S{s}", [f"T{t}", f"C{c}"]) for c in range(6) for t in range(3) for s in range(2 + c)]
    nodes = graph.with_ids(spark.createDataFrame(names, "name string, parents array<string>")).select("id", "parent_id", "level")
    vec = {r.id: rng.normal(size=3).tolist() for r in nodes.collect()}
    values = spark.createDataFrame([(r.id, r.level, vec[r.id]) for r in nodes.collect() if r.id != "T1_C2"], "id string, level int, vec array<double>")
    edges, root, stored = graph.containment_edges(nodes), lambda c: F.substring_index(c, "_", -1), written
    held = lambda df: {r.id: r.vec for r in df.collect()}
    by_steps = values
    for parity in (0, 1, 0, 1):
        by_steps = graph.half_sweep(by_steps, edges, parity).localCheckpoint()
    made = graph.propagate_within(values, edges, root, len(vec), 2)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    for one, other in ((held(made), held(by_steps)), (held(graph.propagate_within(values, edges, root, 10 * graph.BLOCK_NODES, 4, 0.3)), held(graph.propagate(values, edges, 0.3, 4, stored)[0]))):
        assert one.keys() == other.keys() and all(np.allclose(one[i], other[i]) for i in one)


def test_conversations_are_diffused_in_blocks_as_by_joins(spark, tmp_path, monkeypatch):
    import random

    from conceptweave import tables
    from conceptweave.operators import graph

    rng = random.Random(11)
    ids = [f"{n}_C{c}" for c in range(6) for n in "abcdef"]
    block = lambda c: F.pmod(F.xxhash64(F.substring_index(c, "_", -1)), F.lit(3)).cast("int")
    idf = {w: k / 5 for k, w in enumerate("uvwxyz")}
    rows = [(i, w, float(rng.randrange(1, 9)), idf[w]) for i in ids if i[0] != "f" for w in idf if rng.random() < 0.5]
    bow = spark.createDataFrame(rows, "id string, word string, cnt double, idf double").withColumn("block", block("id"))
    edges = spark.createDataFrame([(a, b) for a in ids for b in [*ids, *(f"gone_C{c}" for c in range(6))] if a != b and a.split("_")[1] == b.split("_")[1] and rng.random() < 0.4], "src string, dst string")
    words = spark.createDataFrame(list(idf.items()), "word string, idf double")
    made = lambda df: {(r.id, r.word): round(r.cnt, 9) for r in df.collect()}
    monkeypatch.setattr(graph, "DRAWN_ROWS", 7)
    plain = bow.select("id", "word", "cnt")
    once, often = graph.diffuse_within(bow, edges, block, 2), graph.diffuse_within(bow, edges, block, 2, 30, freeze=True)
    assert made(once) == made(graph.diffuse(plain, edges, words)) != made(plain)
    assert made(often) == made(graph.diffuse_all(plain, edges, words, 30, tables.written)[0]) != made(once)
    assert {(r.id, r.block) for r in once.join(bow.select("id", F.col("block").alias("b")).distinct(), "id").filter("block <> b").collect()} == set()
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_words_of_one_row_join_nothing_and_nodes_need_no_words(spark, tmp_path, monkeypatch):
    from conceptweave.plans import base, graph_queries

    turns = [(c, t, f"et ord og et ord til. sær{'abcdef'[c]}. et. ") for c in range(6) for t in range(3)] + [(9, 0, None), (8, 0, "enkelt")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []
    monkeypatch.setattr(base, "written", lambda df, name, w=base.written: (seen.append((name, df._jdf.queryExecution().executedPlan().toString())), w(df, name))[1])
    assert graph_queries.containment_edges(spark, str(tmp_path)).count() == 2 * (20 + 18 * 3 + 1)
    assert [n for n, _ in seen] == ["nodes"]
    monkeypatch.setattr(base, "BLOCK_ROWS", 10)
    c = base.Conversations(spark, str(tmp_path))
    assert "SortAggregate" not in dict(seen)["words"]
    bags = {(r.id, r.word): r.cnt for r in c.bow.collect()}
    assert bags[("C3", "ord")] == 6.0 and bags[("T1_C3", "til")] == 1.0 and bags[("S1_T1_C3", "særd")] == 1.0 and ("C8", "enkelt") not in bags
    assert c.bow.select("id", "word").distinct().count() == c.bow.count() and {r.id for r in c.leaves.select("id").distinct().collect()} == {f"S{i}_T{t}_C{k}" for i in range(2) for t in range(3) for k in range(6)}


def test_top_terms_shuffle_and_write_no_bags(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from conceptweave.operators import stats

    rng = random.Random(4)
    words = [f"{a}{b}ord" for a in "bcdfgh" for b in "aeiouy"]
    texts = [(i % 37, " ".join(rng.choice(words[: 1 + rng.randrange(len(words))]) for _ in range(rng.randrange(30)))) for i in range(40)] + [(90, None), (91, "xyord " * 3 + "kord"), (None, "bord xyord")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bags = {}
    for i, t in texts:
        bags.setdefault(i, Counter()).update((t or "").split())
    df = Counter(w for b in bags.values() for w in b)
    made, seen = {}, {}
    monkeypatch.setattr(stats, "written", lambda d, name, w=stats.written: (seen.setdefault(name, d._jdf.queryExecution().executedPlan().toString()), w(d, name))[1])
    for most in (0, 12, 10_000):  # all words rare, some, none
        monkeypatch.setattr(stats, "BROADCAST_WORDS", most)
        made[most] = {(r.doc_id, r["rank"]): (r.word, r.score) for r in stats.top_terms(docs, k=3).collect()}
    expected = {}
    for i, b in bags.items():
        scores = sorted((-math.floor(c / sum(b.values()) * math.log(len(texts) / (df[w] + 1)) * 1e6 + 0.5) / 1e6, w) for w, c in b.items())
        expected |= {(i, k + 1): (w, -s) for k, (s, w) in enumerate(scores[:3])}
    assert made[0] == made[12] == made[10_000] and made[0].keys() == expected.keys()
    assert all(made[0][x][0] == expected[x][0] and abs(made[0][x][1] - expected[x][1]) < 1.5e-6 for x in expected)
    assert "bags" not in seen and seen["candidates"].count("Exchange hashpartitioning") == 1  # the texts, by key
    assert stats.common_from(spark.createDataFrame([(1,), (2,), (3,), (4,)], "df long"), 3) == 2


def test_each_block_of_bags_has_a_task_of_its_own(spark, tmp_path, monkeypatch):
    from conceptweave.plans import base

    turns = [(c, t, f"et ord og et ord til. sær{'abcdef'[c % 6]}. et. ") for c in range(40) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(base, "BLOCK_ROWS", 20)
    c, held = base.Conversations(spark, str(tmp_path)), {}

    def seen(df, name, w=base.written):
        if name == "bags":
            for r in df.select("block", F.spark_partition_id().alias("task")).distinct().collect():
                held.setdefault(r.task, set()).add(r.block)
        return w(df, name)

    monkeypatch.setattr(base, "written", seen)
    assert c.bow.filter("id = 'C7' and word = 'ord'").first().cnt == 4.0
    assert len(held) > 15 and all(len(blocks) == 1 for blocks in held.values())


def test_classified_citations_send_no_texts_to_the_driver(spark, tmp_path, monkeypatch):
    from conceptweave.plans import graph_queries

    spark.range(200).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    plans = []

    def noted(df, name, w=graph_queries.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return w(df, name)

    monkeypatch.setattr(graph_queries, "written", noted)
    result = graph_queries.ref_classify(spark, str(tmp_path))
    joins = "\n".join([*plans[1:], result._jdf.queryExecution().executedPlan().toString()])  # the first one has the 90 paragraphs
    assert "SortMergeJoin" in joins and "BroadcastHashJoin" not in joins
    assert {r.ref_class for r in result.collect()} == {"internal", "external", "unresolved"}
