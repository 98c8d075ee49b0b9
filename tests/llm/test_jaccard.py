"""The Jaccard join and the pipeline against plain loops."""

import itertools
import random

import numpy as np
import pytest

from conceptweave.llm import jaccard

TABLE = [" ".join(str(d % 2) for d in (i, i // 2, i // 4, i // 8, i // 3)) for i in range(40)]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOC)


def shingles(text, size=4):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def brute(texts, most=85, of=100, size=4):
    sets = [(i, shingles(t, size)) for i, t in texts]
    label = {i: i for i, _ in texts}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and of * len(x & y) >= most * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(s), label[i]) for i, s in sets}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(25)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 or not texts:
            w = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 9, 60, 200]))]
            if kind < 0.15:
                w[:0] = passage
        else:
            w = (rng.choice(texts[:4] if kind < 0.7 else texts)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            w = w[: len(w) - rng.choice([0, 0, 0, 3])] if len(w) > 9 else w
        texts.append((1000 - i, rng.choice([" ", "\n", "\t "]).join(w).upper() if i % 3 else " ".join(w)))
    return texts


@pytest.mark.parametrize("seed, salt, broadcast", [(1, 100_000, 500_000), (2, 2, 0)])
def test_classes(spark, monkeypatch, seed, salt, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    texts = corpus(seed, 260) + [(i + 2000, " ".join(TABLE[i : i + 12])) for i in range(28)] + [(1, None), (2, ""), (3, " \n\x0b"), (4, "one"), (5, "ONE"), (6, "é É"), (7, "é é")]
    expected = brute(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame(spark, texts), salt_rows=salt).collect()}
    assert found == expected
    assert len({c for _, c in expected.values()}) < len(texts) - 60


def test_odd_rows(spark):
    long = "some quite long text " * 20_000
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "alone and null"), (9, long), (8, long + "end")]
    out = sorted(((r.doc_id, r.component_id) for r in jaccard.classes(frame(spark, rows)).collect()), key=str)
    assert out == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (9, 9), (8, 8)], key=str)
    assert jaccard.classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_hashes_depend_on_the_order_of_words(size):
    shingler = jaccard.Shingler(size, jaccard.ascii_words)
    orders = [" ".join(w) for w in itertools.product("xyz", repeat=size)]
    assert len({int(h) for t in orders for h in shingler(t)}) == 3**size


def test_shingles_of_two_words_are_counted_whole(spark):
    found = jaccard.classes(frame(spark, [(1, "x y y x"), (2, "y x x y"), (3, "x y y x x y")])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {1: (1, 1), 2: (1, 2), 3: (3, 3)}


def test_connected(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (45, 50), (45, 45), (100, 99)]
    found = dict(jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 1 for i in range(1, 31)}, 40: 40, 45: 40, 50: 40, 99: 99, 100: 99}


def test_buckets_over_batch_ends(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        texts = corpus(5, 60)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame(spark, texts)).collect()} == brute(texts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_pipeline_against_loops(spark, tmp_path):
    import re

    import corpus_pipeline
    from tests.llm.test_free import whole_ids
    from tests.llm.test_native import brute_dedup
    from tests.llm.test_native import shingles as five_words

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    lines = [" ".join(word() for _ in range(12)) for _ in range(60)]
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    texts = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    texts += [(100 + i, " ".join(word() for _ in range(50)) + " " + items[i % 5][1]) for i in range(8)]
    base = [word() for _ in range(120)]
    texts += [(200 + i, " ".join(base[:i] + [word()] + base[i + 1 :])) for i in range(10)] + [(300, None), (301, "123 ..."), (302, ""), (400, "\n".join(lines[:2])), (401, "\n".join(lines[:2]))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in texts if t and re.search(r"[^\W\d_]", t)}  # one language: every text with a letter has it
    cut = {i: t for i, t in brute_dedup(sorted(left.items())) if any(c > " " for c in t)}
    classes = brute(sorted(cut.items()), 80, 100, 5)
    single = {i: t for i, t in cut.items() if classes[i][1] == i}
    clean = {i: t for i, t in single.items() if not any(5 * len(five_words(x) & five_words(t)) >= 4 * len(five_words(x)) for _, x in items)}
    assert len(texts) > len(left) > len(cut) > len(single) > len(clean) > 30

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], [left, cut, single, clean]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: len(x) for i, x in zip(clean, whole_ids(list(clean.values())))}


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item, base = words(20), words(80).split()
    near = " ".join(base[:40] + ["other"] + base[41:])
    rows = [(1, " ".join(base)), (1, " ".join(base)), (None, near), (None, words(30) + " " + item), (2, words(30) + " " + item), (None, words(30)), (3, None), (4, ""), (5, " \n\t"), (6, "one\ntwo"), (7, "\none\n\ntwo\n"), (8, words(30))]
    schema = "doc_id long, text string, lang string, of string, n_chunks int, removed_chunks int"  # no n_chars, and names of inner columns
    spark.createDataFrame([(i, t, "en", "o", 5, 6) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "of", "n_chunks", "removed_chunks"] and all((r.n_chunks, r.removed_chunks) == (5, 6) for r in docs.collect())
        kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    texts = [t for _, t in rows]
    assert kept[0] == sorted((r for r in rows if r[0] not in (3, 4, 5)), key=str)
    assert kept[1] == sorted((r for r in kept[0] if r[0] != 7), key=str)
    assert kept[2] == sorted([(1, texts[0]), (None, texts[3]), (2, texts[4]), (None, texts[5]), (6, texts[9]), (8, texts[11])], key=str)
    assert kept[3] == sorted([(1, texts[0]), (None, texts[5]), (6, texts[9]), (8, texts[11])], key=str)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, None, 6, 8}


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
