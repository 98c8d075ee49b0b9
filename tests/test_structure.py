import os

import json

import pytest
from pyspark.sql import functions as F

from conceptweave.operators import structure
from conceptweave.sources import files
from conceptweave.sources.html import html_blocks, parse_blocks

LBK = """<html><body><p class="Afsnit">Afsnit I</p><p class="AfsnitOverskrift">Almindelige</p><p class="Kapitel">Kapitel 1</p><p class="KapitelOverskrift2">Formål</p>
<p class="Paragraf"><span class="ParagrafNr">§ 1.</span> Loven gælder ca. alle. Den gælder her.</p><p class="Stk2">Stk. 2 gælder:</p>
<p class="Liste1"><span class="Liste1Nr">1)</span> første</p><p class="Liste2"><span class="Liste2Nr">a)</span> indre</p><p class="ParagrafGruppeOverskrift">Overskrift</p>
<p class="Kapitel">Kapitel 2</p><p class="Paragraf"><span class="ParagrafNr">§ 2.</span> Slut.</p><p class="Paragraf"><span class="ParagrafNr"></span><span class="Bold">§§ 3-5</span> (Udelades)</p>
<p class="Givet">Givet</p><p class="Paragraf"><span class="ParagrafNr">§ 9.</span> Ikke med.</p><hr class="IKraftStreg"><p class="Paragraf">Heller ikke</p></body></html>"""
LOV = """<div id="INDHOLD"><div class="KAPITEL"><p class="Kapiteloverskrift">Formål</p><div class="PARAGRAF"><p class="Paragraftekst"><b>§ 1.</b> Loven gælder.</p><p class="Stk">Stk. to.</p><p class="Nummer">1) et</p><p class="Litra">a) bogstav</p></div></div></div>"""


@pytest.fixture(scope="module")
def laws(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("laws")
    for name, short, popular, html in (("a", "LBK nr 1 af 2020", "Testloven", LBK), ("b", "LOV nr 2 af 2020", None, LOV), ("c", "BEK nr 3", None, "")):
        law = {"shortName": short, "title": f"Titel {name}", "ressort": "R", "id": name, "metadata": [{"displayValue": "1. maj"}], "documentHtml": html} | ({"popularTitle": popular} if popular else {})
        (path / f"{name}.json").write_text(json.dumps([law, {"shortName": "ignored"}]))
    return files.law_documents(spark, str(path)).cache()


def nodes(laws, kind, mapping):
    some = laws.withColumn("dialect", structure.dialect(F.col("doc_type"))).filter(F.col("dialect") == kind).withColumn("html", structure.cut_lbk(F.col("html")) if kind == "lbk" else structure.squeeze(F.col("html")))
    blocks = structure.roles(html_blocks(some), mapping)
    return {r.id: r for r in structure.concept_rows(blocks, some.select("doc_id", F.col("short_name").alias("law_name")), kind).collect()}


def test_documents(laws):
    rows = {r.doc_id: r for r in laws.collect()}
    assert len(rows) == 3 and rows["a"].name == "Testloven" and rows["b"].name == "Titel b" and rows["a"].doc_type == "LBK" and rows["a"].date_of_publication == "1. maj"


def test_lbk_tree(laws):
    found = nodes(laws, "lbk", structure.LBK_ROLES)
    top, sp = "Afsnit 1_LBK nr 1 af 2020", " "
    one = f"§{sp}1._Kapitel 1_{top}"
    for i in (f"Kapitel 1_{top}", one, f"Stk. 1._{one}", f"Stk. 2._{one}", f"1)_Stk. 2._{one}", f"a)_1)_Stk. 2._{one}", *(f"§{sp}{k}._Kapitel 2_{top}" for k in (2, 3, 4, 5))):
        assert i in found, i
    assert found[f"1)_Stk. 2._{one}"].subkind == "number" and found[f"a)_1)_Stk. 2._{one}"].subkind == "litra"
    assert found[f"1. pkt._Stk. 1._{one}"].raw_text == "Loven gælder ca. alle." and found[f"2. pkt._Stk. 1._{one}"].raw_text == "Den gælder her."
    assert found[f"1. pkt._a)_1)_Stk. 2._{one}"].raw_text == "indre"
    assert not any("§" + sp + "9." in i for i in found) and found["LBK nr 1 af 2020"].level == 0 and found["LBK nr 1 af 2020"].parent_id is None
    assert all(r.parent_id in found for r in found.values() if r.parent_id)


def test_lov_tree(laws):
    found = nodes(laws, "lov", structure.LOV_ROLES)
    one = "§ 1._Kapitel 1_LOV nr 2 af 2020"
    assert {one, f"Stk. 1._{one}", f"Stk. 2._{one}", f"1)_Stk. 2._{one}", f"a)_Stk. 2._{one}", "Kapitel 1_LOV nr 2 af 2020"} <= set(found)
    assert found[f"1. pkt._1)_Stk. 2._{one}"].raw_text == "et"


def test_blocks_of_broken_html():
    assert parse_blocks(None) == [] and parse_blocks("") == []
    rows = parse_blocks('<p class="x">a<p>b</p><div>c<script>var x="<p>no</p>"</script></div></b>')
    assert [(b["tag"], b["text"]) for b in rows] == [("p", "a"), ("p", "b"), ("div", "c")]


def test_sinks_and_corpus(spark, tmp_path):
    (tmp_path / "one.txt").write_text("linje\n\nanden\n")
    (tmp_path / "LICENSE").write_text("x\n")
    lines = files.text_corpus(spark, str(tmp_path))
    assert {r.file for r in lines.collect()} == {"one.txt"}
    files.write_clean_text(lines, f"{tmp_path}/out")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out/file=one.txt").select("value").collect()) == ["anden", "linje"]
    (tmp_path / "gold.csv").write_text('Query text,Target\n"et, to",Stk. 1._§\\xa02._LBK\n')
    assert files.gold_set(spark, f"{tmp_path}/gold.csv").first().target == "Stk. 1._§ 2._LBK"
    files.save_tables({"t": spark.range(3)}, f"{tmp_path}/db")
    assert files.load_tables(spark, f"{tmp_path}/db", ["t"])["t"].count() == 3


def test_streaming_ingest_counts_each_document_once(spark, tmp_path):
    from conceptweave.streaming import ingest

    docs = "doc_id long, text string"
    spark.createDataFrame([(1, "et ord ord"), (2, "to")], docs).write.parquet(f"{tmp_path}/in")
    for text in ("first", "nyt"):
        source = spark.readStream.schema(docs).parquet(f"{tmp_path}/in")
        ingest.ingest(spark, source, f"{tmp_path}/bow", f"{tmp_path}/ck").awaitTermination(60)
        if text == "first":
            spark.createDataFrame([(2, "nyt nyt")], docs).write.mode("append").parquet(f"{tmp_path}/in")
    found = {(r.doc_id, r.word): r.cnt for r in ingest.current(spark, f"{tmp_path}/bow").collect()}
    assert found == {(1, "ord"): 2, (2, "nyt"): 2}


def test_streaming_ingest_of_repeated_and_emptied_documents(spark, tmp_path):
    from conceptweave.streaming import ingest

    docs = "doc_id long, text string, at int"
    batches = [[(1, "gammel", 1), (1, "ny", 2), (2, "to to", 1), (None, "uden", 1), (3, "tre", 1)], [(2, "", 3), (3, None, 4), (None, "andet", 2)]]
    for rows in batches:
        spark.createDataFrame(rows, docs).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(docs).parquet(f"{tmp_path}/in")
        ingest.ingest(spark, source, f"{tmp_path}/bow", f"{tmp_path}/ck", order="at").awaitTermination(60)
    expected = {(1, "ny"): 1, (None, "andet"): 1}
    assert {(r.doc_id, r.word): r.cnt for r in ingest.current(spark, f"{tmp_path}/bow").collect()} == expected
    ingest.compact(spark, f"{tmp_path}/bow")
    assert {(r.doc_id, r.word): r.cnt for r in ingest.current(spark, f"{tmp_path}/bow").collect()} == expected
    assert spark.read.parquet(f"{tmp_path}/bow").select("epoch").distinct().count() == 1
    import shutil

    shutil.copytree(f"{tmp_path}/bow-folded/upto=1", f"{tmp_path}/bow-folded/upto=9")  # a fold that a crash has left without its end
    os.remove(f"{tmp_path}/bow-folded/upto=9/_SUCCESS")
    spark.createDataFrame([(2, "igen", 5), (3, "", 6)], docs).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest(spark, spark.readStream.schema(docs).parquet(f"{tmp_path}/in"), f"{tmp_path}/bow", f"{tmp_path}/ck", order="at").awaitTermination(60)
    for _ in range(2):
        assert {(r.doc_id, r.word): r.cnt for r in ingest.current(spark, f"{tmp_path}/bow").collect()} == expected | {(2, "igen"): 1}
        ingest.compact(spark, f"{tmp_path}/bow")


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    from conceptweave.streaming import ingest

    events = "ts timestamp, kind string"
    read = lambda: spark.readStream.schema(events).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ev")
    for i, rows in enumerate((["10:05", "10:20", "12:30"], ["10:40", "12:40"], ["15:00"], ["15:01"])):
        spark.createDataFrame([(f"2026-01-01 {t}:00", "a") for t in rows], "ts string, kind string").selectExpr("cast(ts as timestamp) ts", "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")
        query = ingest.windowed_counts(read(), "ts", "kind").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(60)
    found = {str(r.window.start)[11:16]: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {"10:00": 2, "12:00": 2}  # 10:40 came after its window was closed


def test_cbow_learns_neighbours(spark):
    from conceptweave.operators import train

    texts = [(["a", "x", "b"],), (["c", "y", "d"],)] * 60
    tokens = spark.createDataFrame(texts, "tokens array<string>").repartition(2)
    words = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    losses = []
    assert train.cbow(tokens, words, size=8, epochs=3, losses=losses).count() == 6
    assert len(losses) == 3 and losses[2] < losses[0]


def test_cbow_in_a_table_learns_what_the_other_does(spark):
    """Two topics that share no word: both trainers put words of one topic nearer to each other; losses fall; nothing is left of words that are not known."""
    import random

    import numpy as np

    from conceptweave.operators import train

    rng = random.Random(1)
    topics = [[f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]]
    texts = [(rng.choices(topics[k % 2], k=12) + ["rare"],) for k in range(400)] + [(["a0"],), ([],), (None,), (rng.choices(topics[0], k=2500),)]
    tokens = spark.createDataFrame(texts, "tokens array<string>").repartition(3)
    words = tokens.select(F.explode("tokens").alias("word")).filter("word <> 'rare'").groupBy("word").agg(F.count("*").alias("cnt"))

    def split(vectors):
        v = {r.word: np.array(r.vec) / np.linalg.norm(r.vec) for r in vectors.collect()}
        assert set(v) == set(topics[0] + topics[1])
        same = np.mean([v[x] @ v[y] for t in topics for x in t for y in t if x < y])
        return same - np.mean([v[x] @ v[y] for x in topics[0] for y in topics[1]])

    one, two = [], []
    spread = split(train.cbow_table(tokens, words, size=8, epochs=3, steps=2, chunk_words=1500, pool=200, rate=0.3, losses=one))
    whole = split(train.cbow(tokens, words, size=8, epochs=3, rate=0.3, losses=two))
    assert one[-1] < one[0] and len(one) == 3 and two[-1] < two[0] and spread > 0.3 and whole > 0.3
    empty = train.cbow_table(tokens.limit(0), words.limit(0), size=4, epochs=1, steps=1)
    assert empty.count() == 0


def test_skip_gram_is_saved_and_loaded(spark, tmp_path):
    from conceptweave.operators import train

    tokens = spark.createDataFrame([(["hund", "kat", "fugl"],)] * 20, "tokens array<string>")
    model = train.skip_gram(tokens, size=4, partitions=2)
    train.save_model(model, f"{tmp_path}/model")
    again = {r.word: list(r.vec) for r in train.vectors_of(train.load_model(f"{tmp_path}/model")).collect()}
    assert again == {r.word: list(r.vec) for r in train.vectors_of(model).collect()} and set(again) == {"hund", "kat", "fugl"}
    assert train.vector_of(train.vectors_of(model), ["kat"]).first()["size"] == 4


def test_word_lists_vectors_and_sinks(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("og\n\n i \n")
    assert files.stopwords(spark, f"{tmp_path}/stop.txt") == ["og", "i"]
    (tmp_path / "vec.txt").write_text("2 3\nhund 1 2 3.5\nkat 0 -1 2\n")
    assert {r.word: list(r.vec) for r in files.word_vectors_text(spark, f"{tmp_path}/vec.txt").collect()} == {"hund": [1.0, 2.0, 3.5], "kat": [0.0, -1.0, 2.0]}
    rows = spark.createDataFrame([(1, "m", 'a "b", c'), (2, "n", "d")], "query_id long, measure string, concept_id string")
    files.write_results(rows, f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results/measure=m").count() == 1
    files.write_csv(rows, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, quote='"', escape='"').filter("query_id = 1").first().concept_id == 'a "b", c'
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "one.txt").write_text("et\n")
    (tmp_path / "corpus" / "two.txt").write_text("to\n")
    done = spark.createDataFrame([("one.txt",)], "file string")
    assert [r.file for r in files.text_corpus(spark, f"{tmp_path}/corpus", done).collect()] == ["two.txt"]
    for _ in range(2):  # a repeated job adds nothing
        files.write_clean_text(files.text_corpus(spark, f"{tmp_path}/corpus"), f"{tmp_path}/clean")
    assert spark.read.text(f"{tmp_path}/clean").count() == 2


def test_reports(spark):
    from conceptweave.operators import report

    rows = spark.createDataFrame([("b_1", 1.234, 2), ("a&b", None, 1), ("c", 1.234, 1)], "name string, x double, n int")
    assert [r.name for r in report.sorted_rows(rows, [("x", False), ("n", True)]).collect()] == ["c", "b_1", "a&b"]
    assert report.row_of(rows, "c").count() == 1
    text = report.latex_table(rows, "name", "En", "tab:en", "%.2f")
    assert r"a\&b &  & 1 \\" in text and r"b\_1 & 1.23 & 2 \\" in text and text.startswith("\\begin{table}")


def test_layout_keeps_known_distances(spark):
    from conceptweave.operators import report

    schema = "query_id long, name string, point_type string, distance double, vec array<double>"
    at = {"input": [0.0, 0.0, 0.0], "a": [3.0, 0.0, 0.0], "b": [0.0, 4.0, 0.0], "c": [-1.0, -2.0, 0.0]}
    rows = [(1, n, "input" if n == "input" else "word", float(sum(x * x for x in v) ** 0.5), v) for n, v in at.items()]
    rows += [(2, "input", "input", 0.0, None), (2, "near", "word", 1.0, None), (2, "far", "word", 3.0, None), (3, "input", "input", 0.0, [1.0]), (3, "x", "word", None, None), (None, "lone", "word", 1.0, None)]
    points = spark.createDataFrame([r for r in rows if r[0]], schema)
    places = report.layout(points, 300)
    xy = {(r.query_id, r.name): (r.x, r.y) for r in places.collect()}
    dist = lambda q, m, n: sum((x - y) ** 2 for x, y in zip(xy[(q, m)], xy[(q, n)])) ** 0.5
    for m, v in at.items():
        for n, w in at.items():
            assert abs(dist(1, m, n) - sum((x - y) ** 2 for x, y in zip(v, w)) ** 0.5) < 1e-3
    assert xy[(1, "input")] == xy[(2, "input")] == (0, 0)
    assert abs(dist(2, "input", "near") - 1) < 1e-6 and abs(dist(2, "input", "far") - 3) < 1e-6 and dist(3, "input", "x") < 1e-6
    texts = spark.createDataFrame([("a", "the text")], "name string, text string")
    shown = {(r.query_id, r.name): r for r in report.picture(points, places, texts).collect()}
    assert len(shown) == len(xy) and shown[(1, "a")].text == "the text" and shown[(1, "b")].text is None and shown[(1, "a")].x == xy[(1, "a")][0]


def test_documents_by_http(spark):
    import json
    import threading
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from conceptweave.sources import files, http

    seen = Counter()
    law = [{"id": "x1", "shortName": "LBK nr 1", "title": "En lov", "popularTitle": None, "ressort": "r", "metadata": [{"displayValue": "2020"}], "documentHtml": "<p>æ</p>"}, {"id": "no"}]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            code = 404 if self.path == "/gone" else 500 if self.path == "/broken" or self.path == "/flaky" and seen[self.path] < 3 else 200
            body = b"no json" if self.path == "/text" else json.dumps(law).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    urls = [f"{at}{p}" for p in ("/law", "/law", "/flaky", "/broken", "/gone", "/text")] + ["not a url", "http://127.0.0.1:1/", None]
    rows = http.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), slices=3, retries=2, wait=0.01)
    rows.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/fetched")
    rows = spark.read.parquet(path)
    got = {r.url.removeprefix(at): r for r in rows.collect()}
    server.shutdown()
    assert set(got) == {"/law", "/flaky", "/broken", "/gone", "/text", "not a url", "http://127.0.0.1:1/"} and dict(seen) == {"/law": 1, "/flaky": 3, "/broken": 3, "/gone": 1, "/text": 1}
    assert (got["/flaky"].attempts, got["/flaky"].status, got["/broken"].attempts, got["/broken"].error, got["/gone"].attempts, got["/gone"].error) == (3, 200, 3, "HTTP 500", 1, "HTTP 404")
    assert {r.url.removeprefix(at) for r in http.quarantined(rows).collect()} == {"/broken", "/gone", "not a url", "http://127.0.0.1:1/"} and all((r.body is None) == (r.error is not None) for r in got.values())
    laws = {r.url.removeprefix(at): r for r in files.fetched_laws(rows).collect()}
    assert set(laws) == {"/law", "/flaky", "/text"} and laws["/text"].doc_id is None
    assert (laws["/law"].doc_id, laws["/law"].doc_type, laws["/law"].name, laws["/law"].date_of_publication, laws["/law"].html) == ("x1", "LBK", "En lov", "2020", "<p>æ</p>")


def test_blocks_from_sql_are_the_same(spark):
    from conceptweave.plans.registry import QUERIES

    one, two = (QUERIES[n](spark, "/root/testdata/sf0.001") for n in ("html_blocks", "html_blocks_sql"))
    assert one.columns == two.columns and one.exceptAll(two).count() == two.exceptAll(one).count() == 0 < one.count()


def test_training_in_batches_is_the_plain_loop_where_a_batch_is_one_place():
    """Windows of many places are summed at once; before, each place was a loop of its own, some 100 microseconds a word."""
    import time

    import numpy as np

    from conceptweave.operators import train

    rng = np.random.default_rng(4)
    lengths = np.array([5, 0, 1, 9])
    ids, drawn = rng.integers(0, 7, 15), rng.integers(0, 7, (15, 3))
    start = [rng.normal(size=(7, 4)).astype(np.float32) for _ in range(2)]
    sig = lambda x: 1 / (1 + np.exp(-x))
    for skip in (False, True):
        plain, loss, seen = [s.astype(float) for s in start], 0.0, 0
        for end, n in zip(np.cumsum(lengths), lengths):
            for i in range(end - n, end):
                near = [j for j in range(max(end - n, i - 2), min(end, i + 3)) if j != i]
                if not near:
                    continue
                seen += 1
                into, out = (s.copy() for s in plain)
                for ahead in [[j] for j in near] if skip else [near]:
                    own, goal = (into[ids[i]], ids[ahead[0]]) if skip else (into[ids[ahead]].mean(0), ids[i])
                    back = np.zeros(4)
                    for w, sign in [(goal, 1), *[(d, 0) for d in drawn[i]]]:
                        gap = 0.1 * (sign - sig(own @ out[w]))
                        loss -= np.log(sig(own @ out[w] * (1 if sign else -1)))
                        back += gap * out[w]
                        plain[1][w] += gap * own
                    for x in [ids[i]] if skip else ids[ahead]:
                        plain[0][x] += back / (1 if skip else len(ahead))
        state = [s.copy() for s in start]
        found = (train.learn_skip_gram if skip else train.learn_cbow)(state, ids, lengths, drawn, 2, 0.1, 1)
        assert found[0] == seen and np.isclose(found[1], loss, rtol=1e-4)
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(state, plain))
    many, state = rng.integers(0, 500, 20_000), [np.zeros((500, 16), np.float32) + 0.01 for _ in range(2)]
    began = time.process_time()
    train.learn_cbow(state, many, np.full(100, 200), rng.integers(0, 500, (20_000, 5)), 5, 0.05, 256)
    assert time.process_time() - began < 1.0  # 50 microseconds a word


def test_skip_grams_in_a_table_learn_topics(spark, tmp_path, monkeypatch):
    import numpy as np

    from conceptweave.operators import train
    from conceptweave.plans import graph_queries

    rng = np.random.default_rng(2)
    texts = [([f"{'ab'[k % 2]}{i}" for i in rng.integers(0, 8, 12)],) for k in range(400)]
    tokens = spark.createDataFrame(texts, "tokens array<string>").repartition(3)
    words = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    losses = []
    v = {r.word: np.array(r.vec) / np.linalg.norm(r.vec) for r in train.cbow_table(tokens, words, size=8, epochs=3, steps=2, chunk_words=1500, pool=200, rate=0.05, losses=losses, skip_grams=True).collect()}
    mean = lambda same: np.mean([v[x] @ v[y] for x in v for y in v if x < y and (x[0] == y[0]) == same])
    assert len(v) == 16 and losses[-1] < losses[0] and mean(True) - mean(False) > 0.3
    monkeypatch.setattr(graph_queries, "SKIP_GRAM_WORDS", 2)
    monkeypatch.setattr(train, "skip_gram", None)
    spark.createDataFrame([(i, "hus vej by hus vej by skov") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = graph_queries.word2vec_skipgram(spark, str(tmp_path)).collect()
    assert {r.word for r in rows} == {"hus", "vej", "by", "skov"} and all(len(r.vec) == 32 for r in rows)
