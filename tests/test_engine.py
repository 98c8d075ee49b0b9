"""The entry points over two small laws: what comes in, how it is linked, and what questions find."""

import pytest
from pyspark.sql import functions as F

from conceptweave import engine
from conceptweave.operators import search

P = "§" + chr(160)
ONE = """<p class="Kapitel">Kapitel 1</p><p class="KapitelOverskrift2">Formål</p><p class="Paragraf"><span class="ParagrafNr">§ 1.</span> Hunden gælder efter § 2, stk. 1 og 2, og renteloven.</p>
<p class="Paragraf"><span class="ParagrafNr">§ 2.</span> Katten sover.</p><p class="Stk2">Fuglen synger, jf. stk. 1. Uanset denne paragrafs bestemmelser gælder 1. pkt. også hesten efter denne lov.</p>"""
TWO = """<div id="INDHOLD"><div class="PARAGRAF"><p class="Paragraftekst"><b>§ 1.</b> Hesten følger § 2 i funktionærloven.</p><p class="Nummer">1) hunden</p></div></div>"""
LAWS = "doc_id string, doc_type string, short_name string, name string, html string"
VECTORS = {"hunden": [1.0, 0.0], "katten": [0.0, 1.0], "fuglen": [1.0, 1.0], "hesten": [0.5, 0.0], "sover": [0.0, 0.5], "synger": [0.2, 0.9]}


def vectors(spark):
    return spark.createDataFrame(list(VECTORS.items()), "word string, vec array<double>")


@pytest.fixture(scope="module")
def base(spark):
    first = spark.createDataFrame([("a", "LBK", "LBK nr 1002 af 24/08/2017", "En", ONE), ("x", "BEK", "BEK nr 1", "X", "")], LAWS)
    second = spark.createDataFrame([("b", "LOV", "LOV nr 2", "To", TWO)], LAWS)
    made = engine.ingest(first, vectors(spark).select("word"))
    return engine.ingest(second, vectors(spark).select("word"), base=made)


def test_ingest(base):
    law, p1, p2 = "LBK nr 1002 af 24/08/2017", f"{P}1._Kapitel 1_LBK nr 1002 af 24/08/2017", f"{P}2._Kapitel 1_LBK nr 1002 af 24/08/2017"
    refs = {(r.src, r.dst) for r in base["edges"].filter("type = 'ref_to'").collect()}
    s1, s2 = f"1. pkt._Stk. 1._{p1}", f"Stk. 2._{p2}"
    assert {(s1, f"Stk. 1._{p2}"), (s1, f"Stk. 2._{p2}"), (f"1. pkt._{s2}", f"Stk. 1._{p2}"), (f"2. pkt._{s2}", f"1. pkt._{s2}"), (f"2. pkt._{s2}", f"Stk. 1._{p2}"), (f"2. pkt._{s2}", law)} == refs
    pending = {(r.src.split("_")[-1], r.law, r.name) for r in base["pending"].collect()}
    assert pending == {(law, "renteloven", None), ("LOV nr 2", law, f"{P}2 i.")}  # its letter falls away when it is linked
    assert [r.doc_id for r in base["quarantine"].collect()] == ["x"]
    assert "gælder" in {r.word for r in base["oov"].collect()} and not {r.word for r in base["leaves"].collect()} - set(VECTORS)


def test_a_law_that_comes_again_replaces_itself(spark, base):
    again = engine.ingest(spark.createDataFrame([("b2", "LOV", "LOV nr 2", "To", TWO.replace("Hesten", "Fuglen"))], LAWS), vectors(spark).select("word"), base=base)
    assert again["concepts"].count() == base["concepts"].count() == again["concepts"].select("id").distinct().count()
    assert again["concepts"].filter("raw_text like 'Hesten%'").count() == 0 and again["documents"].count() == 3 and again["sentences"].count() == base["sentences"].count()


def test_finalise_and_answer(spark, base, tmp_path):
    done, report = engine.finalise(base, vectors(spark))
    assert report["propagate"][-1]["active"] == 0 and report["diffuse"][-1]["active"] == 0
    links = {(r.src, r.dst) for r in done["edges"].filter("src like '%LOV nr 2' and type = 'ref_to'").collect()}
    assert links == {(f"1. pkt._Stk. 1._{P}1._LOV nr 2", f"{P}2._Kapitel 1_LBK nr 1002 af 24/08/2017")}
    assert [r.law for r in done["pending"].collect()] == ["renteloven"]
    bow = {(r.id, r.word): r.cnt for r in done["bow"].collect()}
    assert bow[("LOV nr 2", "hunden")] == 1 and bow[(f"Kapitel 1_LBK nr 1002 af 24/08/2017", "katten")] == 1
    text = {r.id: r.text for r in done["texts"].collect()}
    assert text["LOV nr 2"] == "Hesten følger § 2 i funktionærloven.\nhunden"
    engine.save(done, f"{tmp_path}/base")
    done = engine.load(spark, f"{tmp_path}/base")
    more = engine.ingest(spark.createDataFrame([law("LOV nr 2", {1: "Katten."}, "c")], LAWS), vectors(spark).select("word"), base=done)
    assert more["sentences"].filter("text = 'Katten.'").count() == 1 and more["sentences"].count() == done["sentences"].count() - 1
    queries = spark.createDataFrame([(1, "Katten sover. Ukendt."), (2, "Hunden!"), (3, "ukendt")], "query_id long, text string")
    out = engine.answer(done, vectors(spark), queries).collect()
    names = {f"{m}_{b}" for m in search.LABELS.values() for b in ("bow", "concept_bow")} | {"concept_vector", "concept_bow_meanvector"}
    assert {r.measure for r in out} == names and {r.query_id for r in out} == {1, 2}
    best = {(r.query_id, r.measure): r for r in out if r.rank == 1}
    assert best[(1, "wmd_bow")].concept_id.endswith("LBK nr 1002 af 24/08/2017") and best[(2, "wmd_bow")].distance == 0


def law(short, body, doc_id="d", kind="LBK"):
    return (doc_id, kind, short, "N", "".join(f'<p class="Paragraf"><span class="ParagrafNr">§ {k}.</span> {t}</p>' for k, t in body.items()))


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


CITED = "LBK nr 1002 af 24/08/2017"  # the law that is meant by its usual name


def test_a_replaced_law_is_linked_again(spark):
    """Finalise, replace the cited law, or the citing one, finalise: the same edges and frequencies as of all laws at once."""
    a, b = law("A_nr 1", {1: "Hesten følger § 2 i funktionærloven.", 2: "Katten sover."}, "a"), law(CITED, {1: "Hunden.", 2: "Fuglen synger."}, "b")
    b2, a2 = law(CITED, {1: "Hunden sover.", 2: "Hesten.", 3: "Ny."}, "b2"), law("A_nr 1", {1: "Fuglen følger § 3 i funktionærloven."}, "a2")
    frame = lambda *rows: spark.createDataFrame(list(rows), LAWS)
    words = vectors(spark).select("word")
    finish = lambda base: engine.finalise(base, vectors(spark))[0]
    base = finish(engine.ingest(frame(a, b), words))
    for new, rest, done in ((b2, a, finish), (a2, b2, engine.linked)):
        base = done(engine.ingest(frame(new), words, base=base))
        once = done(engine.ingest(frame(new, rest), words))
        for table, cols in (("edges", ("src", "dst", "type")), ("concepts", ("id", "raw_text")), ("frequencies", ("word", "df")), ("leaves", ("id", "word", "cnt")), ("pending", ("src", "law"))):
            assert ids(base[table].na.fill(""), *cols) == ids(once[table].na.fill(""), *cols), table
        assert {r.type for r in base["edges"].collect()} == {"parent", "child", "ref_to", "ref_from"}
        if done is finish:
            assert {r.id: [round(x, 9) for x in r.vec] for r in base["concept_vector"].collect()} == {r.id: [round(x, 9) for x in r.vec] for r in once["concept_vector"].collect()}


def test_files_of_other_laws_stay_the_same(spark, tmp_path):
    import os

    frame = lambda *rows: spark.createDataFrame(list(rows), LAWS)
    base = engine.ingest(frame(law("A", {1: "Hunden."}, "a"), law("B", {1: "Katten."}, "b")), path=f"{tmp_path}/base")
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{tmp_path}/base") for f in names}
    before = files()
    again = engine.ingest(frame(law("B", {1: "Fuglen."}, "b2")), base=base)
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    assert ids(again["sentences"], "text") == [("Fuglen.",), ("Hunden.",)] and ids(base["sentences"], "text") == [("Hunden.",), ("Katten.",)]
    assert ids(again["frequencies"], "word", "df") == [("", 2), ("fuglen", 1), ("hunden", 1)] and (again.metrics["laws"], again.metrics["sentences"]) == (1, 1)
    gone = engine.ingest(frame(law("B", {1: "Nix."}, "b3", "BEK")), base=again)
    assert ids(gone["sentences"], "text") == [("Hunden.",)] and ids(gone["quarantine"], "doc_id") == [("b3",)] and gone.metrics["quarantined"] == 1 and engine.texts_of(gone) == 1
    small = engine.compact(gone, spark)
    assert small.path != gone.path and all(ids(small[t], *c) == ids(gone[t], *c) for t, c in (("sentences", ("id", "text")), ("edges", ("src", "dst", "type")), ("frequencies", ("word", "df")), ("documents", ("doc_id",))))


def test_the_last_edition_of_a_batch_counts(spark):
    rows = spark.createDataFrame([(*law("A", {1: "Ny."}, "a1"), 10), (*law("A", {1: "Gammel."}, "a2"), 9)], LAWS + ", year int")
    assert ids(engine.ingest(rows, order=["year"])["sentences"], "text") == [("Ny.",)]


def test_a_law_with_absurd_numbers_comes_in(spark):
    rows = spark.createDataFrame([law("A", {5: "Efter § 5, stk. 99999999999, og § 5, stk. 1-2000000000. Jf. §§ 1-99999999999999999999."}, "a"), ("o", "LBK", "O", "N", '<p class="Paragraf"><span class="ParagrafNr"></span><span class="Bold">§§ 1-99999999999</span> (Udelades)</p><p class="Paragraf"><span class="ParagrafNr">§ 7.</span> x</p>')], LAWS)
    base = engine.ingest(rows)
    assert base["concepts"].filter("kind = 'paragraf'").count() == 3 and base["edges"].count() > 0  # a range that names no paragraphs is an element like any other


def test_gold_set_end_to_end(spark, base, tmp_path):
    from conceptweave.sources import files

    done, _ = engine.finalise(base, vectors(spark))
    target = f"{P}2._Kapitel 1_{CITED}"
    with open(f"{tmp_path}/gold.csv", "w", encoding="utf-8") as f:
        f.write('"query","target"\n"Katten sover","' + target.replace(chr(160), "\\xa0") + '"\n"Hunden","§\\xa09._LBK nr 0"\n"ukendt","' + target.replace(chr(160), "\\xa0") + '"\n')
    gold = files.gold_set(spark, f"{tmp_path}/gold.csv")
    accuracy, rows = engine.evaluate(done, vectors(spark), gold)
    asked = {r.query_id: r for r in gold.collect()}
    found = {(asked[r.query_id].query_text, r.measure): r for r in rows.collect()}
    assert len(found) == 3 * 10 and {n for n, _ in found} == {"Katten sover", "Hunden", "ukendt"}
    assert all(r.in_database == (n != "Hunden") for (n, _), r in found.items()) and all(r.concept_id is None and r.score == 0 for (n, _), r in found.items() if n == "ukendt")
    hit = found[("Katten sover", "concept_vector")]
    assert hit.target == target and hit.concept_id.endswith(CITED) and hit.score == max(0, 3 - hit.steps)
    for r in accuracy.collect():
        assert r.n == 3 and abs(r.accuracy - sum(x.score for (_, m), x in found.items() if m == r.measure) / 3) < 1e-6


def test_blocks_of_both_dialects(spark):
    from conceptweave.operators import structure

    odd = [
        ("a", "LOV", '<div><p class="Paragraf"><span class="ParagrafNr">§ 1.</span> Som i en LBK.</p></div>'),
        ("b", "LOV", '<p>Før</p><div id="INDHOLD"><p class="Paragraftekst"><b>§ 1.</b> Et <b>fedt</b> ord.</p><p class="Aendringspunkt"><b>2 a.</b> I § 3 ændres. Mere.</p></div><p class="Stk">Efter</p>'),
        ("c", "LBK", '<p class="TekstGenerel">x</p><p class="Paragraf"><span class="ParagrafNr">§ 1.</span> Inde.</p><hr class="IKraftStreg"><p class="Paragraf">Ude</p>'),
        ("d", "BEK", "<p>nix</p>"), ("e", "LOV", None),
    ]
    rows = structure.law_blocks(spark.createDataFrame(odd, "doc_id string, doc_type string, html string")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.ordinal):
        if r.role != "text":
            found.setdefault(r.doc_id, []).append((r.dialect, r.role, r.number, r.text))
    assert found == {
        "a": [("lbk", "paragraph", "§ 1.", "Som i en LBK.")],
        "b": [("lov", "paragraph", "", "Et fedt ord."), ("lov", "item", "2a)", "I § 3 ændres. Mere.")],
        "c": [("lbk", "paragraph", "§ 1.", "Inde.")],
    }


def test_laws_without_links_to_others_are_smoothed_and_diffused_in_blocks_as_by_joins(spark, monkeypatch):
    from conceptweave.operators import graph

    laws = [law(f"LBK nr {k}", {1: "Katten sover. Hunden sover efter § 2.", 2: "Hunden gør." + " Katten." * k}, f"d{k}") for k in range(1, 5)]
    laws += [law("LOV nr 8", {1: "Hunden følger § 1 i funktionærloven."}, "d8"), law("LBK nr 1002 af 24/08/2017", {1: "Katten sover."}, "d9")]
    base = engine.ingest(spark.createDataFrame(laws, LAWS), vectors(spark).select("word"))
    looped = []
    monkeypatch.setattr(graph, "propagate", lambda values, *a, f=graph.propagate: (looped.append({r.id.split("_")[-1] for r in values.collect()}), f(values, *a))[1])
    seen = lambda done: {n: {(r.id, *([r.word] if n == "concept_bow" else [])): [round(x, 9) for x in (r.vec if "vec" in r else [r.cnt])] for r in done[n].collect()} for n in ("concept_vector", "concept_bow", "concept_bow_meanvector")}
    made, report = engine.finalise(base, vectors(spark))
    assert looped == [{"LOV nr 8", "LBK nr 1002 af 24/08/2017"}]  # before, all laws went through the loop
    monkeypatch.setattr(graph, "LARGEST_ROOT", 0)
    by_joins, same = engine.finalise(base, vectors(spark))
    assert len(looped[-1]) == 6 and seen(made) == seen(by_joins)
    strip = lambda rows: [(r["sweep"], r["active"]) for r in rows]
    assert [strip(report[k]) for k in ("propagate", "diffuse")] == [strip(same[k]) for k in ("propagate", "diffuse")]


def test_what_is_asked_in_the_same_words_is_sought_once(spark, base, monkeypatch):
    done, _ = engine.finalise(base, vectors(spark))
    asked = []
    monkeypatch.setattr(search, "measures", lambda q, *a, f=search.measures: (asked.append({r.query_id for r in q.collect()}), f(q, *a))[1])
    queries = spark.createDataFrame([(4, "Katten sover."), (1, "Katten sover."), (2, "Hunden!"), (3, "Katten sover."), (5, None)], "query_id long, text string")
    rows = lambda n: {(r.measure, r["rank"], r.concept_id, r.distance) for r in out if r.query_id == n}
    out = engine.answer(done, vectors(spark), queries).collect()
    assert asked == [{1, 2}] and {r.query_id for r in out} == {1, 2, 3, 4}
    assert rows(1) == rows(3) == rows(4) != rows(2) and len({(r.query_id, r.measure, r["rank"]) for r in out}) == len(out)


def test_a_finished_base_and_its_answers_send_nothing_large_to_the_driver(spark, base, monkeypatch):
    """Estimates of compressed tables decide what is broadcast, so the limit is low while tables are written, and answers hold no join for later."""
    limits, name = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    monkeypatch.setattr(engine, "written", lambda df, n, w=engine.written: (limits.append(int(spark.conf.get(name))), w(df, n))[1])
    done, _ = engine.finalise(base, vectors(spark))
    out = engine.answer(done, vectors(spark), spark.createDataFrame([(1, "Katten sover."), (2, "Katten sover.")], "query_id long, text string"))
    assert len(limits) > 10 and max(limits) <= engine.BROADCAST_BYTES and spark.conf.get(name) == before
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and {r.query_id for r in out.collect()} == {1, 2}
