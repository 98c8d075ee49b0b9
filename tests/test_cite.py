import pytest
from pyspark.sql import functions as F

from conceptweave.operators import cite

P = "§" + chr(160)


def rows(spark, text, f, *cols):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return [tuple(r) for r in f(df, "id", "text").orderBy("ord").select(*cols).collect()]


@pytest.mark.parametrize("text, name, parents", [
    ("efter § 7 a gælder", f"{P}7 a.", []),
    (f"efter {P}17 gælder", f"{P}17.", []),
    ("§ 3, stk. 12, finder", "Stk. 12.", [f"{P}3."]),
    ("§ 3, nr. 4", "4)", ["Stk. 1.", f"{P}3."]),
    ("§ 3, stk. 2, 1. pkt.", "1. pkt.", ["Stk. 2.", f"{P}3."]),
    ("§ 3, 2. pkt.", "2. pkt.", ["Stk. 1.", f"{P}3."]),
])
def test_paragraph(spark, text, name, parents):
    assert rows(spark, text, cite.paragraph_refs, "target_name", "target_parents") == [(name, parents)]


@pytest.mark.parametrize("text, names", [
    ("§ 5, stk. 2 og 3, gælder", [["Stk. 2.", f"{P}5."], ["Stk. 3.", f"{P}5."]]),
    ("§ 5, stk. 1-3", [[f"Stk. {k}.", f"{P}5."] for k in (1, 2, 3)]),
    ("§ 5, nr. 1, 2 og 4", [[f"{k})", "Stk. 1.", f"{P}5."] for k in (1, 2, 4)]),
    ("§ 5, stk. 2, nr. 1 eller 10", [[f"{k})", "Stk. 2.", f"{P}5."] for k in (1, 10)]),
    ("§ 5, stk. 2, nr. 3, 1. og 2. pkt.", [[f"{k}. pkt.", "3)", "Stk. 2.", f"{P}5."] for k in (1, 2)]),
    ("§ 5 a, 1., 2. og 3. pkt., x", [[f"{k}. pkt.", "Stk. 1.", f"{P}5 a."] for k in (1, 2, 3)]),
    ("§§ 5-7 og 9", []),
])
def test_every_listed_target(spark, text, names):
    assert [[n, *p] for n, p in rows(spark, text, cite.paragraph_refs, "target_name", "target_parents")] == names


def test_lists_of_paragraphs_with_parts(spark):
    found = [[n, *p] for n, p in rows(spark, "efter §§ 5, stk. 2, og 7, nr. 3, samt", cite.list_refs, "target_name", "target_parents")]
    assert found == [["Stk. 2.", f"{P}5."], ["3)", "Stk. 1.", f"{P}7."]]
    found = [[n, *p] for n, p in rows(spark, "§§ 1 a, 3, stk. 1 eller 2, og 5", cite.list_refs, "target_name", "target_parents")]
    assert found == [[f"{P}1 a."], ["Stk. 1.", f"{P}3."], ["Stk. 2.", f"{P}3."], [f"{P}5."]]


def test_ranges_hold_lettered_paragraphs(spark):
    text = "§§ 5-7 og 9, stk. 2, gælder"
    pars = spark.createDataFrame([("L", f"{P}{n}.", f"{P}{n}._L") for n in ("4", "5", "5 a", "6", "7", "7 a", "9")], "law_id string, name string, id string")
    ranges = cite.range_refs(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").withColumnRenamed("id", "src").withColumn("law_id", F.lit("L"))
    assert sorted(r.paragraph for r in cite.expand_ranges(ranges, pars).collect()) == sorted(f"{P}{n}." for n in ("5", "5 a", "6", "7"))
    assert rows(spark, text, cite.range_extras, "target_name", "target_parents") == [("Stk. 2.", [f"{P}9."])]


def test_local_and_sibling_targets(spark):
    parents = ["Stk. 1.", f"{P}3.", "Kapitel 1", "L"]
    df = spark.createDataFrame([("s", parents, "Uanset stk. 2, nr. 1 og 3, og stk. 4, 2. pkt., gælder 1. og 3. pkt."), ("t", ["L"], "stk. 2")], "id string, parents array<string>, text string")
    top = f"{P}3._Kapitel 1_L"
    assert {r.target_id for r in cite.local_targets(df).collect()} == {f"1)_Stk. 2._{top}", f"3)_Stk. 2._{top}", f"2. pkt._Stk. 4._{top}"}
    assert {r.target_id for r in cite.sibling_targets(df).collect()} == {f"1. pkt._Stk. 1._{top}", f"3. pkt._Stk. 1._{top}"}


def test_law_citations(spark):
    texts = spark.createDataFrame([(1, "L", "Efter § 3, stk. 2, og §§ 3-4 gælder § 99."), (2, "L", "Se § 5 i ferieloven."), (3, "L", "Efter §§ 3, nr. 1, og 4")], "id long, law_id string, text string")
    pars = spark.createDataFrame([("L", f"{P}{n}.", f"{P}{n}._K_L") for n in (3, 4)], "law_id string, name string, id string")
    inside, outside = cite.law_citations(texts, pars)
    assert {tuple(r) for r in inside.collect()} == {(1, f"Stk. 2._{P}3._K_L"), (1, f"{P}3._K_L"), (1, f"{P}4._K_L"), (3, f"1)_Stk. 1._{P}3._K_L"), (3, f"{P}4._K_L")}
    assert [(r.id, r.law) for r in outside.collect()] == [(2, "ferieloven")]


def test_forms(spark):
    assert rows(spark, "§§ 2-4 og 9 gælder", cite.range_refs, "first", "last") == [(f"{P}2.", f"{P}4.")]
    assert rows(spark, "§§ 1, 3 og 5 gælder", cite.list_refs, "target_name") == [(f"{P}1.",), (f"{P}3.",), (f"{P}5.",)]
    assert rows(spark, "Uanset stk. 2-4 og", cite.stk_refs, "stk") == [(2,), (3,), (4,)]
    assert rows(spark, "§ 4, stk. 2", cite.stk_refs, "stk") == []  # belongs to the paragraph
    assert rows(spark, "Efter 1. og 2. pkt. gælder", cite.pkt_refs, "pkt") == [(1,), (2,)]
    assert rows(spark, "litra a) og 2)", cite.item_refs, "item", "kind") == [("a", "litra"), ("2", "nr")]


def test_a_sign_that_nothing_follows_ends(spark):
    for text in ("(§ )", "§", "§§", "§ x", None, ""):
        assert rows(spark, text, cite.paragraph_refs, "target_name") == []


def test_dispatch(spark):
    df = spark.createDataFrame([("§ 1",), ("§§ 1-2",), ("§§ 1, 2 og 3",), ("ingen",)], "t string")
    assert [r[0] for r in df.select(cite.reference_form(F.col("t"))).collect()] == ["single", "range", "list", "none"]


def test_external_is_found_in_any_case(spark):
    df = spark.createDataFrame([(1, "efter su-loven"), (2, "efter FUNKTIONÆRLOVEN"), (3, "intet")], "id long, text string")
    assert {(r.id, r.law) for r in cite.external_hits(df, "id", "text").collect()} == {(1, "SU-loven"), (2, "LBK nr 1002 af 24/08/2017")}


def test_classification(spark):
    texts = spark.createDataFrame([(1, "Efter § 3 i ferieloven, og § 4"), (2, "Efter § 5"), (3, "Efter § 99, se renteloven")], "id long, text string")
    refs = cite.paragraph_refs(texts, "id", "text").select("id", "ord", "ref_string")
    resolved = refs.select("id", "ord", (~F.contains("ref_string", F.lit("99"))).alias("all_found"))
    found = {(r.id, r.ord): (r.ref_class, r.law) for r in cite.classify(refs, texts, "id", "text", resolved).collect()}
    assert found == {(1, 0): ("external", "ferieloven"), (1, 1): ("internal", None), (2, 0): ("internal", None), (3, 0): ("external", "renteloven")}


def test_resolution_falls_back_from_the_letter(spark):
    refs = spark.createDataFrame([("L", "§ 5 i."), ("L", "§ 6 a."), ("L", "§ 9.")], "law_id string, paragraph string")
    pars = spark.createDataFrame([("L", "§ 5.", "five"), ("L", "§ 6.", "six"), ("L", "§ 6 a.", "six a")], "law_id string, name string, id string")
    assert {r.paragraph: r.target_id for r in cite.resolve(refs, pars).collect()} == {"§ 5 i.": "five", "§ 6 a.": "six a", "§ 9.": None}


def test_deferred_links(spark):
    pending = spark.createDataFrame([(1, "s1", "A", "§ 1.", ["A"]), (2, "s2", "A", None, []), (3, "s3", "B", "§ 1.", [])], "ref_no long, src string, law string, name string, need array<string>")
    concepts = spark.createDataFrame([("A", "A", "A", []), ("§ 1._A", "A", "§ 1.", ["A"])], "id string, law_id string, name string, parents array<string>")
    links, rest = cite.link_deferred(pending, concepts)
    assert {tuple(r) for r in links.collect()} == {("s1", "§ 1._A"), ("s2", "A")} and [r.ref_no for r in rest.collect()] == [3]


def test_absurd_numbers_give_defined_rows(spark):
    par = lambda t: [[n, *p] for n, p in rows(spark, t, cite.paragraph_refs, "target_name", "target_parents")]
    assert par("§ 5, stk. 99999999999") == [[f"{P}5."]]
    assert par("§ 5, stk. 1-2000000000") == [["Stk. 1.", f"{P}5."], ["Stk. 2000000000.", f"{P}5."]]
    assert par("§ 5, stk. 3-1") == [["Stk. 3.", f"{P}5."], ["Stk. 1.", f"{P}5."]]
    assert par("§ 5, nr. 99999999999, 2 og 4") == [["2)", "Stk. 1.", f"{P}5."], ["4)", "Stk. 1.", f"{P}5."]]
    assert len(par("§ 5, stk. 1-1000")) == 1000 and len(par("§ 5, stk. 1-1001")) == 2
    assert rows(spark, "se 99999999999. pkt. her", cite.pkt_refs, "pkt") == [] and rows(spark, "se 2. pkt. her", cite.pkt_refs, "pkt") == [(2,)]
    ends = spark.createDataFrame([("L", f"{P}1.", f"{P}99999999999999999999."), ("L", f"{P}1.", f"{P}999999999999999999.")], "law_id string, first string, last string")
    pars = spark.createDataFrame([("L", f"{P}1.", "x"), ("L", f"{P}999999999999999999.", "y")], "law_id string, name string, id string")
    assert cite.expand_ranges(ends, pars).count() == 0


def test_the_end_of_a_range_takes_no_preposition(spark):
    assert rows(spark, "efter §§ 1-3 i loven", cite.range_refs, "first", "last") == [(f"{P}1.", f"{P}3.")]
    assert rows(spark, "efter §§ 1 i-3 b i loven", cite.range_refs, "first", "last") == [(f"{P}1 i.", f"{P}3 b.")]


def test_thousands_of_cues_in_one_pass(spark):
    cues = [(f" lov nr {k} om emne", f"L{k}") for k in range(5000)] + [(" Æbleloven", ""), (" æbleloven", "again"), ("nr 7 om", "inner")]
    texts = ["Efter lov nr 7 om emne og LOV NR 4999 om emne, lov nr 7 om emne", "Den ÆBLELOVEN gælder", " lov nr 50000 om emne", None, "", "intet"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = sorted((r.id, r.cue_no, r.law) for r in cite.external_hits(df, "id", "text", cues).collect())
    want = [(i, n, w or c.strip()) for i, t in enumerate(texts) for n, (c, w) in enumerate(cues) if t and c.lower() in t.lower()]
    assert found == sorted(want) and len(found) == 5
    assert cite.external_hits(df, "id", "text", []).count() == 0
    whole = {r.id: r.law for r in cite.whole_law_refs(df, "id", "text", cues).collect()}
    assert whole == {0: "L7", 1: "Æbleloven"}
