"""Citations: one composed grammar per form, classification, and resolution to concepts by joins.

``GRAMMAR`` gives each form as an expression in the common subset of Spark's and DuckDB's dialects. Numbers may have any number of
digits; a sign that no form matches is ignored, so extraction always ends. Everything a citation lists is a target of its own: where
several subsections, numbers or points are named, a deeper level belongs to each listed element of the level above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import EXTERNAL_CUES, RELATIVE_CUES, WHOLE_LAW_CUES
from ..tables import written

NBSP = chr(160)
WS = f"[ {NBSP}]"
NUM = "[0-9]+"
LIST = f"{NUM}(?:(?:, {NUM})*(?: og | eller ){NUM})?"
RANGE = f"{NUM}-{NUM}"
SOME = f"{RANGE}|{LIST}"
POINTS = f"((?:{NUM}[.], )*(?:{NUM}[.] (?:og|eller) )?{NUM}[.]) pkt[.]"
#: Below a paragraph; groups: stk, nr, pkt.
BELOW = f"(?:, stk[.] ({SOME}))?(?:, nr[.] ({SOME}))?(?:, {POINTS})?"
#: A paragraph without its sign; groups: number, letter, stk, nr, pkt.
PART = f"({NUM})(?: ([a-z])\\b)?{BELOW}"
PLAIN_PART = PART.replace("(?:", "\0").replace("(", "(?:").replace("\0", "(?:")
NEXT = "(?:, og |, eller |, | og | eller )"

#: Forms of a citation. Group 1 is the whole reference, but for ``pkt`` (the points) and ``item`` (the name).
#: ``single``: then as in PART; ``range``: first number and letter, last number and letter, then as in PART for a further paragraph;
#: ``stk``: stk, nr, pkt; ``part``: one paragraph of a list, as in PART.
GRAMMAR = {
    "single": f"(?:^|[^§])(§{WS}{PART})",
    "range": f"(§§{WS}({NUM})(?: ([a-z])\\b)?-({NUM})(?: ([a-hj-z])\\b)?(?:(?: og | eller ){PART})?)",  # ``i`` after the end is the preposition
    "list": f"(§§{WS}{PLAIN_PART}(?:{NEXT}{PLAIN_PART})+)",
    "part": f"(?:§§{WS}|{NEXT})({PART})",
    "stk": f"(?:^|[^0-9a-z, ]|[^0-9, ] |[a-z]{{2}} ?)(stk[.] ({SOME})(?:, nr[.] ({SOME}))?(?:, {POINTS})?)",
    "pkt": POINTS,
    "item": r"(?:^|[ ,(])([a-z]|[0-9]+)\)",
}


#: The most elements that a range names one by one. No law has as many subsections; a wider range, or one that runs backwards, names its ends.
WIDEST = 1000


def span(first: Column, last: Column) -> Column:
    """All numbers from first to last, or both ends of what is no usable range."""
    return F.when((first <= last) & (last - first < WIDEST), F.sequence(first, last)).otherwise(F.array(first, last))


def numbers(text: Column) -> Column:
    """The numbers that ``1``, ``1, 2 og 3`` or ``1-3`` names, in order; null stays null, and an empty text names one null.

    A number beyond an int names nothing; where no number is left, the one null stands for them, and the citation is to what is above."""
    none = F.array(F.lit(None).cast("int"))
    listed = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({NUM})"), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    ranged = text.rlike(f"^{RANGE}$") & (F.size(listed) == 2)
    return F.when((text == "") | (F.size(listed) == 0), none).when(ranged, span(F.get(listed, F.lit(0)), F.get(listed, F.lit(1)))).when(text.isNotNull(), listed)


def matches(text: Column, form: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(GRAMMAR[form]), F.lit(group))


def found(sentences: DataFrame, key: str, text: Column, form: str, names: list[str]) -> DataFrame:
    """(key, ord, names...): a row a match, a column a group, in order of the groups."""
    parts = F.arrays_zip(*[matches(text, form, g + 1).alias(n) for g, n in enumerate(names)])
    return sentences.select(key, F.posexplode(parts).alias("ord", "r")).select(key, "ord", *[F.col(f"r.{n}").alias(n) for n in names])


def each(rows: DataFrame, *levels: str) -> DataFrame:
    """A row for each combination of the numbers that the levels list; null where a level is not given."""
    for c in levels:
        rows = rows.withColumn(c, F.explode(numbers(F.col(c))))
    return rows


def paragraph(number: Column, letter: Column) -> Column:
    return F.concat(F.lit(f"§{NBSP}"), number.cast("string"), F.when(letter != "", F.concat(F.lit(" "), letter)).otherwise(F.lit("")), F.lit("."))


def paragraph_key(name: Column) -> Column:
    """Where a paragraph of this name stands among others: its number, then its letter."""
    letter = F.regexp_extract(name, f"{NUM} ([a-z])", 1)
    return F.try_add(F.try_multiply(F.regexp_extract(name, f"({NUM})", 1).try_cast("long"), F.lit(100)), F.when(letter == "", F.lit(0)).otherwise(F.ascii(letter) - 96))


def below(stk: Column, nr: Column, pkt: Column) -> Column:
    """The names that lead down from a paragraph, nearest first; numbers and points without subsection are in the first."""
    deep = nr.isNotNull() | pkt.isNotNull()
    stk_name = F.when(stk.isNotNull() | deep, F.concat(F.lit("Stk. "), F.coalesce(stk, F.lit(1)).cast("string"), F.lit(".")))
    return F.array_compact(F.array(F.concat(pkt.cast("string"), F.lit(". pkt.")), F.concat(nr.cast("string"), F.lit(")")), stk_name))


def named(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows with number, letter, stk, nr, pkt as one row per target: (key, ord, more..., paragraph, stk, nr, pkt, target_name, target_parents)."""
    rows = each(rows, "stk", "nr", "pkt").withColumn("paragraph", paragraph(F.col("number"), F.col("letter")))
    names = F.concat(below(F.col("stk"), F.col("nr"), F.col("pkt")), F.array("paragraph"))
    rows = rows.withColumn("names", names)
    return rows.select(key, "ord", *more, "paragraph", "stk", "nr", "pkt", F.get("names", F.lit(0)).alias("target_name"), F.slice("names", F.lit(2), F.size("names")).alias("target_parents"))


PART_NAMES = ["number", "letter", "stk", "nr", "pkt"]


def paragraph_refs(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """One row per target of single citations: the most specific it names, and the names above it up to the paragraph."""
    return named(found(sentences, key, F.col(text), "single", ["ref_string", *PART_NAMES]), key, "ref_string")


def list_refs(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """One row per target of listed citations, as of ``paragraph_refs``, with the place of the paragraph in its list."""
    lists = found(sentences, key, F.col(text), "list", ["ref_string"])
    parts = F.arrays_zip(*[matches(F.col("ref_string"), "part", g + 2).alias(n) for g, n in enumerate(PART_NAMES)])
    rows = lists.select(key, "ord", "ref_string", F.posexplode(parts).alias("place", "r")).select(key, "ord", "ref_string", "place", *[F.col(f"r.{n}").alias(n) for n in PART_NAMES])
    return named(rows, key, "ref_string", "place")


def range_refs(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, ref_string, first, last): the names of the first and last paragraph of a continuous range; see ``expand_ranges``."""
    rows = found(sentences, key, F.col(text), "range", ["ref_string", "a", "al", "b", "bl", *PART_NAMES])
    return rows.select(key, "ord", "ref_string", paragraph(F.col("a"), F.col("al")).alias("first"), paragraph(F.col("b"), F.col("bl")).alias("last"))


def range_extras(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """One row per target of the paragraph named after a range, as of ``paragraph_refs``."""
    rows = found(sentences, key, F.col(text), "range", ["ref_string", "a", "al", "b", "bl", *PART_NAMES]).filter("number <> ''")
    return named(rows, key, "ref_string")


def expand_ranges(ranges: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``ranges`` (law_id, first, last, ...) with (paragraph, target_id) of each paragraph that its law has between both, lettered ones too.

    ``paragraphs``: (law_id, name, id). The order is that of numbers and letters, which is the documents' own, and holds where an end is repealed.
    """
    known = paragraphs.select(F.col("law_id"), F.col("name").alias("paragraph"), F.col("id").alias("target_id"), paragraph_key(F.col("name")).alias("__at"))
    within = F.col("__at").between(paragraph_key(F.col("first")), paragraph_key(F.col("last")))
    return ranges.join(known, "law_id").filter(within).drop("__at")


def stk_refs(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """References within the paragraph: (key, ord, stk, nr, pkt), one row per target; those after a paragraph's number are not among them."""
    return each(found(sentences, key, F.col(text), "stk", ["whole", "stk", "nr", "pkt"]).drop("whole"), "stk", "nr", "pkt")


def pkt_refs(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """Sibling sentences named by point; those that follow a number and comma belong to another citation."""
    points = F.regexp_extract_all(F.col(text), F.lit(f"(^|[^0-9], |[^, ] |[^0-9 ], ?){GRAMMAR['pkt']}"), F.lit(2))
    rows = sentences.select(key, F.posexplode(points).alias("ord", "listed"))
    return rows.select(key, "ord", F.explode(numbers(F.col("listed"))).alias("pkt")).filter("pkt is not null")


def sibling_targets(sentences: DataFrame, text: str = "text") -> DataFrame:
    """(id, target_id) of sentences named by point: siblings under the same parent. ``sentences``: (id, parents, text)."""
    rows = pkt_refs(sentences, "id", text).join(sentences.select("id", "parents"), "id")
    return rows.select("id", F.concat_ws("_", F.concat(F.col("pkt").cast("string"), F.lit(". pkt.")), "parents").alias("target_id"))


def local_targets(sentences: DataFrame, text: str = "text") -> DataFrame:
    """(id, target_id) of references within the paragraph, which is the nearest element above that is one. ``sentences``: (id, parents, text)."""
    at = F.array_min(F.filter(F.transform("parents", lambda p, i: F.when(F.startswith(p, F.lit("§")), i)), lambda i: i.isNotNull()))
    anchors = sentences.select("id", F.slice("parents", at + 1, F.size("parents")).alias("anchor")).filter("anchor is not null")
    rows = stk_refs(sentences, "id", text).join(anchors, "id")
    return rows.select("id", F.concat_ws("_", below(F.col("stk"), F.col("nr"), F.col("pkt")), "anchor").alias("target_id"))


def item_refs(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """List items named as ``a)`` or ``1)``; they are extracted, but are no edges of the graph."""
    rows = sentences.select(key, F.posexplode(matches(F.col(text), "item", 1)).alias("ord", "item"))
    return rows.select(key, "ord", "item", F.when(F.col("item").rlike("^[0-9]+$"), F.lit("nr")).otherwise(F.lit("litra")).alias("kind"), F.lit(False).alias("in_graph"))


def reference_form(text: Column) -> Column:
    """Which form of citation a text holds: list and range need the double sign."""
    return F.when(text.rlike(GRAMMAR["range"]), F.lit("range")).when(text.rlike(GRAMMAR["list"]), F.lit("list")).when(text.rlike(GRAMMAR["single"]), F.lit("single")).otherwise(F.lit("none"))


def relative_refs(sentences: DataFrame, subsections: DataFrame, text: str = "text") -> DataFrame:
    """(id, target): all other subsections of the paragraph of a sentence that has a relative cue.

    ``sentences``: (id, paragraph_id, stk_id, text); ``subsections``: (paragraph_id, stk_id).
    """
    cue = F.lower(F.col(text)).rlike("|".join(RELATIVE_CUES))
    hits = sentences.filter(cue).select("id", "paragraph_id", F.col("stk_id").alias("own"))
    return hits.join(subsections, "paragraph_id").filter("stk_id <> own").select("id", F.col("stk_id").alias("target"))


Cues = list[tuple[str, str]]  # what a text says, and the law it means; an empty law is the cue itself


def external_hits(texts: DataFrame, key: str, text: str, cues: Cues = EXTERNAL_CUES) -> DataFrame:
    """(key, cue_no, cue, law) of the external laws that a text names, whatever the case: each cue once a text.

    One automaton over all cues goes over each text once, so thousands of names of laws cost no more than a few. The cues are a
    parameter of the driver, and go to the tasks as one broadcast."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    given = texts.sparkSession.sparkContext.broadcast([(c, law or c.strip()) for c, law in cues])
    rows = texts.select(F.col(key), F.lower(F.col(text)).alias("__low"))

    def search(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, (cue, _) in enumerate(given.value):
            automaton.add_word(cue.lower(), (*automaton.get(cue.lower(), ()), i))
        automaton.make_automaton()
        for batch in batches:
            at, numbers = [], []
            for row, low in enumerate(batch.column(1).to_pylist()):
                if low and given.value:
                    found = sorted({i for _, same in automaton.iter(low) for i in same})
                    at += [row] * len(found)
                    numbers += found
            if at:
                held = [given.value[i] for i in numbers]
                columns = [batch.column(0).take(pa.array(at)), pa.array(numbers, pa.int32()), pa.array([c for c, _ in held]), pa.array([w for _, w in held])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "cue_no", "cue", "law"])

    schema = StructType([rows.schema[0], *StructType.fromDDL("cue_no int, cue string, law string")])
    return rows.mapInArrow(search, schema)


def segments(text: Column) -> Column:
    return F.split(text, "(,| efter | sammenholdt med )", -1)


def classify(refs: DataFrame, texts: DataFrame, key: str, text: str, resolved: DataFrame, cues: Cues = EXTERNAL_CUES) -> DataFrame:
    """(key, ord, ref_class, law): external if reference and cue share a segment; else internal if all targets are in this law;
    else external by the first cue, if there is any.

    ``refs``: (key, ord, ref_string); ``resolved``: (key, ord, all_found).
    """
    cut = texts.select(key, F.posexplode(segments(F.col(text))).alias("seg", "part"))
    with_cue = external_hits(cut.select(key, "seg", F.struct(key, "seg").alias("k"), "part"), "k", "part", cues).select(F.col(f"k.{key}").alias(key), F.col("k.seg").alias("seg"), "cue_no", "law")
    shared = refs.select(key, "ord", F.get(segments(F.col("ref_string")), F.lit(0)).alias("head")).join(cut, key).filter(F.contains(F.col("part"), F.col("head"))).join(with_cue, [key, "seg"])
    near = shared.groupBy(key, "ord").agg(F.min(F.struct("cue_no", "law")).alias("near"))
    anywhere = with_cue.groupBy(key).agg(F.min(F.struct("cue_no", "law")).alias("any_cue"))
    rows = refs.join(near, [key, "ord"], "left").join(resolved, [key, "ord"], "left").join(anywhere, key, "left")
    found = F.coalesce("all_found", F.lit(False))
    kind = F.when(F.col("near").isNotNull(), F.lit("external")).when(found, F.lit("internal")).when(F.col("any_cue").isNotNull(), F.lit("external")).otherwise(F.lit("unresolved"))
    law = F.when(F.col("near").isNotNull(), F.col("near.law")).when(~found, F.col("any_cue.law"))
    return rows.select(key, "ord", kind.alias("ref_class"), law.alias("law"))


def resolve(refs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(…, target_id): the paragraph by name within the law; ``§ 5 i`` falls back to ``§ 5`` where the law has no paragraph of that letter.

    ``refs``: (law_id, paragraph); ``paragraphs``: (law_id, name, id). No-break spaces count as spaces.
    """
    spaced = lambda c: F.translate(c, NBSP, " ")
    names = paragraphs.select("law_id", spaced("name").alias("__name"), "id")
    rows = refs.withColumns({"__name": spaced("paragraph"), "__plain": F.regexp_replace(spaced("paragraph"), " [a-z][.]$", ".")})
    exact = rows.join(names.withColumnRenamed("id", "__exact"), ["law_id", "__name"], "left")
    loose = exact.join(names.select("law_id", F.col("__name").alias("__plain"), F.col("id").alias("__loose")), ["law_id", "__plain"], "left")
    return loose.withColumn("target_id", F.coalesce("__exact", "__loose")).drop("__exact", "__loose", "__plain", "__name")


def link_deferred(pending: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst) of pending references whose law is loaded, and those that remain pending.

    ``pending``: (ref_no, src, law, name, need array); ``concepts``: (id, law_id, name, parents). All needed ancestors must be among a
    concept's; a reference without a name is to the law itself. A letter that names no paragraph of the law falls away, as in ``resolve``.
    """
    whole = pending.filter("name is null").join(concepts.filter(F.size("parents") == 0).select(F.col("law_id").alias("law"), F.col("id").alias("dst")), "law")
    known = concepts.select(F.col("law_id").alias("law"), "name", "parents", F.col("id").alias("dst"))
    met = lambda rows: rows.join(known, ["law", "name"]).filter(F.size(F.array_except("need", "parents")) == 0)
    part = met(pending.filter("name is not null"))
    plain = lambda x: F.regexp_replace(x, "^(§.*[0-9]) [a-z][.]$", "$1.")
    rest = pending.filter("name is not null").join(part.select("ref_no").distinct(), "ref_no", "left_anti")
    loose = met(rest.withColumns({"name": plain(F.col("name")), "need": F.transform("need", plain)}))
    links = whole.select("ref_no", "src", "dst").unionByName(part.select("ref_no", "src", "dst")).unionByName(loose.select("ref_no", "src", "dst"))
    return links.select("src", "dst"), pending.join(links.select("ref_no").distinct(), "ref_no", "left_anti")


def whole_law_refs(texts: DataFrame, key: str, text: str, cues: Cues = EXTERNAL_CUES) -> DataFrame:
    """(key, internal, law): whether a sentence names its own law, and the first other law that it names."""
    low = F.lower(F.col(text))
    internal = low.rlike("|".join(f"{c}\\b" for c in WHOLE_LAW_CUES))
    first = external_hits(texts, key, text, cues).groupBy(key).agg(F.min(F.struct("cue_no", "law")).alias("c")).select(key, F.col("c.law").alias("law"))
    return texts.select(key, internal.alias("internal")).join(first, key, "left").filter("internal or law is not null")


def law_citations(sentences: DataFrame, paragraphs: DataFrame, text: str = "text", cues: Cues = EXTERNAL_CUES) -> tuple[DataFrame, DataFrame]:
    """All paragraph citations of sentences (id, law_id, text): resolved ones (id, target_id), and those to other laws (id, law, names, ref_string).

    ``paragraphs``: (law_id, name, id). A citation is classified as a whole; internal targets whose paragraph the law has not are dropped.
    """
    single = paragraph_refs(sentences, "id", text).withColumn("form", F.lit("single"))
    listed = list_refs(sentences, "id", text).drop("place").withColumn("form", F.lit("list"))
    extra = range_extras(sentences, "id", text).withColumn("form", F.lit("range"))
    laws = sentences.select("id", "law_id")
    refs = resolve(single.unionByName(listed).unionByName(extra).join(laws, "id"), paragraphs)
    under = F.concat_ws("_", F.when(F.size("target_parents") > 0, F.concat(F.array("target_name"), F.slice("target_parents", F.lit(1), F.size("target_parents") - 1))).otherwise(F.array().cast("array<string>")), F.col("target_id"))
    plain = refs.select("id", "form", "ord", "ref_string", F.concat(F.array("target_name"), "target_parents").alias("names"), F.when(F.col("target_id").isNotNull(), under).alias("target_id"))
    ranges = range_refs(sentences, "id", text).join(laws, "id")
    spread = expand_ranges(ranges, paragraphs).select("id", F.lit("range").alias("form"), "ord", "ref_string", F.array("paragraph").alias("names"), "target_id")
    empty = ranges.join(spread.select("id", "ord").distinct(), ["id", "ord"], "left_anti").select("id", F.lit("range").alias("form"), "ord", "ref_string", F.array("first").alias("names"), F.lit(None).cast("string").alias("target_id"))
    every = written(plain.unionByName(spread).unionByName(empty).withColumn("ref", F.concat_ws(":", "form", F.col("ord").cast("string"))), "citations")  # the texts are searched once
    whole = every.groupBy("id", F.col("ref").alias("ord")).agg(F.first("ref_string").alias("ref_string"), F.bool_and(F.col("target_id").isNotNull()).alias("all_found"))
    kinds = classify(whole.select("id", "ord", "ref_string"), sentences.select("id", F.col(text).alias("text")), "id", "text", whole.select("id", "ord", "all_found"), cues).withColumnRenamed("ord", "ref")
    judged = written(every.join(kinds, ["id", "ref"]), "judged")
    inside = judged.filter("ref_class in ('internal', 'unresolved') and target_id is not null").select("id", "target_id").distinct()
    outside = judged.filter("ref_class = 'external'").select("id", "law", "names", "ref_string")
    return inside, outside
