"""From blocks to the containment tree: law, section, chapter, paragraph, subsection, list item, sentence.

Both dialects map their block classes to the same roles; running counts and last values over the blocks of a document then say to
which section, chapter, paragraph and so on each block belongs. No document is ever gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..sources.html import html_blocks, inside, unwrapped
from ..tables import written
from .cite import span
from .graph import with_ids
from .search import spread

NBSP = chr(160)

#: Classes of the two dialects.
LBK_ROLES = {
    "Afsnit": "section", "AfsnitOverskrift": "section_name", "Kapitel": "chapter", "KapitelOverskrift2": "chapter_name", "ParagrafGruppeOverskrift": "skip", "Tekst2": "skip",
    "Paragraf": "paragraph", "Stk2": "stk", "Liste1": "item", "Liste2": "nested", "IkraftTekst": "stop", "Givet": "stop",
}
LOV_ROLES = {"KAPITEL": "chapter", "Kapiteloverskrift": "chapter_name", "Paragraftekst": "paragraph", "Stk": "stk", "Nummer": "item", "Litra": "item", "Aendringspunkt": "item"}


def dialect(doc_type: Column) -> Column:
    """lbk and lov have extractors; other types are put aside."""
    return F.when(doc_type == "LBK", "lbk").when(doc_type == "LOV", "lov").otherwise("quarantine")


def cut_lbk(html: Column) -> Column:
    """Only what stands before the rule that separates repealed text."""
    return F.substring_index(html, '<hr class="IKraftStreg"', 1)


def squeeze(html: Column) -> Column:
    """Line ends and tabs go, runs of spaces become one."""
    return F.regexp_replace(F.translate(html, "\r\n\t", ""), " {2,}", " ")


def paragraph_name(number: Column) -> Column:
    return F.replace(number, F.lit("§ "), F.lit("§" + NBSP))


def law_blocks(laws: DataFrame, html: str = "html") -> DataFrame:
    """Blocks with role and dialect of laws (doc_id, doc_type, html) of both dialects; other types have none.

    An LBK is cut before its repealed part, and its paragraphs of general text are no blocks of their own. An LOV is what stands in the
    element INDHOLD; one without it, or without any paragraph there, is read as an LBK.
    """
    told = spread(laws.select("doc_id", dialect(F.col("doc_type")).alias("dialect"), F.col(html).alias("html")), "doc_id")
    lov = inside(html_blocks(told.filter("dialect = 'lov'").select("doc_id", squeeze(F.col("html")).alias("html"))), "INDHOLD")
    change = F.col("css_class") == "Aendringspunkt"  # its name ends with the first dot
    lov = written(roles(lov, LOV_ROLES).withColumns({
        "dialect": F.lit("lov"),
        "number": F.when(change, F.concat(F.replace(F.substring_index("text", ".", 1), F.lit(" "), F.lit("")), F.lit(")"))).otherwise(F.col("number")),
        "text": F.when(change, F.regexp_replace("text", r"^[^.]*\.\s*", "")).when(F.col("role").isin("paragraph", "stk", "item"), F.col("plain")).otherwise(F.col("text")),
    }), "lov-blocks")
    read = lov.filter("role = 'paragraph'").select("doc_id").distinct()
    lov = lov.join(read, "doc_id", "left_semi")
    rest = told.filter("dialect = 'lbk'").unionByName(told.filter("dialect = 'lov'").join(read, "doc_id", "left_anti"))
    lbk = unwrapped(html_blocks(rest.select("doc_id", cut_lbk(F.col("html")).alias("html"))), "TekstGenerel")
    return lov.unionByName(roles(lbk, LBK_ROLES).withColumn("dialect", F.lit("lbk")))


def roles(blocks: DataFrame, mapping: dict[str, str]) -> DataFrame:
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col("css_class")), F.lit("text"))
    return blocks.withColumn("role", role)


def omitted(number: Column, bold: Column, text: Column) -> Column:
    """First and last number of an omitted range, else null."""
    here = (F.trim(number) == "") & F.contains(text, F.lit("(Udelades)"))
    a, b = F.regexp_extract(bold, "([0-9]+)-([0-9]+)", 1), F.regexp_extract(bold, "([0-9]+)-([0-9]+)", 2)
    return F.when(here & a.try_cast("int").isNotNull() & b.try_cast("int").isNotNull(), F.struct(a.try_cast("int").alias("first"), b.try_cast("int").alias("last")))


def structured(blocks: DataFrame) -> DataFrame:
    """Blocks with role, and for each the numbers and names of the elements it stands in. ``blocks``: (doc_id, ordinal, role, number, bold, text)."""
    doc = Window.partitionBy("doc_id").orderBy("ordinal")
    run = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.min(F.when(F.col("role") == "stop", F.col("ordinal"))).over(Window.partitionBy("doc_id"))
    blocks = blocks.withColumn("stop", stop).filter("stop is null or ordinal < stop").filter("role <> 'skip'")
    count = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0)).over(run)
    rows = blocks.withColumns({"section": count("section"), "chapter": count("chapter"), "par_no": count("paragraph")}).filter("par_no > 0 or role in ('section', 'chapter', 'section_name', 'chapter_name')")
    par = Window.partitionBy("doc_id", "par_no").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stk_no", F.sum(F.when(F.col("role").isin("paragraph", "stk"), 1).otherwise(0)).over(par))
    stk = Window.partitionBy("doc_id", "par_no", "stk_no").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    par_name = F.when(F.trim("number") != "", F.trim("number")).otherwise(F.concat(F.regexp_extract("bold", "(§[^.]*)", 1), F.lit(".")))
    item = F.when(F.trim("number") != "", F.trim("number")).otherwise(F.regexp_extract("text", r"^\s*([0-9a-zæøå]+\))", 1))
    rows = rows.withColumns({
        "paragraph": F.last(F.when(F.col("role") == "paragraph", paragraph_name(par_name)), ignorenulls=True).over(par),
        "section_name": F.last(F.when(F.col("role") == "section_name", F.col("text")), ignorenulls=True).over(run),
        "chapter_name": F.last(F.when(F.col("role") == "chapter_name", F.col("text")), ignorenulls=True).over(run),
        "item_no": F.sum(F.when(F.col("role") == "item", 1).otherwise(0)).over(stk),
        "item": F.last(F.when(F.col("role") == "item", item), ignorenulls=True).over(stk),
        "nested": F.when(F.col("role") == "nested", item),
    })
    under = Window.partitionBy("doc_id", "par_no", "stk_no", "item_no").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("nested_no", F.sum(F.when(F.col("role") == "nested", 1).otherwise(0)).over(under)).drop("stop")


def item_kind(name: Column) -> Column:
    return F.when(name.rlike("^[0-9]+.$"), F.lit("number")).otherwise(F.lit("litra"))


def concept_rows(blocks: DataFrame, laws: DataFrame, dialect_name: str | None = None) -> DataFrame:
    """All nodes (law_id, name, kind, subkind, position, parents, short_name, raw_text, id, parent_id, level), one row per id.

    ``laws``: (doc_id, law_name). Sentences are split by the rules of ``dialect_name``, or of each block's column dialect. Sections and chapters are nodes only if they hold a paragraph; the sentences of a block hang on
    the deepest element it stands in, and are numbered within that element.
    """
    rows = written(structured(blocks).filter("par_no > 0").join(laws.select("doc_id", "law_name"), "doc_id"), "structured")
    none = F.lit(None).cast("string")
    section = F.when(F.col("section") > 0, F.concat(F.lit("Afsnit "), F.col("section")))
    chapter = F.when(F.col("chapter") > 0, F.concat(F.lit("Kapitel "), F.col("chapter")))
    above = lambda *parts: F.array_compact(F.array(*parts))
    law, stk = F.col("law_name"), F.concat(F.lit("Stk. "), F.col("stk_no"), F.lit("."))
    gone = rows.withColumn("o", omitted(F.col("number"), F.col("bold"), F.col("text")))
    spread = gone.filter("role = 'paragraph' and o is not null").withColumn("k", F.explode(span(F.col("o.first"), F.col("o.last")))).withColumns({"paragraph": F.concat(F.lit("§" + NBSP), F.col("k"), F.lit(".")), "par_no": F.col("par_no") + F.col("k") - F.col("o.first")})
    openings = gone.filter("role = 'paragraph'")  # a section or chapter that holds none is no concept
    rows = gone.filter("o is null").drop("o")
    text = F.when(F.col("role").isin("item", "nested"), F.regexp_replace("text", r"^\s*[0-9a-zæøå]+\)\s*", "")).otherwise(F.col("text"))

    def nodes(df: DataFrame, name: Column, kind: str, parents: Column, position: Column, subkind: Column = none, raw: Column = none, short: Column = none) -> DataFrame:
        return df.select(F.col("doc_id").alias("law_id"), name.alias("name"), F.lit(kind).alias("kind"), subkind.alias("subkind"), position.cast("int").alias("position"), parents.alias("parents"), short.alias("short_name"), raw.alias("raw_text"), "ordinal")

    split = sentences(text, dialect_name) if dialect_name else F.when(F.col("dialect") == "lbk", sentences(text, "lbk")).otherwise(sentences(text, "lov"))
    par_above, heads = above(chapter, section, law), rows.filter("role = 'paragraph'")
    in_item = F.col("item").isNotNull() & (F.col("item_no") > 0)
    base = above(F.when(F.col("nested").isNotNull(), F.col("nested")), F.when(in_item, F.col("item")), stk, F.col("paragraph"), chapter, section, law)
    said = rows.filter(~F.col("role").isin("section", "chapter", "section_name", "chapter_name")).filter(F.trim("text") != "").withColumn("base", base).select("doc_id", "ordinal", "base", F.posexplode(split).alias("i", "s"))
    place = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("ordinal", "i"))
    said = said.withColumn("place", place)
    union = [
        nodes(laws.withColumn("ordinal", F.lit(0)), law, "lov", F.array().cast("array<string>"), F.lit(1)),
        nodes(openings.filter("section > 0"), section, "section", above(law), F.col("section"), short=F.col("section_name")),
        nodes(openings.filter("chapter > 0"), chapter, "chapter", above(section, law), F.col("chapter"), short=F.col("chapter_name")),
        nodes(heads.unionByName(spread.select(*heads.columns)), F.col("paragraph"), "paragraf", par_above, F.col("par_no")),
        nodes(rows.filter("role in ('paragraph', 'stk')"), stk, "stk", above(F.col("paragraph"), chapter, section, law), F.col("stk_no")),
        nodes(rows.filter("role = 'item'"), F.col("item"), "list", above(stk, F.col("paragraph"), chapter, section, law), F.col("item_no"), item_kind(F.col("item"))),
        nodes(rows.filter("role = 'nested'"), F.col("nested"), "list", above(F.when(in_item, F.col("item")), stk, F.col("paragraph"), chapter, section, law), F.col("nested_no"), item_kind(F.col("nested"))),
        nodes(said, F.concat(F.col("place"), F.lit(". pkt.")), "sentence", F.col("base"), F.col("place"), none, F.trim("s")),
    ]
    every = union[0]
    for u in union[1:]:
        every = every.unionByName(u)
    keep = F.row_number().over(Window.partitionBy("law_id", "name", "parents").orderBy("ordinal"))
    return with_ids(every.withColumn("__k", keep).filter("__k = 1").drop("__k", "ordinal"))
