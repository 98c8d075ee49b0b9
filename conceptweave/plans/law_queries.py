"""Queries of the engine's entry points, over laws in both dialects that are made of the keys of ``supplier``.

Spark reads the laws' HTML as ``engine.ingest`` reads any; the SQL knows nothing of HTML and states the concepts that must come out.
Law k: every seventh is of a type without extractor. Of the laws of type LOV those with an even key are written like an LBK.
It has k % 4 chapters of two paragraphs, in sections of two chapters in some LBK, or else three paragraphs. Paragraph p has
1 + (p + k) % 3 subsections, the last with (p + k) % 3 list items, the first of which has a nested one in LBK of an even p. Some
LBK end with two omitted paragraphs. What follows the last paragraph, or stands outside the law's own element, is no part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import engine
from ..functions.text import tokens_sql
from ..tables import written
from .base import query, table

LETTER = "CASE WHEN (p + k) % 6 = 0 THEN ' a' ELSE '' END"
FIRST = "concat('Pligten i punkt ', p, ' gælder ca. 2 gange, jf. § 1, stk. 1, og §§ 2-3. Fristen er ', k % 9 + 1, ' dage efter stk. 1.')"
SECOND = "'Uanset denne paragrafs bestemmelser kan 2. pkt. fraviges. Resten følger af lov om social service.'"
THIRD = "concat('Stykke 3 af ', p, ' er uden henvisning.')"


def laws(spark, sf) -> DataFrame:
    """(doc_id, doc_type, short_name, name, html)."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("doc_type", F.expr("CASE WHEN k % 7 = 6 THEN 'BEK' WHEN k % 3 = 0 THEN 'LOV' ELSE 'LBK' END"))
    rows = rows.withColumns({"lov": F.expr("doc_type = 'LOV' AND k % 2 = 1"), "n": F.expr("CASE WHEN k % 4 > 0 THEN 2 * (k % 4) ELSE 3 END")})
    rows = rows.withColumn("p", F.explode(F.expr("sequence(1, n)"))).withColumns({"ch": F.expr("CASE WHEN k % 4 > 0 THEN (p + 1) div 2 ELSE 0 END"), "t": F.expr("1 + (p + k) % 3"), "i": F.expr("(p + k) % 3")})
    rows = rows.withColumn("sec", F.expr("CASE WHEN NOT lov AND k % 5 < 2 AND ch > 0 THEN (ch + 1) div 2 ELSE 0 END"))
    lbk = f"""concat(
      CASE WHEN sec > 0 AND p % 4 = 1 THEN concat('<p class="Afsnit">Afsnit</p><p class="AfsnitOverskrift">Del ', sec, '</p>') ELSE '' END,
      CASE WHEN ch > 0 AND p % 2 = 1 THEN concat('<p class="Kapitel">Kapitel</p><p class="KapitelOverskrift2">Emne ', ch, '</p>') ELSE '' END,
      '<p class="ParagrafGruppeOverskrift">Gruppe</p><p class="Paragraf"><span class="ParagrafNr">§ ', p, {LETTER}, '.</span> ', {FIRST}, '</p>',
      CASE WHEN t >= 2 THEN concat('<p class="Stk2">', {SECOND}, '</p>') ELSE '' END, CASE WHEN t >= 3 THEN concat('<p class="Stk2">', {THIRD}, '</p>') ELSE '' END,
      CASE WHEN i >= 1 THEN '<p class="Liste1"><span class="Liste1Nr">1)</span> det første punkt</p>' ELSE '' END,
      CASE WHEN i >= 1 AND p % 2 = 0 THEN '<p class="Liste2"><span class="Liste2Nr">a)</span> et indre led</p>' ELSE '' END,
      CASE WHEN i >= 2 THEN '<p class="Liste1"><span class="Liste1Nr">2)</span> det andet punkt</p>' ELSE '' END)"""
    lov = f"""concat(
      CASE WHEN ch > 0 AND p % 2 = 1 THEN concat('<div class="KAPITEL"><p class="Kapiteloverskrift">Emne ', ch, '</p>') ELSE '' END,
      '<div class="PARAGRAF"><p class="Paragraftekst"><b>§ ', p, {LETTER}, '.</b> ', {FIRST}, '</p>\\r\\n',
      CASE WHEN t >= 2 THEN concat('<p class="Stk"><i>Stk. 2.</i> ', {SECOND}, '</p>') ELSE '' END, CASE WHEN t >= 3 THEN concat('<p class="Stk"><i>Stk. 3.</i>  ', {THIRD}, '</p>') ELSE '' END,
      CASE WHEN i >= 1 THEN '<p class="Nummer">1) det første punkt</p>' ELSE '' END, CASE WHEN i >= 2 THEN '<p class="Aendringspunkt">2. det andet punkt</p>' ELSE '' END,
      '</div>', CASE WHEN ch > 0 AND p % 2 = 0 THEN '</div>' ELSE '' END)"""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.when(F.col("lov"), F.expr(lov)).otherwise(F.expr(lbk)).alias("piece")))), lambda x: x["piece"]), "")
    whole = rows.groupBy("k", "doc_type", "lov", "n").agg(body.alias("body"))
    end = """concat(CASE WHEN k % 4 = 1 THEN concat('<p class="Paragraf"><span class="ParagrafNr"></span><span class="Bold">§§ ', n + 1, '-', n + 2, '</span> (Udelades)</p>') ELSE '' END,
      '<p class="Givet">Givet</p><p class="Paragraf"><span class="ParagrafNr">§ 99.</span> Ikke med.</p><hr class="IKraftStreg"><p class="Paragraf"><span class="ParagrafNr">§ 98.</span> Ikke med.</p>')"""
    outside = '<div class="PARAGRAF"><p class="Paragraftekst"><b>§ 97.</b> Ikke med.</p></div>'
    html = F.when(F.col("lov"), F.concat(F.lit(f'{outside}<div id="INDHOLD">'), "body", F.lit(f"</div>{outside}"))).otherwise(F.concat(F.lit('<p class="TekstGenerel">Overskrift</p>'), "body", F.expr(end)))
    short = F.concat("doc_type", F.lit(" nr "), "k", F.lit(" af 2020"))
    return whole.select(F.concat(F.lit("d"), "k").alias("doc_id"), "doc_type", short.alias("short_name"), F.concat(F.lit("Lov "), "k").alias("name"), html.alias("html"))


S = "'§' || chr(160)"
EXPECTED = f"""
law AS (SELECT *, typ || ' nr ' || k || ' af 2020' AS law, typ = 'LOV' AND k % 2 = 1 AS lov, CASE WHEN k % 4 > 0 THEN 2 * (k % 4) ELSE 3 END AS n FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 6 THEN 'BEK' WHEN s_suppkey % 3 = 0 THEN 'LOV' ELSE 'LBK' END AS typ FROM supplier)),
p0 AS (SELECT *, unnest(range(1, n + 1)) AS p FROM law WHERE typ <> 'BEK'),
p1 AS (SELECT *, CASE WHEN k % 4 > 0 THEN (p + 1) // 2 ELSE 0 END AS ch, 1 + (p + k) % 3 AS t, (p + k) % 3 AS i, {S} || p || {LETTER} || '.' AS name FROM p0),
p2 AS (SELECT *, CASE WHEN NOT lov AND k % 5 < 2 AND ch > 0 THEN (ch + 1) // 2 ELSE 0 END AS sec FROM p1),
p3 AS (SELECT *, list_concat(CASE WHEN sec > 0 THEN ['Afsnit ' || sec] ELSE []::VARCHAR[] END, [law]) AS over FROM p2),
par AS (SELECT *, list_concat(CASE WHEN ch > 0 THEN ['Kapitel ' || ch] ELSE []::VARCHAR[] END, over) AS up FROM p3),
gone AS (SELECT k, law, {S} || (n + x) || '.' AS name, n + x AS p, up FROM par, range(1, 3) r(x) WHERE p = n AND NOT lov AND k % 4 = 1),
stk AS (SELECT *, 'Stk. ' || j || '.' AS stk, list_concat([name], up) AS in_par FROM (SELECT *, unnest(range(1, t + 1)) AS j FROM par)),
item AS (SELECT *, j || ')' AS item, list_concat(['Stk. ' || t || '.', name], up) AS in_stk FROM (SELECT *, unnest(range(1, i + 1)) AS j FROM par WHERE i > 0)),
said AS (
  SELECT k, law, list_concat([stk], in_par) AS parents, j, unnest(CASE j WHEN 1 THEN ['Pligten i punkt ' || p || ' gælder ca. 2 gange, jf. § 1, stk. 1, og §§ 2-3.', 'Fristen er ' || (k % 9 + 1) || ' dage efter stk. 1.']
    WHEN 2 THEN ['Uanset denne paragrafs bestemmelser kan 2. pkt. fraviges.', 'Resten følger af lov om social service.'] ELSE ['Stykke 3 af ' || p || ' er uden henvisning.'] END) AS raw_text,
    unnest(CASE WHEN j < 3 THEN [1, 2] ELSE [1] END) AS place FROM stk
  UNION ALL SELECT k, law, list_concat([item], in_stk), NULL, CASE j WHEN 1 THEN 'det første punkt' ELSE 'det andet punkt' END, 1 FROM item
  UNION ALL SELECT k, law, list_concat(['a)', '1)'], in_stk), NULL, 'et indre led', 1 FROM item WHERE j = 1 AND NOT lov AND p % 2 = 0),
every AS (
  SELECT k, law AS name, 'lov' AS kind, NULL::VARCHAR AS subkind, 1 AS position, []::VARCHAR[] AS parents, NULL::VARCHAR AS short_name, NULL::VARCHAR AS raw_text FROM law WHERE typ <> 'BEK'
  UNION ALL SELECT DISTINCT k, 'Afsnit ' || sec, 'section', NULL, sec, [law], 'Del ' || sec, NULL FROM par WHERE sec > 0
  UNION ALL SELECT DISTINCT k, 'Kapitel ' || ch, 'chapter', NULL, ch, over, 'Emne ' || ch, NULL FROM par WHERE ch > 0
  UNION ALL SELECT k, name, 'paragraf', NULL, p, up, NULL, NULL FROM par
  UNION ALL SELECT k, name, 'paragraf', NULL, p, up, NULL, NULL FROM gone
  UNION ALL SELECT k, stk, 'stk', NULL, j, in_par, NULL, NULL FROM stk
  UNION ALL SELECT k, item, 'list', 'number', j, in_stk, NULL, NULL FROM item
  UNION ALL SELECT k, 'a)', 'list', 'litra', 1, list_concat(['1)'], in_stk), NULL, NULL FROM item WHERE j = 1 AND NOT lov AND p % 2 = 0
  UNION ALL SELECT k, place || '. pkt.', 'sentence', NULL, place, parents, NULL, raw_text FROM said),
concept AS (SELECT *, array_to_string(list_concat([name], parents), '_') AS id, CASE WHEN len(parents) > 0 THEN array_to_string(parents, '_') END AS parent_id, len(parents) AS level FROM every),
pars AS (SELECT k, name, id, regexp_extract(name, '([0-9]+)', 1)::INT * 100 + CASE WHEN name LIKE '% a.' THEN 1 ELSE 0 END AS pos FROM concept WHERE kind = 'paragraf'),
sentence AS (SELECT k, j, place, array_to_string(list_concat([place || '. pkt.'], parents), '_') AS id, array_to_string(parents, '_') AS stk_id, array_to_string(parents[2:], '_') AS par_id FROM said WHERE j IS NOT NULL),
ref AS (
  SELECT s.id AS src, 'Stk. 1._' || q.id AS dst FROM sentence s JOIN pars q USING (k) WHERE s.j = 1 AND s.place = 1 AND q.pos = 100
  UNION SELECT s.id, q.id FROM sentence s JOIN pars q USING (k) WHERE s.j = 1 AND s.place = 1 AND q.pos BETWEEN 200 AND 300
  UNION SELECT id, 'Stk. 1._' || par_id FROM sentence WHERE j = 1 AND place = 2
  UNION SELECT id, '2. pkt._' || stk_id FROM sentence WHERE j = 2 AND place = 1
  UNION SELECT s.id, c.id FROM sentence s JOIN concept c ON c.parent_id = s.par_id AND c.kind = 'stk' WHERE s.j = 2 AND s.place = 1 AND c.id <> s.stk_id),
edge AS (SELECT id AS src, parent_id AS dst, 'parent' AS type FROM concept WHERE parent_id IS NOT NULL UNION ALL SELECT parent_id, id, 'child' FROM concept WHERE parent_id IS NOT NULL
  UNION ALL SELECT src, dst, CASE WHEN dst IN (SELECT id FROM concept) THEN 'ref_to' ELSE 'ref_to_UNKNOWN' END FROM ref UNION ALL SELECT dst, src, 'ref_from' FROM ref WHERE dst IN (SELECT id FROM concept))"""


@query("law_concepts", f"WITH {EXPECTED} SELECT 'd' || k AS law_id, id, name, kind, subkind, position::INT AS position, parent_id, level::INT AS level, short_name, raw_text FROM concept")
def law_concepts(spark, sf):
    """Both dialects, from HTML to the tree."""
    return engine.ingest(laws(spark, sf))["concepts"].select("law_id", "id", "name", "kind", "subkind", "position", "parent_id", "level", "short_name", "raw_text")


@query("concept_counts", f"WITH {EXPECTED} SELECT kind, count(*) AS n FROM concept GROUP BY 1")
def concept_counts(spark, sf):
    """Nodes of all kinds in one table, counted."""
    return engine.ingest(laws(spark, sf))["concepts"].groupBy("kind").agg(F.count("*").alias("n"))


@query("law_edges", f"WITH {EXPECTED} SELECT src, dst, type FROM edge")
def law_edges(spark, sf):
    """Containment and resolved citations."""
    return engine.ingest(laws(spark, sf))["edges"].select("src", "dst", "type")


@query("law_pending", f"WITH {EXPECTED} SELECT id AS src, 'lov om social service' AS law, NULL::VARCHAR AS name FROM sentence WHERE j = 2 AND place = 2")
def law_pending(spark, sf):
    """Citations of laws that are not loaded."""
    return engine.ingest(laws(spark, sf))["pending"].select("src", "law", "name")


@query("law_quarantine", "SELECT 'd' || s_suppkey AS doc_id FROM supplier WHERE s_suppkey % 7 = 6")
def law_quarantine(spark, sf):
    return engine.ingest(laws(spark, sf))["quarantine"].select("doc_id")


@query("law_update", f"""WITH {EXPECTED}, w AS (SELECT unnest({tokens_sql('raw_text')}) AS word, id FROM concept WHERE kind = 'sentence')
SELECT word, count(DISTINCT id) AS df, round(ln((SELECT count(*) FROM concept WHERE kind = 'sentence')::DOUBLE / (count(DISTINCT id) + 1)), 6) AS idf FROM w GROUP BY 1""")
def law_update(spark, sf):
    """Laws that come in two parts, some of them twice: what is new replaces what is old, and the idf follows from signed counts."""
    from ..operators import stats

    every = written(laws(spark, sf), "laws")
    key = F.substring("doc_id", 2, 9).cast("long")
    base = engine.ingest(every.filter(key % 3 > 0))
    base = engine.ingest(every.filter(key % 3 < 2), base=base)
    return stats.inverse_frequency(base["frequencies"].filter("word <> ''"), engine.texts_of(base)).withColumn("idf", F.round("idf", 6))


CITED = "lov om social service"  # law 1 by the name that other laws give it
RELINKED = EXPECTED.replace("typ || ' nr ' || k || ' af 2020' AS law", f"CASE WHEN k = 1 THEN '{CITED}' ELSE typ || ' nr ' || k || ' af 2020' END AS law")


@query("law_relinked", f"""WITH {RELINKED}, cites AS (SELECT id AS src, '{CITED}' AS dst FROM sentence WHERE j = 2 AND place = 2)
SELECT src, dst, type FROM edge WHERE type <> 'ref_to_UNKNOWN' UNION ALL SELECT src, dst, 'ref_to' FROM cites UNION ALL SELECT dst, src, 'ref_from' FROM cites""")
def law_relinked(spark, sf):
    """A base that was linked, in which a cited law and half of the citing ones were then replaced, linked again: as if all laws had come at once."""
    every = laws(spark, sf)
    key = F.substring("doc_id", 2, 9).cast("long")
    every = written(every.withColumn("short_name", F.when(key == 1, F.lit(CITED)).otherwise(F.col("short_name"))), "laws")
    base = engine.linked(engine.ingest(every))
    again = engine.ingest(every.filter(key % 2 == 1), base=base)
    return engine.linked(again)["edges"]


@query("law_answers")
def law_answers(spark, sf):
    """All ten measures of questions to the finished base; the questions are the texts of some paragraphs. Tested against the parts it is made of."""
    from ..operators import stats
    from .base import word_vec_id

    base = engine.ingest(laws(spark, sf))
    embeddings = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    words = stats.word_rows(base["sentences"], "id").select("word").distinct()
    vectors = written(words.withColumn("vec_id", word_vec_id(F.col("word"), embeddings.count())).join(embeddings, "vec_id").select("word", F.col("vec").cast("array<double>").alias("vec")), "word-vectors")
    base, _ = engine.finalise(base, vectors)
    asked = base["concepts"].filter("kind = 'sentence' and raw_text like 'Pligten i punkt 1 %'").select(F.xxhash64("id").alias("query_id"), F.col("raw_text").alias("text"))
    return engine.answer(base, vectors, asked)
