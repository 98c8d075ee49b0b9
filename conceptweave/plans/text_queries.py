"""Queries of the text, corpus and structure operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lexicon import STOPWORDS
from ..functions.text import clean_line, quoted, sentences, sentences_sql, tokens, tokens_sql
from ..operators import graph, report, stats, structure
from .base import BOW, SBOW, SENT, TOK, query, sentence_bow, sentence_rows, table

STOP_SQL = ", ".join(map(quoted, STOPWORDS))


@query("top_tfidf_terms", f"""WITH {BOW}, df AS (SELECT word, count(*) AS df FROM bow GROUP BY 1),
s AS (SELECT doc_id, word, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY doc_id) * ln((SELECT count(*) FROM documents)::DOUBLE / (df + 1)), 6) AS score FROM bow JOIN df USING (word)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM s)
SELECT doc_id, rank::INT AS rank, word, score FROM r WHERE rank <= 5""")
def top_tfidf_terms(spark, sf):
    return stats.top_terms(table(spark, sf, "documents"))


@query("sentence_split_query", f"WITH {SENT} SELECT doc_id, i::INT AS i, s FROM sent")
def sentence_split_query(spark, sf):
    return sentence_rows(spark, sf)


LAW_TEXT = "concat('Efter § 3, stk. ', p_partkey % 4 + 1, ', 1. og 2. pkt., jf. ', p_name, '. Den ', p_partkey % 9 + 1, '. januar bl.a. kr. ', p_size, '. Se nr. ', p_size, '. § ', p_partkey % 7, ' gælder f.eks. ikke! ', p_type, '.')"


def _law_split(dialect):
    sql = f"SELECT p_partkey, unnest(range(0, len(x)))::INT AS i, unnest(x) AS s FROM (SELECT p_partkey, {sentences_sql(LAW_TEXT, dialect)} AS x FROM part)"

    @query(f"sentence_split_{dialect}", sql)
    def split(spark, sf):
        return table(spark, sf, "part").select("p_partkey", F.posexplode(sentences(F.expr(LAW_TEXT), dialect)).alias("i", "s"))


_law_split("lov")
_law_split("lbk")


@query("corpus_clean", f"SELECT doc_id, i::INT AS i, line FROM (SELECT doc_id, i, array_to_string({tokens_sql('l', dates=True)}, ' ') AS line FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL)) WHERE line <> ''")
def corpus_clean(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    return lines.select("doc_id", "i", clean_line(F.col("l")).alias("line")).filter("line <> ''")


@query("bow_counts", f"WITH {BOW} SELECT * FROM bow")
def bow_counts(spark, sf):
    return stats.bag_of_words(table(spark, sf, "documents"), "doc_id")


@query("bow_in_vocabulary", f"WITH {BOW}, voc AS (SELECT word FROM bow GROUP BY 1 HAVING sum(cnt) >= 2) SELECT bow.* FROM bow SEMI JOIN voc USING (word)")
def bow_in_vocabulary(spark, sf):
    bow = stats.bag_of_words(table(spark, sf, "documents"), "doc_id")
    return stats.in_vocabulary(bow, bow.groupBy("word").agg(F.sum("cnt").alias("n")).filter("n >= 2")).select("doc_id", "word", "cnt")


@query("oov_words", f"WITH {TOK}, b AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM benchmark) SELECT word FROM b WHERE word NOT IN (SELECT word FROM tok GROUP BY 1 HAVING count(*) >= 2)")
def oov_words(spark, sf):
    known = stats.word_rows(table(spark, sf, "documents"), "doc_id").groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")
    return stats.out_of_vocabulary(stats.word_rows(table(spark, sf, "benchmark"), "item_id"), known)


@query("doc_freq", f"WITH {SBOW} SELECT word, count(*) AS df FROM sbow GROUP BY 1")
def doc_freq(spark, sf):
    return stats.document_frequency(sentence_bow(spark, sf))


@query("idf", f"WITH {SBOW} SELECT word, count(*) AS df, round(ln((SELECT count(*) FROM sent)::DOUBLE / (count(*) + 1)), 6) AS idf FROM sbow GROUP BY 1")
def idf(spark, sf):
    return stats.idf_of(sentence_rows(spark, sf).withColumnRenamed("s", "text"), "doc_id").withColumn("idf", F.round("idf", 6))


@query("term_frequency", f"WITH {BOW} SELECT doc_id, word, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY doc_id), 6) AS tf FROM bow")
def term_frequency(spark, sf):
    return stats.term_frequency(stats.bag_of_words(table(spark, sf, "documents"), "doc_id"), "doc_id").select("doc_id", "word", F.round("tf", 6).alias("tf"))


@query("word_stats", f"WITH {BOW}, df AS (SELECT word, count(*) AS df, sum(cnt)::BIGINT AS tf FROM bow GROUP BY 1), q AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM benchmark) SELECT df.* FROM df SEMI JOIN q USING (word)")
def word_stats(spark, sf):
    counts = stats.bag_of_words(table(spark, sf, "documents"), "doc_id").groupBy("word").agg(F.count("*").alias("df"), F.sum("cnt").alias("tf"))
    return counts.join(stats.word_rows(table(spark, sf, "benchmark"), "item_id").select("word").distinct(), "word", "left_semi")


@query("bow_size", f"WITH {BOW} SELECT doc_id, sum(cnt)::BIGINT AS size FROM bow GROUP BY 1")
def bow_size(spark, sf):
    return stats.bag_of_words(table(spark, sf, "documents"), "doc_id").groupBy("doc_id").agg(F.sum("cnt").alias("size"))


SPLIT = "list_filter(string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query("highlight_tokens", f"""WITH {BOW}, df AS (SELECT word, ln((SELECT count(*) FROM documents)::DOUBLE / (count(*) + 1)) AS idf FROM bow GROUP BY 1),
w AS (SELECT item_id, unnest(range(0, len({SPLIT}))) AS pos, regexp_replace(lower(unnest({SPLIT})), '[^a-zæøå]', '', 'g') AS word FROM benchmark),
x AS (SELECT item_id, pos, word, idf, CASE WHEN count(idf) OVER (PARTITION BY item_id) > 1 THEN max(idf) OVER (PARTITION BY item_id) ELSE (SELECT max(idf) FROM df) END AS m FROM w LEFT JOIN df USING (word))
SELECT item_id, pos::INT AS pos, word, CASE WHEN word IN ({STOP_SQL}) THEN 'strike' ELSE 'colour' END AS style, CASE WHEN word NOT IN ({STOP_SQL}) THEN round(idf / nullif(m, 0), 6) END AS intensity FROM x""")
def highlight_tokens(spark, sf):
    docs = table(spark, sf, "documents")
    weights = stats.inverse_frequency(stats.document_frequency(stats.bag_of_words(docs, "doc_id")), docs.count())
    words = F.filter(F.split(F.regexp_replace("text", "[ \\n]+", " "), " "), lambda w: w != "")
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(words).alias("pos", "word")).withColumn("word", F.regexp_replace(F.lower("word"), "[^a-zæøå]", ""))
    return report.highlights(rows, "item_id", weights, STOPWORDS, weights.agg(F.max("idf")).first()[0])


@query("distinct_sources", "SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf):
    return table(spark, sf, "documents").select("source").distinct()


@query("rollup_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def rollup_text(spark, sf):
    return stats.roll_up_text(table(spark, sf, "conversations").filter("text is not null"), "conv_id", "turn", "text")


@query("incremental_upsert", """WITH o AS (SELECT o_custkey AS id, o_orderkey AS "at", o_orderpriority AS text FROM orders), n AS (SELECT * FROM o WHERE id % 3 = 0)
SELECT id, "at", text FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC) = 1
UNION ALL SELECT c_custkey, 0, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT id FROM n)""")
def incremental_upsert(spark, sf):
    """Customers with the last of their orders as the new state, for a third of them."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("at"), F.col("c_mktsegment").alias("text"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("text")).filter("id % 3 = 0")
    return stats.upsert(old, new, ["id"], ["at"])


@query("dialect_dispatch", "SELECT page_id, t AS doc_type, CASE WHEN t = 'LBK' THEN 'lbk' WHEN t = 'LOV' THEN 'lov' ELSE 'quarantine' END AS dialect FROM (SELECT page_id, string_split(CASE page_id % 3 WHEN 0 THEN 'LBK nr 1' WHEN 1 THEN 'LOV nr 2' ELSE 'BEK nr 3' END, ' ')[1] AS t FROM pages)")
def dialect_dispatch(spark, sf):
    from ..sources.files import doc_type

    t = doc_type(F.expr("CASE page_id % 3 WHEN 0 THEN 'LBK nr 1' WHEN 1 THEN 'LOV nr 2' ELSE 'BEK nr 3' END"))
    return table(spark, sf, "pages").select("page_id", t.alias("doc_type"), structure.dialect(t).alias("dialect"))


# Blocks of web pages, by expressions on both sides; the parser of the engine is tested on fixtures and registered as html_blocks.
BLOCK = r"<(h1|h2|p|div|li)\b[^>]*>([^<]*)"
PAGE_BLOCKS = f"""pb AS (SELECT page_id, unnest(range(0, len(regexp_extract_all(html, '{BLOCK}', 1)))) AS ordinal, unnest(regexp_extract_all(html, '{BLOCK}', 1)) AS tag, unnest(regexp_extract_all(html, '{BLOCK}', 2)) AS text FROM pages)"""


def page_blocks(spark, sf):
    parts = F.arrays_zip(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(BLOCK), F.lit(2)).alias("text"))
    return table(spark, sf, "pages").select("page_id", F.posexplode(parts).alias("ordinal", "b")).select("page_id", "ordinal", "b.tag", "b.text")


@query("html_blocks_regex", f"WITH {PAGE_BLOCKS} SELECT page_id, ordinal::INT AS ordinal, tag, text FROM pb")
def html_blocks_regex(spark, sf):
    return page_blocks(spark, sf)


@query("html_blocks")
def html_blocks(spark, sf):
    from ..sources.html import html_blocks as blocks

    return blocks(table(spark, sf, "pages"), "page_id", "html")


@query("html_blocks_sql")
def html_blocks_sql(spark, sf):
    """The same blocks from SQL, by the registered table function and a lateral join; tested to be equal."""
    from .. import sql

    sql.register(spark)
    return spark.sql("SELECT p.page_id, b.* FROM {pages} p, LATERAL html_blocks(p.html) b", pages=table(spark, sf, "pages"))


@query("structure_counts", f"""WITH {PAGE_BLOCKS}
SELECT page_id, ordinal::INT AS ordinal, tag, coalesce(sum(CASE WHEN tag IN ('h1', 'h2') THEN 1 END) OVER w, 0)::BIGINT AS chapter, coalesce(sum(CASE WHEN tag = 'p' THEN 1 END) OVER w, 0)::BIGINT AS paragraph,
  last_value(CASE WHEN tag IN ('h1', 'h2') THEN text END IGNORE NULLS) OVER w AS chapter_name, row_number() OVER (PARTITION BY page_id, tag ORDER BY ordinal)::INT AS position
FROM pb WINDOW w AS (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def structure_counts(spark, sf):
    w = Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("tag").isin("h1", "h2")
    return page_blocks(spark, sf).select(
        "page_id", "ordinal", "tag", F.sum(F.when(head, 1).otherwise(0)).over(w).alias("chapter"), F.sum(F.when(F.col("tag") == "p", 1).otherwise(0)).over(w).alias("paragraph"),
        F.last(F.when(head, F.col("text")), ignorenulls=True).over(w).alias("chapter_name"), F.row_number().over(Window.partitionBy("page_id", "tag").orderBy("ordinal")).alias("position"),
    )


@query("whitespace_squeeze", "SELECT page_id, regexp_replace(replace(replace(replace(html, chr(13), ''), chr(10), ''), chr(9), ''), ' {2,}', ' ', 'g') AS html FROM pages")
def whitespace_squeeze(spark, sf):
    return table(spark, sf, "pages").select("page_id", structure.squeeze(F.col("html")).alias("html"))


NBSP = chr(160)


@query("paragraph_names", f"SELECT p_partkey, replace('§ ' || p_size || '.', '§ ', '§{NBSP}') AS name FROM part")
def paragraph_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", structure.paragraph_name(F.expr("concat('§ ', p_size, '.')")).alias("name"))


@query("omitted_range_expand", "SELECT p_partkey, unnest(range(p_size, p_size + p_partkey % 4 + 1))::INT AS number FROM part WHERE p_partkey % 3 = 0")
def omitted_range_expand(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '§ 1.' END").alias("number"), F.expr("concat('§§ ', p_size, '-', p_size + p_partkey % 4)").alias("bold"), F.lit("(Udelades)").alias("text"))
    span = structure.omitted(F.col("number"), F.col("bold"), F.col("text"))
    return rows.withColumn("o", span).filter("o is not null").select("p_partkey", F.explode(F.sequence("o.first", "o.last")).alias("number"))


@query("list_items", "SELECT l_orderkey, l_linenumber, item, CASE WHEN regexp_matches(item, '^[0-9]+.$') THEN 'number' ELSE 'litra' END AS kind FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber || ')' ELSE chr(96 + l_linenumber) || ')' END AS item FROM lineitem)")
def list_items(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_partkey % 2 = 0 THEN concat(l_linenumber, ')') ELSE concat(chr(96 + l_linenumber), ')') END").alias("item"))
    return rows.withColumn("kind", structure.item_kind(F.col("item")))


# The tree of orders: region, nation, customer, order.
@query("concept_ids", """SELECT 'O' || o_orderkey || '_C' || c_custkey || '_' || n_name || '_' || r_name AS id, 'C' || c_custkey || '_' || n_name || '_' || r_name AS parent_id, 3 AS level
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def concept_ids(spark, sf):
    return graph.with_ids(_orders_tree(spark, sf)).select("id", "parent_id", "level")


def _orders_tree(spark, sf):
    o, c, n, r = (table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat(F.lit("O"), "o_orderkey").alias("name"), F.array(F.concat(F.lit("C"), "c_custkey"), "n_name", "r_name").alias("parents"), "o_totalprice")


@query("random_concept", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 1")
def random_concept(spark, sf):
    """One concept drawn with a fixed seed."""
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(1)


@query("structure_rollup", """SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(r_name) + grouping(n_name) AS g
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def structure_rollup(spark, sf):
    rows = _orders_tree(spark, sf).select(F.col("parents")[2].alias("r_name"), F.col("parents")[1].alias("n_name"), "o_totalprice")
    out = rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), (F.grouping("r_name").cast("long") + F.grouping("n_name")).alias("g"))
    return out
