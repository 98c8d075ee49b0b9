"""Operator 6, secret scans: a trigram inverted index in front of the rules' regular expressions, by DataFrame functions only.

``trigram_query`` derives from a rule's expression which trigrams any match must hold: a list of alternatives, each a set of
trigrams that occur together (in lower case, as the index is); a rule for which nothing is mandatory has no query and scans
every text. ``build_index`` writes the postings (trigram, doc_id) of the trigrams that some rule asks for. ``candidates``
intersects the postings of each alternative and unites the alternatives. Candidates, and all texts for rules without query,
are then verified by the expression itself, leftmost and without overlap; matches whose tested group is too short are
dropped. Spans are in code points, with the end exclusive.

A list of candidates of up to ``BROADCAST_ROWS`` rows is broadcast after it was counted, a longer one joined by a shuffle.

Defined results: a null text is empty and has no span; rows that repeat an id share the union of their postings, and each is
verified on its own text; null ids take part; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, keyed, let, written

BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length is tested, 0 for the whole match."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False


#: The base rules, in their order.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9+/_.=~-]+", 27),
]
RULES = BASE + MORE

Query = list[frozenset[str]]
MOST = 64


#: One element of an expression and its count: a class, a group's beginning, an escape or a plain sign.
_ATOM = re.compile(r"(?P<set>\[\^?\]?(?:\\.|[^\]\\\[])*\])|(?P<open>\((?:\?:)?)|\\x(?P<hex>[0-9a-fA-F]{2})|\\(?P<esc>[dDwWsSbBhHvVAzZnrtf1-9]|[^0-9A-Za-z])|(?P<any>[.^$])|(?P<plain>[^\\()|\[\]{}?*+])", re.S)
_COUNT = re.compile(r"(?:([?*+])|\{(\d+)(,?)(\d*)\})[?+]?")


def _members(body: str) -> set[str] | None:
    """The signs of a class of at most four that names no range, else None."""
    inner = body[1:-1]
    if inner.startswith("^") or re.search(r"(?<!^)-(?!$)|\\", inner) or len(set(inner)) > 4:
        return None
    return set(inner)


class _Walk:
    """What any match of an expression must hold, found while it is read from left to right.

    What it does not understand for sure (unclosed or unopened groups, counts like ``{,3}``, class intersections and nested classes, other
    groups than plain ones, other escapes than common ones) is a ValueError: a rule never loses matches by being misread.

    ``expression`` gives (texts, query): all strings the expression can match, if they are few, else None and the query of any match.
    """

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def expression(self) -> tuple[set[str] | None, Query | None]:
        parts = [self.sequence()]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        if all(t is not None for t, _ in parts) and len(every := set().union(*(t for t, _ in parts))) <= MOST:
            return every, None
        return None, either([required(t) if t is not None else q for t, q in parts])

    def sequence(self) -> tuple[set[str] | None, Query | None]:
        runs, query, whole = {""}, None, True  # runs: what can stand since the last element of unknown text
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            texts, more = self.counted()
            if texts is not None and len(texts) * len(runs) <= MOST:
                runs = {a + b for a in runs for b in texts}
                continue
            query, whole = both(both(query, required(runs)), more if texts is None else required(texts)), False
            runs = {""}
        return (runs, None) if whole else (None, both(query, required(runs)))

    def counted(self) -> tuple[set[str] | None, Query | None]:
        m = _ATOM.match(self.text, self.at)
        if not m:
            raise ValueError(f"not understood from {self.at}: {self.text}")
        self.at, texts, query = m.end(), None, None
        if m["open"]:
            if self.text[self.at : self.at + 1] == "?":
                raise ValueError(f"groups of this kind are not understood: {self.text}")
            texts, query = self.expression()
            if self.text[self.at : self.at + 1] != ")":
                raise ValueError(f"a group is not closed: {self.text}")
            self.at += 1
        elif m["set"]:
            if "&&" in m["set"]:
                raise ValueError(f"intersections of classes are not understood: {self.text}")
            texts = _members(m["set"])
        elif m["hex"]:
            texts = {chr(int(m["hex"], 16))}
        elif m["esc"]:
            texts = None if m["esc"].isalnum() else {m["esc"]}
        elif m["plain"]:
            texts = {m["plain"]}
        if not (c := _COUNT.match(self.text, self.at)):
            return texts, query
        self.at = c.end()
        least = {"?": 0, "*": 0, "+": 1}[c[1]] if c[1] else int(c[2])
        if c[1] == "?" and texts is not None:
            return texts | {""}, None
        return None, None if not least else required(texts) if texts is not None else query


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3].lower() for i in range(len(text) - 2))


def both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)
    return list(dict.fromkeys(x | y for x in a for y in b))


def either(parts: list[Query | None]) -> Query | None:
    return None if any(p is None for p in parts) else list(dict.fromkeys(q for p in parts for q in p))


def required(texts: set[str]) -> Query | None:
    return either([[t] if (t := trigrams(x)) else None for x in sorted(texts)])


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of trigrams that must occur together, or None where a match may hold no trigram for sure."""
    walk = _Walk(pattern)
    texts, query = walk.expression()
    if walk.at < len(pattern):
        raise ValueError(f"a group is not opened: {pattern}")
    query = required(texts) if texts is not None else query
    return query and [a for a in query if not any(b < a for b in query)]  # an alternative that asks for more than another adds nothing


def build_index(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written postings (trigram, doc_id) of all trigrams that the rules' queries name."""
    named = sorted({t for r in rules for alt in trigram_query(r.pattern) or [] for t in alt})
    low = F.lower(F.col("text"))
    held = F.array_compact(let(low, lambda x: F.array(*[F.when(F.contains(x, F.lit(t)), F.lit(t)) for t in named]))) if named else F.array().cast("array<string>")
    return written(keyed(docs, id_col, text_col).select("doc_id", F.explode(held).alias("trigram")).distinct(), "postings")


def candidates(postings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, kinds): for each document the rules with queries that its postings fulfil."""
    wanted = [(r.kind, i, t, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.pattern) or []) for t in sorted(alt)]
    asked = postings.sparkSession.createDataFrame(wanted, "kind string, alternative int, trigram string, n_wanted int")
    met = postings.join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "alternative").agg(F.count("*").alias("n"), F.max("n_wanted").alias("n_wanted"))  # the rules are a fixed parameter
    return met.filter("n = n_wanted").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def running(sizes: Column) -> Column:
    """Sums of all sizes up to each, as one array: in blocks of about the root of their number, as appending to an array copies it."""

    def sums(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"] + x).alias("all")), lambda acc: acc["all"])

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def blocks(xs: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), n), lambda i: F.slice(xs, i, n))

    def joined_up(bs: Column) -> Column:
        return let(sums(F.transform(bs, total), F.lit(0)), lambda ends: F.flatten(F.transform(bs, lambda b, i: sums(b, F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))))))

    return let(let(sizes, blocks), joined_up)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, order, end, kind) of the rule's matches that are long enough."""
    flags = "(?is)" if rule.any_case else "(?s)"
    step = rf"\G{flags}(.*?)({rule.pattern})"  # what lies before a match, then the match
    assert rule.group <= re.compile(rule.pattern).groups
    lengths = lambda g: F.transform(F.regexp_extract_all(text, F.lit(step), F.lit(g)), F.char_length)
    none = F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>")

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: r["gap"] + r["size"]))
        hits = F.filter(F.zip_with(rows, ends, lambda r, e: F.struct(r["size"].alias("size"), r["tested"].alias("tested"), e.alias("end"))), lambda r: r["tested"] >= rule.least)
        return F.transform(hits, lambda r: F.struct((r["end"] - r["size"]).alias("start"), F.lit(order).alias("order"), r["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    found = let(F.arrays_zip(lengths(1).alias("gap"), lengths(2).alias("size"), lengths(2 + rule.group).alias("tested")), placed)
    likely = rule.pattern[:-1] + f"{{{rule.least},}}" if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("[") else rule.pattern
    return F.when(F.rlike(text, F.lit(flags + likely)), found).otherwise(none)


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: an array of (start, order, end, kind), sorted, of every row."""
    docs = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    likely = written(candidates(build_index(docs, rules), rules), "secret-candidates").withColumnRenamed("doc_id", "of")
    rows = docs.join(few(likely, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    none = F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>")
    each = [
        spans(F.col("text"), r, i) if trigram_query(r.pattern) is None else F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r, i)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = joined(F.filter("found", lambda s: s["order"] < len(BASE)))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def oracle() -> str:
    parts = []
    for order, r in enumerate(RULES):
        step = f"{'(?is)' if r.any_case else '(?s)'}(.*?)({r.pattern})".replace("'", "''")
        get = lambda g, step=step: f"unnest(regexp_extract_all(text, '{step}', {g}))"
        parts.append(f"""SELECT doc_id, '{r.kind}' AS kind, {order} AS ord, unnest(range(1, len(regexp_extract_all(text, '{step}', 1)) + 1)) AS i,
  {get(1)} AS gap, {get(2)} AS m, {get(2 + r.group)} AS tested, {r.least} AS least FROM docs""")
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, ord ORDER BY i)::BIGINT AS e FROM m),
s AS (SELECT doc_id, ord, kind, e - length(m) AS b, e, kind || ':' || (e - length(m)) || ':' || e AS x FROM placed WHERE length(tested) >= least)
SELECT docs.doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY b, ord) FILTER (WHERE ord < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY b, ord), '') AS spans
FROM docs LEFT JOIN s USING (doc_id) GROUP BY 1"""
