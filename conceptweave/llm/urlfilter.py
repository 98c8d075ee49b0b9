"""Operator 12, URL filters: a weighted vocabulary found by an automaton, and host rules that go before it.

A URL is scanned once, A-Z lower-cased, by an Aho-Corasick automaton over all terms. An occurrence counts only between boundaries: the
sign before it and the one after it must be no ASCII letter or digit, so ``essex`` holds no ``sex``. One strict term blocks a
URL; soft terms do so when at least ``least_soft`` different ones occur, however often each of them does.

Rules are (host, path, verdict). A rule fits its host and all hosts below it, where the URL's path starts with the rule's path; the longest
fitting rule decides (of equally long ones that with the longer host), and only where none fits the vocabulary does. Rules and
terms are parameters of the driver and go to the tasks as one broadcast; hosts are looked up by their suffixes, so that a million rules cost
a URL no more than a few do.

Defined results: a null URL, or one without ``://``, has an empty host and path; a null or empty URL is allowed; a URL of any length is
scanned whole, once; repeated rows have equal results; an empty table gives no rows. Further columns are kept; those named like the results
are replaced. Escapes like ``%41`` are not decoded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import tidy

# Terms, each between boundaries.
STRICT = ["adult-x", "camgirl", "camgirls", "casino", "casinos", "hardcore", "hentai", "milf", "onlinecasino", "porn", "porno", "pornhub", "sexcam", "slots", "viagra", "warez", "xvideos", "xxx"]
SOFT = ["adult", "ads", "adult-content", "bet", "bets", "betting", "bonus", "cheap", "crack", "dating", "farm", "free", "gambling", "hot", "jackpot", "keygen", "nude", "pharmacy", "pill", "pills", "poker", "sex", "sexy", "spam", "track", "tracker", "win"]

#: The contract's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MADE = StructType([StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")] + [StructField(c, ArrayType(StringType())) for c in ("strict_terms", "soft_terms")])
RESULTS = MADE.names


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, lower-cased, and the path; both empty without ``://``."""
    there = url.isNotNull() & F.contains(url, F.lit("://"))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(there, F.translate(host, UPPER, LOWER)).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit(""))


class Terms:
    """The automaton, and the terms that a text holds between boundaries."""

    def __init__(self, strict: list[str], soft: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for weight, terms in ((0, soft), (1, strict)):  # a term in both lists is strict
            for t in terms:
                if t:
                    self.automaton.add_word(t.lower(), (t.lower(), weight))
        self.empty = not len(self.automaton)
        self.automaton.make_automaton()

    def found(self, url: str | None) -> tuple[list[str], list[str]]:
        """The different strict and soft terms, sorted."""
        if not url or self.empty:
            return [], []
        text, sets = url.translate(_LOWER), (set(), set())
        for end, (term, weight) in self.automaton.iter(text):
            start = end - len(term)
            if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                sets[weight].add(term)
        return sorted(sets[1]), sorted(sets[0])


_LOWER = str.maketrans(UPPER, LOWER)
_WORD = frozenset(LOWER + "0123456789")


class Rules:
    """Rules by host; ``best`` looks up the suffixes of a host at its dots."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        by: dict[str, list[tuple[int, str, str, str]]] = defaultdict(list)
        for host, path, verdict in rules:
            by[host.translate(_LOWER)].append((len(host) + len(path), path, host + path, verdict))
        self.by = {h: sorted(r, reverse=True) for h, r in by.items()}  # the longest first

    def best(self, host: str, path: str) -> tuple[str | None, str | None]:
        found, size, name = (None, None), -1, host
        while name:
            for n, start, rule, verdict in self.by.get(name, ()):
                if n <= size:
                    break
                if path.startswith(start):
                    found, size = (rule, verdict), n
                    break
            name = name.partition(".")[2]
        return found


def filter_urls(rows: DataFrame, rules: list[tuple[str, str, str]] = RULES, strict: list[str] = STRICT, soft: list[str] = SOFT, least_soft: int = 2, url_col: str = "url") -> DataFrame:
    """All rows with host, path, rule, verdict (allow or block), and the different strict_terms and soft_terms of the URL."""
    spark = rows.sparkSession
    given = spark.sparkContext.broadcast((rules, strict, soft))  # parameters: as large as the caller made them
    host, path = host_and_path(F.col(url_col).cast("string"))
    kept = [c for c in rows.columns if c == url_col or c not in RESULTS]
    named = rows.select(*kept, F.struct(F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path")).alias("__url"))
    made = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_terms", pa.list_(pa.string())), ("soft_terms", pa.list_(pa.string()))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms = Rules(given.value[0]), Terms(*given.value[1:])
        for batch in batches:
            out = []
            for u in batch.column(batch.num_columns - 1).to_pylist():
                rule, verdict = known.best(u["host"], u["path"])
                hard, mild = terms.found(u["url"])
                out.append({"host": u["host"], "path": u["path"], "rule": rule, "verdict": verdict or ("block" if hard or len(mild) >= least_soft else "allow"), "strict_terms": hard, "soft_terms": mild})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, made)], names=[*batch.schema.names[:-1], "__made"])

    schema = StructType([*named.select(*kept).schema, StructField("__made", MADE)])
    done = named.mapInArrow(lambda batches: tidy(judge(batches)), schema)
    return done.select(*[F.col(c) for c in kept if c not in RESULTS], *[F.col(f"__made.{c}").alias(c) for c in RESULTS])


def op12_urlfilter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.size("strict_terms").alias("n_strict"), F.size("soft_terms").alias("n_soft"))


def oracle() -> str:
    """The terms as one expression each, the rules as one condition each from the longest on."""
    held = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in order)
    return f"""
WITH cut AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, ({' + '.join(held(t) for t in STRICT)})::INT AS n_strict, ({' + '.join(held(t) for t in SOFT)})::INT AS n_soft FROM parts)
SELECT page_id, host, path, rule, CASE {verdict} WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM ruled"""
