"""Text operators as column expressions, and the same steps as DuckDB SQL for the oracle.

A rewriting is a list of (pattern, replacement) steps in the common subset of both engines' expressions, with ``\\1`` for
groups; ``rewrite`` makes a Spark column of it, ``rewrite_sql`` a SQL expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS, MONTHS, STOPWORDS

Steps = list[tuple[str, str]]
MARK = "\ue000"  # stands for a dot that ends no sentence: a private-use sign, which no text has


def rewrite(text: Column, steps: Steps) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", by))
    return text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rewrite_sql(text: str, steps: Steps) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return text


def _cased(words: list[str]) -> str:
    return "|".join(x for w in words for x in (w, w[0].upper() + w[1:]))


def _abbreviation_masks() -> Steps:
    """One step for each shape of abbreviation: its parts become groups, so that every dot can be replaced."""
    parts = [a.rstrip(".").split(".") for a in ABBREVIATIONS]
    steps = []
    for first, *rest in (p for p in parts if len(p) > 1):
        body = "".join(rf"({x})\." for x in rest)
        steps.append((rf" ({_cased([first])})\.{body}", " \\1" + MARK + "".join(f"\\{i + 2}{MARK}" for i in range(len(rest)))))
    steps.append((rf" ({_cased([p[0] for p in parts if len(p) == 1])})\.", rf" \1{MARK}"))
    return steps


def sentence_steps(dialect: str = "query") -> Steps:
    """Steps that leave only the dots that end sentences. Dialects: query, lov, lbk."""
    months = "|".join(MONTHS)
    steps: Steps = [("[!?]", "."), (r"\.{2,}", ".")] if dialect == "query" else []
    steps += [(rf"([0-9])\. ({months})", rf"\1{MARK} \2"), *_abbreviation_masks()]
    listed = (r"([0-9])\., ([0-9])", rf"\1{MARK}, \2")
    steps += [listed, listed, (r"([0-9])\." if dialect == "lbk" else r"([0-9])\. ", rf"\1{MARK}" if dialect == "lbk" else rf"\1{MARK} ")]
    steps += [(rf"{MARK} ([A-Z])", r". \1"), (rf"{MARK} §", ". §"), (r"jf\.", f"jf{MARK}")]
    return steps


def sentences(text: Column, dialect: str = "query") -> Column:
    """The sentences of a text in order, each with its dot; a tail without one is a sentence too."""
    flat = text if dialect == "query" else F.regexp_replace(text, "[\r\n]", "")
    cut = F.split(F.regexp_replace(rewrite(flat, sentence_steps(dialect)), r"\.", ".\x01"), "\x01", -1)
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, MARK, ".")), lambda s: F.trim(s) != "")


def sentences_sql(text: str, dialect: str = "query") -> str:
    flat = text if dialect == "query" else f"regexp_replace({text}, '[\\r\\n]', '', 'g')"
    return f"list_filter(list_transform(string_split(replace({rewrite_sql(flat, sentence_steps(dialect))}, '.', '.' || chr(1)), chr(1)), lambda s: replace(s, '{MARK}', '.')), lambda s: trim(s, ' ') <> '')"


def clean_steps(newline_to_space: bool = False, dates: bool = False) -> Steps:
    """After lower-casing: abbreviations go, then all but letters and spaces. Line ends go as well unless made spaces."""
    steps: Steps = [(r"[\r\n]+", " ")] if newline_to_space else []
    steps += [(rf"([0-9])\. ({'|'.join(MONTHS)})", r"\1 \2")] if dates else []
    return [*steps, (f" ({'|'.join(re.escape(a) for a in ABBREVIATIONS)})", ""), ("[^a-zæøå ]+", "")]


def tokens(text: Column, stopwords: list[str] = STOPWORDS, **options: bool) -> Column:
    words = F.split(rewrite(F.lower(text), clean_steps(**options)), " +")
    return F.filter(words, lambda w: (w != "") & ~w.isin(stopwords))


def tokens_sql(text: str, stopwords: list[str] = STOPWORDS, **options: bool) -> str:
    listed = ", ".join(map(quoted, stopwords))
    return f"list_filter(string_split({rewrite_sql(f'lower({text})', clean_steps(**options))}, ' '), lambda w: w <> '' AND w NOT IN ({listed}))"


def clean_line(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """A line of the corpus for the training of vectors: dates keep their words, the rest as tokens with one space between."""
    return F.array_join(tokens(text, stopwords, dates=True), " ")
