"""Operator 2, language ID: a linear-chain conditional random field over the words of a text.

Each word, a run of letters (and their marks) in lower case, has features: its character n-grams of one to four characters, where those that
touch the word's beginning or end are its affixes, and whether it is in the lexicon of frequent words learned with the model. The
label of a word is a language; transitions between the labels of neighbouring words are learned. Forward-backward gives each
word's distribution over the languages in its context, so code-switched texts get labels word by word (``label_words``). A text's
language is the one with the largest mean probability over all its words, and its score is that mean.

Training maximises the likelihood of label sequences: forward-backward gives the expected labels and transitions that its gradient
needs. It reads only text and non-null label of the given rows, in a bounded sample: about ``per_label`` rows of each label by
smallest hash of id and text, of a text of more than ``chars_per_text`` characters about as many, in pieces of ``piece`` characters drawn
by a hash from the whole of it (before they leave the executor), and of these at most ``words_per_label`` words. More than ``most_labels`` labels are an error. Documents have one label each; so that
transitions between languages can be learned, training sequences are spliced from runs of words of different sample documents, some of them
of one language and others of several. Everything else, the prediction, covers whole texts of all rows.

Defined results: a null text, or one without a letter (signs like ``²`` or ``½`` are none), is ``und`` with score 0; of equally
likely languages the first in order is taken; repeated rows give repeated results; an empty table gives none; with no labelled row there is no language, and
every text is ``und``. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, tidy

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BITS = 17  # of a feature's place in the weights
ORDERS = (1, 2, 3, 4)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    lexicon: dict[str, int]  # word to row of lexical weights
    lexical: np.ndarray  # lexicon x labels
    moves: np.ndarray  # labels x labels, from and to


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features of all words, and where each word's features begin."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word_of = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(codes))
    hashed, owner, value = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros_like(codes)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        value = (value * np.uint64(0x100000001B3)) ^ (shifted + np.uint64(n))
        if n in ORDERS:
            inside = at + n <= ends
            mixed = value * np.uint64(0x9E3779B97F4A7C15)
            hashed.append((mixed >> np.uint64(64 - BITS)).astype(np.int64)[inside])
            owner.append(word_of[inside])
    hashed, owner = np.concatenate(hashed), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return hashed[order], np.searchsorted(owner[order], np.arange(len(words)))


def emissions(model: Model, words: list[str]) -> np.ndarray:
    """Scores of each word for each label."""
    if not words:
        return np.zeros((0, len(model.labels)), np.float32)
    rows, starts = feature_rows(words)
    counts = np.diff(np.append(starts, len(rows)))
    out = np.add.reduceat(model.weights[rows], starts, axis=0) / np.sqrt(counts)[:, None]
    for i, w in enumerate(words):
        k = model.lexicon.get(w)
        if k is not None:
            out[i] += model.lexical[k]
    return out.astype(np.float32)


def chains(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of a batch, scaled at each position, and the exponentials of the scores.

    ``scores``: position x sequence x label, sequences sorted by falling length; positions past a sequence's end hold no message.
    """
    t_max, n, k = scores.shape
    m = np.exp(moves - moves.max())
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    active = np.searchsorted(-lengths, -np.arange(t_max), side="left")  # sequences longer than t
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    a = e[0] / e[0].sum(1, keepdims=True)
    alpha[0] = a
    for t in range(1, t_max):
        c = active[t]
        a = (a[:c] @ m) * e[t, :c]
        a /= a.sum(1, keepdims=True)
        alpha[t, :c] = a
    b = np.ones((n, k), e.dtype) / k
    for t in range(t_max - 2, -1, -1):
        c = active[t + 1]
        nxt = (e[t + 1, :c] * b[:c]) @ m.T
        b[:c] = nxt / nxt.sum(1, keepdims=True)
        beta[t, :c] = b[:c]
    return alpha, beta, e


def forward_backward(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each position's distribution over the labels; arguments as of ``chains``."""
    alpha, beta, _ = chains(scores, moves, lengths)
    out = alpha * beta
    total = out.sum(2, keepdims=True)
    return out / np.where(total > 0, total, 1)


def expected_moves(alpha: np.ndarray, beta: np.ndarray, e: np.ndarray, moves: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the steps into positions ``t`` of sequences ``b`` of the distribution over pairs of labels: what came before, the move, what follows."""
    joint = alpha[t - 1, b][:, :, None] * np.exp(moves - moves.max())[None] * (e[t, b] * beta[t, b])[:, None, :]
    return (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def train(sample: list[tuple[str, str]], words_per_label: int = 60_000, run: int = 12, sequence: int = 60, epochs: int = 3, lexicon_size: int = 200, seed: int = 42, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Fit by stochastic gradient ascent on the likelihood of spliced sequences, with steps scaled by each weight's past gradients."""
    rng = np.random.default_rng(seed)
    labels = sorted({y for _, y in sample})
    k = len(labels)
    streams: dict[str, list[str]] = {y: [] for y in labels}
    for text, y in sample:
        if len(streams[y]) < words_per_label:
            streams[y] += WORD.findall(text.lower())
    streams = {y: w[:words_per_label] for y, w in streams.items()}
    counts = {y: Counter(w) for y, w in streams.items()}
    frequent = sorted({w for y in labels for w, _ in sorted(counts[y].items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]})
    model = Model(labels, np.zeros((1 << BITS, k), np.float32), {w: i for i, w in enumerate(frequent)}, np.zeros((len(frequent), k), np.float32), np.zeros((k, k), np.float32))
    if not k:
        return model
    runs = [(y, streams[labels[y]][i : i + run]) for y in range(k) for i in range(0, len(streams[labels[y]]), run)]
    past_w, past_l, past_m = (np.full_like(x, 1e-4) for x in (model.weights, model.lexical, model.moves))
    per, batch = max(1, sequence // run), 64
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        # every other sequence is of one language, as most texts are; the others mix runs as they come
        by = [runs[i] for i in order[: len(order) // 2]] + sorted((runs[i] for i in order[len(order) // 2 :]), key=lambda r: r[0])
        sequences = [by[i : i + per] for i in range(0, len(by), per)]
        sequences = [sequences[i] for i in rng.permutation(len(sequences))]
        for s in range(0, len(sequences), batch):
            group = sorted(([w for _, r in q for w in r], [y for y, r in q for _ in r]) for q in sequences[s : s + batch])
            group = sorted((g for g in group if g[0]), key=lambda g: -len(g[0]))
            if not group:
                continue
            lengths = np.array([len(g[0]) for g in group])
            flat = [w for g in group for w in g[0]]
            truth = np.zeros((len(flat), k), np.float32)
            truth[np.arange(len(flat)), [y for g in group for y in g[1]]] = 1
            scores = np.zeros((lengths[0], len(group), k), np.float32)
            firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            t, b = np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(group)), lengths)
            emitted = emissions(model, flat)
            scores[t, b] = emitted
            alpha, beta, e = chains(scores, model.moves, lengths)
            marginal = (alpha * beta)[t, b]
            gap = truth - marginal / marginal.sum(1, keepdims=True)
            pairs = np.setdiff1d(np.arange(len(flat)), firsts)
            move = truth[pairs - 1].T @ truth[pairs] - expected_moves(alpha, beta, e, model.moves, t[pairs], b[pairs])
            rows, starts = feature_rows(flat)
            n = np.diff(np.append(starts, len(rows)))
            used, inverse = np.unique(rows, return_inverse=True)
            spread = np.repeat(gap / np.sqrt(n)[:, None], n, axis=0)
            step = np.stack([np.bincount(inverse, spread[:, j], len(used)) for j in range(k)], 1).astype(np.float32)
            step -= decay * model.weights[used]
            past_w[used] += step**2
            model.weights[used] += rate * step / np.sqrt(past_w[used])
            lex = [(i, model.lexicon[w]) for i, w in enumerate(flat) if w in model.lexicon]
            if lex:
                i, j = np.array(lex).T
                step = np.zeros_like(model.lexical)
                np.add.at(step, j, gap[i])
                past_l += step**2
                model.lexical += rate * step / np.sqrt(past_l)
            past_m += move**2
            model.moves += rate * move / np.sqrt(past_m)
    return model


def label_words(model: Model, texts: list[str | None], block: int = 128, most: int = 150_000) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(place in texts, words, marginals) of every text that has words; texts of like length go through together."""
    found = [WORD.findall((t or "").lower()) for t in texts]
    order = sorted((i for i in range(len(texts)) if found[i]), key=lambda i: -len(found[i]))
    at = 0
    while at < len(order):
        size = max(1, min(block, most // len(found[order[at]])))
        part = order[at : at + size]
        at += size
        number: dict[str, int] = {}
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in found[i]), np.int64, len(found[i])) for i in part]
        scored = emissions(model, list(number))
        lengths = np.array([len(x) for x in ids])
        scores = np.zeros((lengths[0], len(part), len(model.labels)), np.float32)
        for b, x in enumerate(ids):
            scores[: len(x), b] = scored[x]
        marginals = forward_backward(scores, model.moves, lengths)
        for b, i in enumerate(part):
            yield i, found[i], marginals[: lengths[b], b]


def pieces(text: Column, chars: int, piece: int) -> Column:
    """A text of up to ``chars`` characters as it is; of a longer one about so many, in pieces of the whole of it that a hash draws, in their order."""
    n = F.char_length(text)
    drawn = lambda t, i: F.pmod(F.xxhash64(F.lit(11), F.xxhash64(t), i), F.char_length(t)) < F.lit(chars)
    held = F.transform(F.filter(F.sequence(F.lit(0), F.floor((n - 1) / piece).cast("int")), lambda i: drawn(text, i)), lambda i: F.substring(text, i * piece + 1, F.lit(piece)))
    return F.when(n <= chars, text).otherwise(F.array_join(held, "\n"))


def fit(labelled: DataFrame, per_label: int = 300, words_per_label: int = 60_000, chars_per_text: int = 50_000, piece: int = 500, most_labels: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> Model:
    """Train on a sample of the rows with label: of each label about ``per_label``, those with the smallest hash of id and text."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(label_col).alias("y")).filter(F.col("y").isNotNull() & F.col("text").isNotNull())
    counts = dict(rows.groupBy("y").count().limit(most_labels + 1).collect())
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    draw = F.pmod(F.xxhash64(F.lit(7), "i", "text"), F.lit(1 << 30))
    share = F.lit(0)
    for y, n in sorted(counts.items()):
        share = F.when(F.col("y") == y, F.lit(min(1 << 30, int((1 << 30) * 1.2 * per_label / n)))).otherwise(share)
    sample = rows.filter(draw < share).select("y", draw.alias("d"), pieces(F.col("text"), chars_per_text, piece).alias("text"))
    drawn = sorted(sample.limit(4 * per_label * max(1, len(counts))).collect(), key=lambda r: (r["d"], r["text"]))
    return train([(r["text"], r["y"]) for r in drawn], words_per_label, **options)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words and lang_shares (mean probability of each language) of every row."""
    schema = "doc_id long, lang_pred string, score double, n_words long, lang_shares map<string, double>"
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("lang_shares", pa.map_(pa.string(), pa.float64()))])
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS, the lexicon and the languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for at in range(0, len(whole), 400):
                batch = whole.slice(at, 400)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out: list[tuple] = [(i, "und", 0.0, 0, []) for i in ids]
                if model.labels:
                    for i, words, marginals in label_words(model, texts):
                        mean = marginals.mean(0, dtype=np.float64)
                        best = int(mean.argmax())
                        out[i] = (ids[i], model.labels[best], min(1.0, float(mean[best])), len(words), list(zip(model.labels, mean.tolist())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return keyed(docs, id_col, text_col).mapInArrow(lambda batches: tidy(predict(batches)), schema)


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, whose text has a language with at least ``least_score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for at in range(0, len(whole), 400):
                batch = whole.slice(at, 400)
                kept = np.zeros(len(batch), bool)
                if model.labels:
                    for i, _, marginals in label_words(model, batch.column(column).to_pylist()):
                        kept[i] = marginals.mean(0, dtype=np.float64).max() >= least_score
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(lambda batches: tidy(keep(batches)), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
