"""Operator 5, packing: bounded-space online best-fit into fixed token windows.

Every partition of the input keeps at most ``open_windows`` windows open. A piece goes into the open window whose free
room is smallest among those it fits. When it fits none and no further window may be opened, the fullest window is filled
to its end with the piece's first ids and emitted, and the rest of the piece is placed again, so an emitted window has no
padding. What is still open when a partition ends is written as leftovers; rounds of a fan-in of ``fan_in`` partitions
pack the leftovers again by the same rule until one task is left; its last open windows are merged into one another, and
only the very last is padded.

Each level is written to the shared folder before the next one reads it, its leftovers apart from its full windows, so that the next
level reads only leftovers: a lost executor repeats a task over the same file splits, and what other tasks packed stays as it is.

Defined results: a null or empty text is a document of the single end id; repeated rows are packed as rows of their own
under the same id; a null id is kept; an empty table gives no pieces; further input columns are ignored. A text of any
length is cut at window ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from unicodedata import normalize

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, keyed, tidy

TOKENIZER = "word_bpe_49k.json"
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("leftover", pa.bool_()), ("ids", pa.binary())])
PIECES_SQL = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, length long, leftover boolean, ids binary"


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, by a tokenizer that drops white space.

    White space separates words for this tokenizer, so a text's ids are those of its words in turn. The ids of a word are
    looked up in a cache of at most ``cache_words`` entries, emptied when full; it changes the speed only.
    """

    def __init__(self, path: str, cache_words: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.tok, self.cache_words, self.cache = Tokenizer.from_file(path), cache_words, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = (c for c in range(256) if c not in set(printable))
        self.ids4 = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.marks: dict[bytes, bytes] = {}
        self.byte_chars = {c: chr(c) for c in printable} | {c: chr(256 + i) for i, c in enumerate(other)}

    def _word(self, word: bytes) -> bytes:
        body, mark = (word[:-1], word[-1:]) if word[-1:] in (b",", b".") and word[-2:-1].isalpha() else (word, b"")  # a mark alone after a letter is a token of its own
        if body.isalpha() and body.islower():
            return (self.cache.get(body) or self._letters(body.decode())) + self._mark(mark)
        text = word.decode()
        low = text.lower() if text.isascii() else "".join(map(str.lower, normalize("NFC", text)))  # the words that hold "<|" come with their capitals
        body, mark = (low[:-1], low[-1]) if len(low) > 1 and low[-1] in ".," and low[-2].isalpha() else (low, "")
        if body.isalpha() and not body.isascii():
            return self._letters(body.encode().decode("latin-1").translate(self.byte_chars)) + self._mark(mark.encode())
        return b"".join([self.ids4[i] for i in self.tok.encode(text, add_special_tokens=False).ids])

    def _mark(self, mark: bytes) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._letters(mark.decode())
        return self.marks[mark]

    def _letters(self, text: str) -> bytes:
        ids4 = self.ids4
        return b"".join([ids4[t.id] for t in self.tok.model.tokenize(text)]) if text else b""

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode()
        words = [w if b"<|" in w else w.lower() for w in raw.split()] if b"<|" in raw else raw.lower().split()
        cache = self.cache
        new = {w for w in words if w not in cache}
        if new:
            if len(cache) + len(new) > self.cache_words:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = self._word(w)
        return b"".join(map(cache.__getitem__, words))


class Packer:
    """At most ``k`` open windows of ``size`` ids."""

    def __init__(self, size: int, k: int, first_id: int) -> None:
        self.size, self.k, self.next_id = size, k, first_id
        self.open: list[list] = []  # [room, pieces]

    def _numbered(self, window: list, leftover: bool) -> list[tuple]:
        number, at, out = self.next_id, 0, []
        self.next_id += 1
        for doc_id, start, total, ids in window[1]:
            n = len(ids) // 4
            out.append((doc_id, start, total, number, at, n, leftover, ids))
            at += n
        return out

    def add(self, doc_id: int | None, start: int, total: int, ids: bytes) -> Iterator[list[tuple]]:
        """Place the ids; yields the pieces of each window that was emitted."""
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                cut = self.size * 4
                yield self._numbered([0, [(doc_id, start, total, ids[:cut])]], False)
            else:
                fits = [w for w in self.open if w[0] >= n]
                if fits:
                    window = min(fits, key=lambda w: w[0])
                elif len(self.open) < self.k:
                    window = [self.size, []]
                    self.open.append(window)
                else:
                    window = min(self.open, key=lambda w: w[0])
                cut = min(n, window[0]) * 4
                window[0] -= cut // 4
                window[1].append((doc_id, start, total, ids[:cut]))
                if not window[0]:
                    self.open = [w for w in self.open if w is not window]
                    yield self._numbered(window, False)
            ids, start = ids[cut:], start + cut // 4

    def rest(self, leftover: bool) -> Iterator[list[tuple]]:
        for window in self.open:
            yield self._numbered(window, leftover)
        self.open = []


def _batches(rows: Iterable[list[tuple]], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for pieces in rows:
        held += pieces
        n += sum(len(p[-1]) for p in pieces)
        if n >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PIECES)], schema=PIECES)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PIECES)], schema=PIECES)


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


def _tokenizer(path: str | None) -> WordTokenizer:
    if path not in _TOKENIZERS:
        if path is None:
            import public_tokenizers

            _TOKENIZERS[path] = WordTokenizer(public_tokenizers.path(TOKENIZER))
        else:
            _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


@contextmanager
def two_writers(spark: SparkSession) -> Iterator[None]:
    """Tasks write both folders of a table at once, for which they would else sort all their rows."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def pack(docs: DataFrame, size: int = 4096, open_windows: int = 16, end_id: int = 2, tokenizer_path: str | None = None, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, doc_tokens, sequence_id, offset, length, ids) of all documents, ids as unsigned 32-bit bytes.

    ``tokenizer_path`` is a path on every node; by default the public vocabulary's. ``path`` is where the packed pieces are
    written; by default a new folder in the shared one.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "packed")
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tok = Packer(size, open_windows, TaskContext.get().partitionId() << 32), _tokenizer(tokenizer_path)

        def rows() -> Iterator[list[tuple]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = tok.ids(text.as_py()) + end
                    yield from packer.add(doc_id, 0, len(ids) // 4, ids)
            yield from packer.rest(True)

        yield from _batches(rows())

    def write(packed: DataFrame, level: int) -> None:
        with two_writers(spark):
            packed.write.option("compression", "zstd").partitionBy("leftover").parquet(f"{path}/level={level}")

    def read(*levels: int) -> DataFrame:
        return spark.read.schema(f"{PIECES_SQL}, level int").option("basePath", path).parquet(*[f"{path}/level={i}" for i in levels])

    write(keyed(docs, id_col, text_col).mapInArrow(lambda batches: tidy(first(batches)), PIECES_SQL), 0)
    level = 0
    parts = read(0).filter("leftover").rdd.getNumPartitions()
    while True:
        below = read(level).filter("leftover").select(*PIECES.names)
        parts, level = -(-max(parts, 1) // fan_in), level + 1
        last = parts == 1

        def merge(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            packer = Packer(size, open_windows, level << 56 | TaskContext.get().partitionId() << 32)

            def rows() -> Iterator[list[tuple]]:
                for batch in batches:
                    for p in batch.to_pylist():
                        yield from packer.add(p["doc_id"], p["start"], p["doc_tokens"], p["ids"])
                if last:
                    packer.k, left = 1, [q for w in packer.open for q in w[1]]
                    packer.open = []
                    for q in left:
                        yield from packer.add(*q)
                yield from packer.rest(not last)

            yield from _batches(rows())

        write(below.coalesce(parts).mapInArrow(merge, PIECES_SQL), level)
        if last:
            break
    return read(*range(level + 1)).filter("not leftover").drop("leftover", "level")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
