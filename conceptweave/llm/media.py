"""Operator 10, media columns: store bytes as media, and find out what media a column really holds.

``store_media`` wraps each payload in a lossless container of 8-bit samples (a WAV file of one channel) and writes it as a
binary column with the type that was declared for it. ``sniff`` runs one Aho-Corasick automaton of magic bytes over the
whole stored value; a validator of each format confirms structure and lengths from a hit on. What is confirmed at the
first byte corrects the declared type, even if other bytes follow; all that is confirmed but does not fill the whole value is carved
out as embedded media. Hits inside media that were already carved are left to that media; media that fill the value are looked into.

Defined results: a null text is empty, and its payload is 64 zero bytes; a null stored value has no type and no media;
repeated rows give repeated results; an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, keyed

UNIT = 64


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples; an odd length gets the pad byte that chunks need."""
    pad = len(samples) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * pad


def wav_samples(data: bytes) -> bytes:
    """The data chunk of a validated WAV file."""
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


# A validator gets the bytes and where the magic lies; it returns (start, end, type), or None.


def riff(b: bytes, at: int) -> tuple[int, int, str] | None:
    if len(b) < at + 12:
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(b[at + 8 : at + 12])
    if kind is None or end > len(b):
        return None
    p, names = at + 12, set()
    while p + 8 <= end:
        names.add(b[p : p + 4])
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + size + (size & 1)
    if p != end or kind == "audio/wav" and not {b"fmt ", b"data"} <= names or not names:
        return None
    return at, end, kind


def png(b: bytes, at: int) -> tuple[int, int, str] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, name = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        end = p + 12 + size
        if end > len(b) or first and (name != b"IHDR" or size != 13) or zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if name == b"IEND":
            return at, end, "image/png"
        p, first = end, False
    return None


def gif(b: bytes, at: int) -> tuple[int, int, str] | None:
    def blocks(p: int) -> int | None:
        while p < len(b):
            if not b[p]:
                return p + 1
            p += b[p] + 1
        return None

    if at + 13 > len(b):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    p, images = at + 13 + table(b[at + 10]), 0
    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return (at, p + 1, "image/gif") if images else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p, images = blocks(p + 11 + table(b[p + 9])), images + 1
        else:
            return None
    return None


def jpeg(b: bytes, at: int) -> tuple[int, int, str] | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark in (0x00, 0x01, 0xD8, 0xD9) or 0xD0 <= mark <= 0xD7:
            return None
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2 or p + 2 + size > len(b):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next mark that is neither stuffing nor a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return (at, p + 2, "image/jpeg") if frame else None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return None


def bmp(b: bytes, at: int) -> tuple[int, int, str] | None:
    if at + 54 > len(b):
        return None
    size, _, offset, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or at + size > len(b) or width <= 0 or not 14 + header <= offset <= size:
        return None
    if packed == 0 and offset + (width * bits + 31) // 32 * 4 * abs(height) > size:
        return None
    return at, at + size, "image/bmp"


def ogg(b: bytes, at: int) -> tuple[int, int, str] | None:
    p, pages = at, 0
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and not b[p + 4]:
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b) or p + 27 + n > len(b):
            break
        pages, last, p = pages + 1, b[p + 5] & 4, end
        if last:
            break
    return (at, p, "audio/ogg") if pages else None


def gzip(b: bytes, at: int) -> tuple[int, int, str] | None:
    d = zlib.decompressobj(31)
    try:
        rest = b[at:]
        while rest and not d.eof:
            d.decompress(rest, 1 << 20)
            rest = d.unused_data if d.eof else d.unconsumed_tail
    except zlib.error:
        return None
    return (at, len(b) - len(d.unused_data), "application/gzip") if d.eof else None


#: Magic bytes of the formats.
MAGIC = {
    b"RIFF": riff,
    b"\x89PNG\r\n\x1a\n": png,
    b"GIF87a": gif,
    b"GIF89a": gif,
    b"\xff\xd8\xff": jpeg,
    b"BM": bmp,
    b"OggS": ogg,
    b"\x1f\x8b\x08": gzip,
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, check in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), check))
    a.make_automaton()
    return a


def sniff_bytes(data: bytes, a) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The type of the value, and (start, end, type) of the media in it; those inside another's header and data follow it."""
    kind, found, free = None, [], 0
    for last, (size, check) in a.iter(data.decode("latin-1")):
        start = last - size + 1
        if start < free:
            continue
        if hit := check(data, start):
            if start == 0:
                kind = hit[2]
            if start or hit[1] < len(data):
                found.append(hit)
                free = hit[1]
    return kind, found


def store_media(docs: DataFrame, declared: str = "application/octet-stream", id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write doc_id, n_bytes, declared_type and media of every text; returns the written table."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "media")

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, media = [], [], []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                ids.append(doc_id)
                sizes.append(len(raw))
                media.append(wav(raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
                held += len(media[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "declared_type": [declared] * len(ids), "media": pa.array(media, pa.binary())})
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "declared_type": [declared] * len(ids), "media": pa.array(media, pa.binary())})

    schema = "doc_id long, n_bytes long, declared_type string, media binary"
    keyed(docs, id_col, text_col).mapInArrow(wrap, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


FEATURES_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sniffed_type string, embedded array<struct<start: long, end: long, type: string>>"
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("sniffed_type", pa.string()), ("embedded", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())])))])


def media_features(stored: DataFrame) -> DataFrame:
    """Sniff each stored value, carve its payload and describe both. ``feature``: declared type, confirmed type, then type@start-end of each embedded part."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            out = []
            for doc_id, n_bytes, declared, media in zip(*(c for c in batch.columns)):
                doc_id, n_bytes, declared, media = doc_id.as_py(), n_bytes.as_py(), declared.as_py(), media.as_py()
                if media is None:
                    out.append((doc_id, n_bytes, None, None, None, None, None, f"{declared}>none", None, []))
                    continue
                kind, inner = sniff_bytes(media, a)
                payload = wav_samples(media) if kind == "audio/wav" else media
                feature = ";".join([f"{declared}>{kind or 'unknown'}", *(f"{x}@{s}-{e}" for s, e, x in inner)])
                parts = [{"start": s, "end": e, "type": x} for s, e, x in inner]
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, parts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FEATURES)], schema=FEATURES)

    return stored.mapInArrow(look, FEATURES_SQL)


def op10_media(spark, sf_dir: str) -> DataFrame:
    stored = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
