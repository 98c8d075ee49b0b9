"""Operator 7, WARC: archives of one gzip member per record, and a two-level capture index over them.

``write_archives`` lets each task append its records to archives of its own in the shared folder and return where each
record lies. An archive's name is made afresh for each attempt of a task, and only the archives named in the returned rows
count, so a repeated task leaves at worst a file that nothing refers to. ``build_index`` sorts the captures by reversed-host
URL key, cuts each sorted part into compressed blocks of ``block_lines`` lines and keeps a sparse directory of the blocks'
first keys; ``CaptureIndex.lookup`` searches the parts' first keys, then the directory of the one or two parts that can hold
the key, then the lines of their blocks, each by bisection, and reads only the ranges found. ``find_captures`` does so for a table
of URLs in tasks, and ``read_archives`` reads the records that it finds, archive by archive in order of the offsets.

The shared folder has to be of a kind that ``pyarrow.fs`` opens (a mounted path, S3, GCS, HDFS).

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest id is a response, the others
revisit it; equal means an equal SHA-1 digest and length. Defined results: a null payload is empty; a null URL has the empty
key; rows with a null id lose against any other, and where a payload has no other, all its rows are responses; so are all
rows that repeat the largest id with the same payload; an empty table writes no archive. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, fresh_path, tidy, written

#: Up to so many revisits are joined by broadcast (16 bytes each); more are joined by a shuffle on the id.
BROADCAST_ROWS = 200_000

CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURES_SQL = "key string, page_id long, url string, record_type string, archive string, offset long, length long"
BLOCKS_SQL = "part int, block int, first_key string, lines int, data binary"
DIRECTORY_SQL = "block int, first_key string, part int"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then port, path and query: ``http://www.example.com:8080/a?b`` is ``com,example,www:8080)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # not a URL: its own key
        return re.sub(r"\s", "%20", url)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"[\x00-\x20]", "%20", key)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20]", "%20", url or ""), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}, rest


def parse_record(member: bytes) -> dict:
    """The fields of a compressed record; raises ValueError where lengths or digests disagree."""
    head, rest = _headers(zlib.decompress(member, 31))
    size = int(head["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {head.get('warc-record-id')} has a wrong length")
    http, payload = _headers(rest[:size])
    digest, full = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != full):
        raise ValueError(f"record {head.get('warc-record-id')} has a wrong payload")
    number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
    return {"page_id": number(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": head["warc-type"], "payload": payload, "payload_bytes": full, "payload_digest": digest, "refers_to": number(head.get("warc-refers-to"))}


def _open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds refers_to and revisit. ``pages``: page_id, url, payload string."""
    sized = pages.select("page_id", F.sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least_bytes)
    repeated = sized.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1 and refers_to is not null").drop("copies")
    repeated = few(written(repeated, "repeated-payloads"), BROADCAST_ROWS)  # written, so that Spark can split the join on a hot payload
    revisits = sized.join(repeated, ["digest", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "refers_to").distinct()
    small = few(written(revisits, "revisits"), BROADCAST_ROWS)
    pages = pages.withColumn("digest", F.sha1(F.col("payload")))
    return pages.join(small, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to", F.col("of_digest").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 1000, archive_bytes: int = 64 << 20, date: str = "2026-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row; returns the captures (key, page_id, url, record_type, archive, offset, length) as a written table."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    rows = with_revisits(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")), least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(path)
        fs.create_dir(f"{base}/archives", recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                pack = zlib.compressobj(3, wbits=31)
                member = pack.compress(record(page_id, url, payload.encode(), digest, refers_to, revisit, date)) + pack.flush()
                out.write(member)
                found.append((url_key(url), page_id, url, "revisit" if revisit else "response", name, at, len(member)))
                at += len(member)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), CAPTURES)], schema=CAPTURES)
        if out is not None:
            out.close()

    rows.mapInArrow(write, CAPTURES_SQL).write.parquet(f"{path}/captures")
    return spark.read.schema(CAPTURES_SQL).parquet(f"{path}/captures")


def build_index(captures: DataFrame, path: str, block_lines: int = 1000, parts: int | None = None) -> None:
    """Write the compressed blocks and their sparse directory under ``path``."""
    parts = parts or max(1, captures.rdd.getNumPartitions())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, lines, first = TaskContext.get().partitionId(), 0, [], None

        def made() -> pa.RecordBatch:
            data = zlib.compress("\n".join(lines).encode(), 6)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first_key": [first], "lines": pa.array([len(lines)], pa.int32()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for key, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                first = key if not lines else first
                lines.append(f"{key} {archive} {offset} {length}")
                if len(lines) == block_lines:
                    yield made()
                    lines, block = [], block + 1
        if lines:
            yield made()

    order = ["key", "archive", "offset"]
    lines = captures.select(*order, "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lines.mapInArrow(blocks, BLOCKS_SQL).write.parquet(f"{path}/blocks")
    captures.sparkSession.read.schema(BLOCKS_SQL).parquet(f"{path}/blocks").select("part", "block", "first_key").write.partitionBy("part").parquet(f"{path}/directory")


def _runs(firsts: list[str], key: str) -> range:
    """The places of a sorted list of first keys whose ranges may hold the key: equal keys may start in the range before."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


def _hits(lines: list[str], key: str) -> Iterator[tuple[str, int, int]]:
    """(archive, offset, length) of a key in the sorted lines of a block."""
    at = bisect.bisect_left(lines, key + " ")
    while at < len(lines) and lines[at].startswith(key + " "):
        _, archive, offset, length = lines[at].split(" ")
        yield archive, int(offset), int(length)
        at += 1


def find_captures(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """(archive, offset, length) of all captures of the URLs (url), each once: the index's two levels, searched by tasks.

    The different keys are sorted, so that a task has a stretch of them and meets the parts of the index one after another; of each part it reads
    the sparse directory and finds the blocks by bisection. Keys then meet their blocks in a stream sorted by block, in which each block is
    unpacked once and searched by bisection; nothing is gathered. A key with many captures has as many blocks as they fill."""
    directory = f"{path}/index/directory"
    parts = sorted((r[1], r[0]) for r in spark.read.schema(DIRECTORY_SQL).parquet(directory).groupBy("part").agg(F.min("first_key")).collect())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())})

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, base = _open_fs(directory)
        firsts, held = [k for k, _ in parts], {}
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                wanted = [parts[i][1] for i in _runs(firsts, key)]
                for p in wanted:
                    if p not in held:
                        t = pq.read_table(f"{base}/part={p}", columns=["first_key", "block"], filesystem=fs, partitioning=None).to_pydict()
                        held[p] = sorted(zip(t["first_key"], t["block"]))
                for old in held.keys() - set(wanted):  # keys are sorted, so what lies behind is not needed again
                    del held[old]
                blocks = sorted((k, p, b) for p in wanted for k, b in held[p])
                rows += [(key, *blocks[i][1:]) for i in _runs([k for k, _, _ in blocks], key)]
            if rows:
                k, p, b = zip(*rows)
                yield pa.RecordBatch.from_pydict({"key": pa.array(k, pa.string()), "part": pa.array(p, pa.int32()), "block": pa.array(b, pa.int32())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = []
        for batch in batches:
            found = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key is None:
                    lines = zlib.decompress(data.as_py()).decode().split("\n")
                else:
                    found += _hits(lines, key)
            if found:
                archive, offset, length = zip(*found)
                yield pa.RecordBatch.from_pydict({"archive": pa.array(archive, pa.string()), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64())})

    known = urls.select(F.col("url").cast("string")).mapInArrow(keys, "key string").distinct()
    asked = known.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key").mapInArrow(locate, "key string, part int, block int")
    blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/index/blocks").select(F.lit(None).cast("string").alias("key"), "part", "block", "data")
    both = blocks.unionByName(asked.withColumn("data", F.lit(None).cast("binary")))
    stream = both.repartition("part", "block").sortWithinPartitions("part", "block", F.col("key").asc_nulls_first()).select("key", "data")
    return stream.mapInArrow(lambda batches: tidy(search(batches)), "archive string, offset long, length long")


def read_archives(spark: SparkSession, path: str, urls: DataFrame, with_payload: bool = False, read_bytes: int = 256 << 20) -> DataFrame:
    """The records of all captures of the URLs, found through the index, read by their ranges and checked; a task reads whole archives, about ``read_bytes`` of them, or fewer while some cores had none."""
    kept = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * with_payload])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(path)
        name, file = None, None
        for batch in batches:
            found = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    name, file = archive, fs.open_input_file(f"{base}/{archive}")
                r = parse_record(file.read_at(length, offset))
                found.append([r[k] for k in kept])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    held = spark.read.schema(CAPTURES_SQL).parquet(f"{path}/captures").agg(F.sum("length"), F.approx_count_distinct("archive")).first()
    parts = max(1, -(-(held[0] or 0) // read_bytes), min(held[1], spark.sparkContext.defaultParallelism))
    lines = find_captures(spark, path, urls).repartition(parts, "archive").sortWithinPartitions("archive", "offset")
    return lines.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


class CaptureIndex:
    """Look single URLs up. The driver holds a first key for each part; of the directory only the rows of the parts asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.directory = spark.read.schema(DIRECTORY_SQL).parquet(f"{path}/index/directory")
        self.blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/index/blocks")
        self.parts = sorted((r[1], r[0]) for r in self.directory.groupBy("part").agg(F.min("first_key")).collect())

    def captures(self, url: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of the URL's captures."""
        key, found = url_key(url), []
        parts = [self.parts[i][1] for i in _runs([k for k, _ in self.parts], key)]
        if not parts:
            return []
        rows = sorted(tuple(r) for r in self.directory.filter(F.col("part").isin(parts)).select("first_key", "part", "block").collect())
        for i in _runs([r[0] for r in rows], key):
            _, part, block = rows[i]
            data = self.blocks.filter((F.col("part") == part) & (F.col("block") == block)).select("data").first()[0]
            found += _hits(zlib.decompress(data).decode().split("\n"), key)
        return found

    def lookup(self, url: str) -> list[dict]:
        fs, base = _open_fs(self.path)
        out = []
        for archive, offset, length in self.captures(url):
            with fs.open_input_file(f"{base}/{archive}") as f:
                out.append(parse_record(f.read_at(length, offset)))
        return out


def iterate_archive(data: bytes) -> Iterator[dict]:
    """All records of an archive without an index: gzip members one after another."""
    stream = io.BytesIO(data)
    rest = stream.read()
    while rest:
        d = zlib.decompressobj(31)
        d.decompress(rest)
        used = len(rest) - len(d.unused_data)
        yield parse_record(rest[:used])
        rest = d.unused_data


def warc_store(pages: DataFrame, path: str | None = None, **options) -> str:
    """Archives and index of ``pages``; returns their folder."""
    path = path or fresh_path(pages.sparkSession, "warc")
    captures = write_archives(pages, path, **options)
    build_index(captures, f"{path}/index")
    return path


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = warc_store(pages)
    return read_archives(spark, path, pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same columns from the pages themselves.
ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS most FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN most <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN most <> page_id THEN most END AS refers_to
FROM p LEFT JOIN m USING (payload_digest, payload_bytes)"""
