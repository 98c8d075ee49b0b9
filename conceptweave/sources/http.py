"""Documents by HTTP: a table of URLs is fetched in tasks, with retries; what fails stays a row with its error."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "url string, status int, attempts int, body string, error string"


def fetch(urls: DataFrame, slices: int = 64, retries: int = 3, timeout: float = 30.0, wait: float = 1.0, most_bytes: int = 64 << 20) -> DataFrame:
    """(url, status, attempts, body, error) of each different URL (url), fetched once; null ones are left out.

    URLs are dealt to ``slices`` tasks. Errors of the server (5xx), of too many requests (429) and of the connection are tried again up to ``retries``
    times, after ``wait`` seconds and then twice as long each time. A row has a body or an error; a body beyond ``most_bytes`` is an error. A
    task that is repeated fetches its slice again, so write the result before it is read more than once."""
    kinds = [("url", pa.string()), ("status", pa.int32()), ("attempts", pa.int32()), ("body", pa.string()), ("error", pa.string())]

    def one(url: str) -> tuple:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        status, error = None, None
        for attempt in range(1, retries + 2):
            try:
                with urlopen(Request(url, headers={"Accept": "application/json, text/html"}), timeout=timeout) as answer:
                    body = answer.read(most_bytes + 1)
                    if len(body) > most_bytes:
                        return url, answer.status, attempt, None, f"more than {most_bytes} bytes"
                    return url, answer.status, attempt, body.decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
            except HTTPError as e:
                status, error = e.code, f"HTTP {e.code}"
                if e.code < 500 and e.code != 429:
                    break
            except Exception as e:  # whatever a URL or a connection can raise becomes its row's error
                status, error = None, f"{type(e).__name__}: {e}"
                if isinstance(e, ValueError):
                    break
            if attempt <= retries:
                time.sleep(wait * 2 ** (attempt - 1))
        return url, status, attempt, None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(one(url), kinds)], names=[n for n, _ in kinds])

    return urls.select(F.col("url").cast("string")).filter("url is not null").distinct().repartition(slices, "url").mapInArrow(run, FETCHED)


def quarantined(fetched: DataFrame) -> DataFrame:
    return fetched.filter("error is not null")
