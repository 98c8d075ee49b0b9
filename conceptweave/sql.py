"""Functions for SQL: ``register(spark)`` makes ``html_blocks`` a table function."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import schema
from .sources.html import FIELDS, parse_blocks


class HtmlBlocks:
    """The block elements of a page, a row each; one page is held at a time."""

    def eval(self, html: str):
        for b in parse_blocks(html):
            yield Row(*(b[f] for f in FIELDS))


def register(spark: SparkSession) -> None:
    """``SELECT page_id, b.* FROM pages, LATERAL html_blocks(html) b``."""
    spark.udtf.register("html_blocks", udtf(HtmlBlocks, returnType=schema.BLOCKS))
