"""Query name to Spark callable and DuckDB SQL."""

from . import graph_queries, law_queries, text_queries  # noqa: F401  they register themselves
from .base import ORACLE_SQL, QUERIES  # noqa: F401
