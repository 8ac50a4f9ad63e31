"""Named queries over the snapshot tables, each with DuckDB SQL that says the same independently where SQL can."""

from __future__ import annotations

from .queries import crawling, deciding, logs, pages, texts
from .queries.base import ORACLES, QUERIES, Query

__all__ = ["ORACLES", "QUERIES", "Query", "crawling", "deciding", "logs", "pages", "texts"]
