"""All queries over the reference data model, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pageloom.catalog import pages, runs, stats, texts, urls
from pageloom.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "pages", "runs", "stats", "texts", "urls"]
