"""Named queries over the test tables, each with the same query as SQL where SQL can say it."""

from tidelog.catalog import counts, ingest, reports, searches, stores  # noqa: F401
from tidelog.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
