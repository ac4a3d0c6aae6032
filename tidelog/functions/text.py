"""Literal, case-insensitive substring match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPE = "!"


def like_literal(text: str) -> str:
    """``text`` with the LIKE wildcards and the escape character made literal."""
    return "".join(ESCAPE + c if c in "!%_" else c for c in text)


def contains_text(column: Column, text: str) -> Column:
    """True where ``column`` contains ``text``, ignoring case."""
    return F.ilike(column, F.lit(f"%{like_literal(text)}%"), F.lit(ESCAPE))
