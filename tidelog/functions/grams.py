"""Three-letter grams as positions in a fixed bitmap: which texts can hold a given one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
# Positions of a bitmap, and how many of them lie in one of its rows: fixed by bitmap_construct_agg.
BITS, ROW_BITS = 1 << 17, 1 << 15


def gram_bits(text: Column) -> Column:
    """The positions of all grams of a text, without regard to case; none for a shorter text.

    A text that holds another one has all of its positions.
    """
    lower = F.lower(text)
    last = F.length(lower) - (GRAM - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.substring(lower, i, F.lit(GRAM)))
    return F.transform(F.array_distinct(grams), lambda g: F.pmod(F.xxhash64(g), F.lit(BITS)))


def has_bit(bitmap: Column, position: int) -> Column:
    """Whether a row of a bitmap has the bit of a position."""
    at = position % ROW_BITS
    byte = F.conv(F.hex(F.substring(bitmap, at // 8 + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(1 << at % 8) != 0
