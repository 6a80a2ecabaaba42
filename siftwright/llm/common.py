"""Shared pieces: folding and hash order; cuts at an exact rank and dense ranks come from the core."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwright.operators.ranking import BUCKET_DIGITS, rank_in_hash_order, take_lowest

__all__ = ["BUCKET_DIGITS", "fold", "hash_hex", "rank_in_hash_order", "take_lowest"]


def fold(c: Column | str) -> Column:
    """Trimmed of surrounding (Unicode) white space and lower-cased; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))


def hash_hex(seed: str, *parts: Column) -> Column:
    """A 128-bit hash as hex text: the same on every run, layout and engine."""
    return F.md5(F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"))
