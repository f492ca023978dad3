"""Bounded samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1 << 30


def bucket_of(key: Column) -> Column:
    """A fixed pseudo-random number of a key, below BUCKETS."""
    return F.pmod(F.xxhash64(F.lit(20_011), key), F.lit(BUCKETS))


def share_of(rows: int, bound: int) -> int:
    """The bucket below which keys are kept, so that of ``rows`` rows about ``bound`` stay, or all if they are fewer."""
    return int(min(1.0, bound / max(1, rows)) * BUCKETS)


def share_filter(key: Column, rows: int, bound: int) -> Column:
    return bucket_of(key) < share_of(rows, bound)
