"""Seeded, engine-independent pseudo-random numbers made from md5 of the key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def seeded_hash(*parts) -> Column:
    """Uniform integer in [0, 2**32) from the text of its parts; the seed is one of the parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_bucket(h: Column, buckets: int) -> Column:
    """Order-preserving bucket of a hash: equal-width ranges of the hash domain."""
    return F.floor(h / F.lit(HASH_RANGE // buckets)).cast("int")
