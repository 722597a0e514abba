"""Cutting recordings into segments along the integer time axis.

All of these are projections and filters on ``t``; none needs a shuffle. Frames and samples are
both accepted (anything with a ``t`` column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_segments(rows: DataFrame, segments: dict[str, Column], name: str = "seg") -> DataFrame:
    """Repeat each row once per segment whose condition holds, so several segments share one scan."""
    marks = F.array(*[F.when(cond, F.lit(label)) for label, cond in segments.items()])
    return rows.withColumn(name, F.explode(F.array_compact(marks)))


def prefix(rows: DataFrame, n_short) -> DataFrame:
    return rows.filter(F.col("t") < n_short)


def suffix(rows: DataFrame, n_short, length=None) -> DataFrame:
    """Everything after the prefix, or a block of ``length`` rows right after it."""
    out = rows.filter(F.col("t") >= n_short)
    return out if length is None else out.filter(F.col("t") < n_short + length)


def offset_window(rows: DataFrame, offset, length) -> DataFrame:
    return rows.filter((F.col("t") >= offset) & (F.col("t") < offset + length))


def offset_complement(rows: DataFrame, offset, length) -> DataFrame:
    return rows.filter((F.col("t") < offset) | (F.col("t") >= offset + length))


def tumbling(rows: DataFrame, width: int, count: int | None = None) -> DataFrame:
    """Consecutive windows of equal width, optionally the first ``count`` only."""
    out = rows.withColumn("window_id", F.floor(F.col("t") / width).cast("int"))
    return out if count is None else out.filter(F.col("window_id") < count)


def sliding(rows: DataFrame, n_rows, width, step) -> DataFrame:
    """Overlapping windows [k*step, k*step + width) that fit inside ``n_rows``.

    The windows of a row are enumerated directly from its ``t``, so there is no range join.
    """
    t, n, w, s = F.col("t"), _int(n_rows), _int(width), _int(step)
    first = F.greatest(F.ceil((t - w + 1) / s).cast("int"), F.lit(0))
    last = F.least(F.floor(t / s).cast("int"), F.floor((n - w) / s).cast("int"))
    ids = F.when((last >= first) & (n >= w), F.sequence(first, last))
    return rows.withColumn("window_id", F.explode(ids))


def _int(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("int")


def window_rows(window_sec, step_sec, tr) -> tuple[Column, Column]:
    """Window width and step in rows: at least four and one."""
    width = F.greatest(F.floor(F.lit(window_sec) / tr).cast("int"), F.lit(4))
    step = F.greatest(F.floor(F.lit(step_sec) / tr).cast("int"), F.lit(1))
    return width, step


def random_window(rows: DataFrame, n_rows, length: int, seed, key: str = "subject_id") -> DataFrame:
    """One window per (subject, seed) with a hashed start in [0, n - length]."""
    from reliaspan.functions.hashing import seeded_hash

    n = _int(n_rows)
    start = (seeded_hash(F.col(key), seed, "window") % (n - length + 1)).cast("int")
    return rows.withColumn("start", start).filter(
        (n >= length) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + length)
    )


def half_split(rows: DataFrame, n_rows, pos: str = "t") -> DataFrame:
    """Label rows 1 or 2 by position relative to floor(n/2)."""
    return rows.withColumn("half", F.when(F.col(pos) < F.floor(_int(n_rows) / 2), 1).otherwise(2))


def first_channels(samples: DataFrame, k: int) -> DataFrame:
    return samples.filter(F.col("channel") < k)
