"""Channel cleaning and length guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliaspan.operators.connectivity import KEYS
from reliaspan.session import spread


def channel_spread(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Population SD of every channel over the whole recording (map-side combined)."""
    return samples.groupBy(*keys, "channel").agg(
        F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n_rows")
    )


def drop_constant_channels(samples: DataFrame, eps: float = 1e-8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep the channels whose SD over the full recording exceeds ``eps``."""
    keep = channel_spread(samples, keys).filter(F.col("sd") > eps)
    return samples.join(keep.select(*keys, "channel"), [*keys, "channel"], "left_semi")


def reject_bad_subjects(samples: DataFrame, max_bad_share: float = 0.1, eps: float = 1e-8, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_channels, n_bad, bad_share, kept): subjects with too many constant channels fail."""
    bad = F.sum(F.when(F.col("sd") <= eps, 1).otherwise(0))
    return (
        channel_spread(samples, keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_channels"), bad.alias("n_bad"))
        .withColumn("bad_share", F.col("n_bad") / F.col("n_channels"))
        .withColumn("kept", F.col("bad_share") <= max_bad_share)
    )


def recording_lengths(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_rows, n_channels). Store this next to the recordings so later jobs need no scan."""
    return samples.groupBy(*keys).agg(
        (F.max("t") + 1).cast("int").alias("n_rows"), F.count_distinct("channel").alias("n_channels")
    )


def length_status(lengths: DataFrame, n_short: Column, tr: Column, min_ref_sec: float = 30, min_total_sec: float = 150) -> DataFrame:
    """Adds ``reason``: the first failing guard, NULL when the recording is usable.

    Guards: short + 10 rows; reference of at least 12 rows and ``min_ref_sec``; ``min_total_sec``;
    at least 20 rows.
    """
    n = F.col("n_rows")
    rest = n - n_short
    min_rest = F.greatest(F.lit(12), F.floor(F.lit(min_ref_sec) / tr).cast("int"))
    return lengths.withColumn(
        "reason",
        F.when(n < 20, "fewer_than_20_rows")
        .when(n < n_short + 10, "shorter_than_short_plus_10")
        .when(n * tr < min_total_sec, "total_too_short")
        .when(rest < min_rest, "reference_too_short"),
    )


def densify(samples: DataFrame, n_rows: int, channels: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Every (channel, t) of every key, missing cells as 0. Grid rows are generated, not joined.

    The keys are spread before they become grid rows, as few small partitions would make all of these, and the cells
    before they are added up, so that a task holds its own share of them only.
    """
    grid = (
        spread(samples.select(*keys).distinct(), *keys)
        .withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
        .withColumn("value", F.lit(0.0))
    )
    cols = [*keys, "channel", "t", "value"]
    cells = spread(samples.select(*cols).unionByName(grid.select(*cols)), *keys, "channel", "t")
    return cells.groupBy(*keys, "channel", "t").agg(F.sum("value").alias("value"))


def drop_censored_rows(wide: DataFrame, values: Sequence[str], any_missing: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Remove censored rows and close up the time axis.

    ``any_missing`` False drops rows with no value at all and fills the rest with 0; True drops rows
    with any missing value. NaN counts as missing.
    """
    clean = wide.withColumns({v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in values})
    present = sum((F.when(F.col(v).isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    clean = clean.filter(present == len(values) if any_missing else present > 0)
    out = clean.withColumns({v: F.coalesce(v, F.lit(0.0)) for v in values})
    return close_gaps(out, keys)


def close_gaps(rows: DataFrame, keys: Sequence[str] = KEYS, block: int = 4096) -> DataFrame:
    """Renumber ``t`` to 0, 1, 2, ... per key, keeping order.

    Counted in two steps: rank within a block of time, plus the rows in earlier blocks. The window
    that spans a whole key only sees one row per block, so no task holds a whole recording.
    """
    keys = list(keys)
    marked = rows.withColumn("_blk", F.floor(F.col("t") / block))
    rank = F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy("t"))
    counts = marked.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = counts.withColumn("_off", before).drop("_n")
    return (
        marked.withColumn("_rank", rank)
        .join(offsets, [*keys, "_blk"])
        .withColumn("t", (F.col("_off") + F.col("_rank") - 1).cast("int"))
        .drop("_blk", "_rank", "_off")
    )
