"""Signal preparation: label averaging, detrending, confound regression, task regressors, scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.operators.connectivity import KEYS
from reliaspan.operators.kernels import solve_kernel


def label_average(voxels: DataFrame, atlas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """voxels(keys, t, voxel, value) and atlas(voxel, label) -> mean value per label and instant."""
    return (
        voxels.join(atlas, "voxel")
        .groupBy(*keys, F.col("label").alias("channel"), "t")
        .agg(F.avg("value").alias("value"))
    )


def detrend_zscore(samples: DataFrame, keys: Sequence[str] = KEYS, detrend: bool = True, zscore: bool = True) -> DataFrame:
    """Remove each channel's linear trend and scale to unit sample SD.

    The line and the residual SD come from one aggregation of sums per (key, channel), which is
    joined back; a constant channel becomes 0.
    """
    keys = [*keys, "channel"]
    t, v = F.col("t").cast("double"), F.col("value")
    stats = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(t).alias("mt"), F.avg(v).alias("mv"),
        F.var_pop(t).alias("vt"), F.var_pop(v).alias("vv"), F.covar_pop(t, v).alias("cv"),
    )
    slope = F.coalesce(F.try_divide(F.col("cv"), F.col("vt")), F.lit(0.0)) if detrend else F.lit(0.0)
    fitted = stats.withColumn("slope", slope).withColumn(
        "sd",
        F.sqrt(F.greatest(F.col("vv") - F.col("slope") * F.col("slope") * F.col("vt"), F.lit(0.0)) * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))),
    )
    joined = samples.join(fitted.select(*keys, "mt", "mv", "slope", "sd"), keys)
    resid = F.col("value") - F.col("mv") - F.col("slope") * (F.col("t") - F.col("mt"))
    out = F.when(F.col("sd") > 1e-12, resid / F.col("sd")).otherwise(0.0) if zscore else resid
    return joined.select(*[c for c in samples.columns if c != "value"], out.alias("value"))


def select_confounds(confounds: DataFrame, base: Sequence[str], keys: Sequence[str] = ("subject_id", "t")) -> DataFrame:
    """The base columns and their derivative/power variants that exist, missing values as 0; a
    single zero column when none exists."""
    suffixes = ("", "_derivative1", "_power2", "_derivative1_power2")
    wanted = [b + s for b in base for s in suffixes if b + s in confounds.columns]
    if not wanted:
        return confounds.select(*keys, F.lit(0.0).alias("zero"))
    return confounds.select(*keys, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in wanted])


def align_confounds(confounds: DataFrame, lengths: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop surplus leading confound rows so that both series end together."""
    counts = confounds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_conf"))
    shift = F.greatest(F.col("n_conf") - F.col("n_rows"), F.lit(0)).cast("int")
    return (
        confounds.join(counts, list(keys)).join(lengths.select(*keys, "n_rows"), list(keys))
        .withColumn("t", F.col("t") - shift).filter("t >= 0").drop("n_conf", "n_rows")
    )


def regress_confounds(samples: DataFrame, confounds: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Residual of every channel after least squares on the confounds and an intercept.

    Spark sums X'X and X'y per (key, channel); Python only solves the small normal equations; the
    coefficients are joined back. Nothing proportional to the recording length meets in one task.
    """
    keys = list(keys)
    design = F.array(F.lit(1.0), *[F.col(n).cast("double") for n in names])
    both = samples.join(confounds.select(*keys, "t", design.alias("d")), [*keys, "t"])
    m = len(names) + 1
    xtx = [F.sum(F.col("d")[a] * F.col("d")[b]).alias(f"x{a}_{b}") for a in range(m) for b in range(a, m)]
    xty = [F.sum(F.col("d")[a] * F.col("value")).alias(f"y{a}") for a in range(m)]
    sums = both.groupBy(*keys, "channel").agg(*xtx, *xty)
    packed = sums.select(
        *keys, "channel",
        F.array(*[F.col(f"x{a}_{b}") for a in range(m) for b in range(a, m)]).alias("xtx"),
        F.array(*[F.col(f"y{a}") for a in range(m)]).alias("xty"),
    )
    fields = [packed.schema[k] for k in [*keys, "channel"]] + [T.StructField("beta", T.ArrayType(T.DoubleType()))]
    beta = packed.mapInArrow(solve_kernel([*keys, "channel"]), T.StructType(fields))
    fit = sum((F.col("d")[a] * F.col("beta")[a] for a in range(m)), F.lit(0.0))
    return both.join(beta, [*keys, "channel"]).select(*keys, "channel", "t", (F.col("value") - fit).alias("value"))


# Fixed values of the canonical double-gamma response: shapes 6 and 16, undershoot ratio 1/6.
HRF_PEAK, HRF_UNDERSHOOT, HRF_RATIO, HRF_SECONDS = 6, 16, 1 / 6, 32
# Fixed values of the block design: rest first, 24 s rest, 20 s on, two alternating conditions.
BLOCK_ON, BLOCK_REST = 20, 24


def response_taps(tr: float) -> list[float]:
    """The double-gamma response on the sampling grid, scaled to unit peak (a few dozen numbers)."""
    t = np.arange(math.ceil(HRF_SECONDS / tr)) * tr
    density = lambda shape: t ** (shape - 1) * np.exp(-t) / math.factorial(shape - 1)
    h = density(HRF_PEAK) - HRF_RATIO * density(HRF_UNDERSHOOT)
    return (h / np.abs(h).max()).tolist()


def boxcar(t: Column, tr: float, condition: Column, blocks: int) -> Column:
    """1 while one of the condition's first ``blocks`` blocks is on."""
    period = BLOCK_ON + BLOCK_REST
    sec = t * F.lit(float(tr)) - BLOCK_REST
    block = F.floor(sec / period)
    on = (sec >= 0) & (block % 2 == condition) & (block < 2 * blocks) & (sec - block * period < BLOCK_ON)
    return F.when(on, 1.0).otherwise(0.0)


def task_regressors(grid: DataFrame, n_rows: int, tr: float, blocks: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, condition, t, value): boxcars convolved with the response and z-scored.

    ``grid`` is (keys, t). Each instant sends one weighted row to every later instant the response
    reaches, so the convolution is a bounded explode and one aggregation.
    """
    taps = F.array(*[F.lit(w) for w in response_taps(tr)])
    rows = grid.withColumn("condition", F.explode(F.array(F.lit(0), F.lit(1))))
    shifted = (
        rows.withColumn("u", boxcar(F.col("t"), tr, F.col("condition"), blocks))
        .select(*keys, "condition", "t", "u", F.posexplode(taps).alias("lag", "weight"))
        .select(*keys, "condition", (F.col("t") + F.col("lag")).alias("t"), (F.col("u") * F.col("weight")).alias("v"))
        .filter(F.col("t") < n_rows)
        .groupBy(*keys, "condition", "t")
        .agg(F.sum("v").alias("value"))
    )
    stats = shifted.groupBy(*keys, "condition").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = F.when(F.col("s") > 1e-8, (F.col("value") - F.col("m")) / F.col("s")).otherwise(F.col("value"))
    return shifted.join(stats, [*keys, "condition"]).select(*keys, "condition", "t", z.alias("value"))


def fit_scaler(train: DataFrame) -> DataFrame:
    """(channel, lo, hi) over all training samples."""
    return train.groupBy("channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def scale_to_unit(samples: DataFrame, scaler: DataFrame) -> DataFrame:
    """Map to [-1, 1] with the training range; a constant channel keeps a unit range."""
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return samples.join(scaler, "channel").withColumn("value", (F.col("value") - F.col("lo")) / span * 2 - 1).drop("lo", "hi")


def scale_back(samples: DataFrame, scaler: DataFrame) -> DataFrame:
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return samples.join(scaler, "channel").withColumn("value", (F.col("value") + 1) / 2 * span + F.col("lo")).drop("lo", "hi")


def pad_and_mask(samples: DataFrame, length: int, n_short: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pad every channel with zeros to ``length`` rows and flag the rows of the short window."""
    cells = [*keys, "channel"]
    grid = samples.select(*cells).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    padded = samples.select(*cells, "t", "value").filter(F.col("t") < length).unionByName(grid.withColumn("value", F.lit(0.0)))
    return padded.groupBy(*cells, "t").agg(F.sum("value").alias("value")).withColumn("observed", F.col("t") < n_short)


def normalise_weights(weights: DataFrame, value: str = "reliability", floor: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rescale a subject's weights to [floor, 1]; all ones when they are equal."""
    span = weights.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.col("hi") - F.col("lo")
    scaled = F.lit(floor) + (1 - floor) * F.try_divide(F.col(value) - F.col("lo"), width)
    return weights.join(span, list(keys)).withColumn("weight", F.when(width < 1e-8, 1.0).otherwise(scaled)).drop("lo", "hi")
