"""Scalar reliability formulas as Spark column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published estimator.
Z_CLIP = 0.9999
SB_FLOOR, SB_CEIL = 0.001, 0.999
MIN_RELIABILITY = 0.05
OBSERVATION_VAR = 0.15
PARTIAL_ALPHA = 0.5
CORRECTION_METHODS = ("original", "fisher_z", "partial", "soft_clamp")


def as_col(x) -> Column:
    """Column, column name or plain number -> Column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def clip(x, lo: float, hi: float) -> Column:
    """Bound a value; NULL stays NULL (least/greatest alone would skip it)."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def fisher_z(r) -> Column:
    return F.atanh(clip(r, -Z_CLIP, Z_CLIP))


def fisher_z_inv(z) -> Column:
    return F.tanh(as_col(z))


def spearman_brown(r, k) -> Column:
    r, k = clip(r, SB_FLOOR, SB_CEIL), as_col(k)
    return k * r / (F.lit(1.0) + (k - F.lit(1.0)) * r)


def bayes_shrink(r, prior_mean=None, prior_var=None, observation_var=OBSERVATION_VAR) -> Column:
    """Pull an observed reliability towards a prior mean; a missing prior leaves it unchanged."""
    r = as_col(r)
    if prior_mean is None or prior_var is None:
        return r
    mean, var, obs = as_col(prior_mean), as_col(prior_var), as_col(observation_var)
    w = var / (var + obs)
    return F.when(mean.isNull() | var.isNull(), r).otherwise(w * r + (F.lit(1.0) - w) * mean)


def _reliabilities(r_hat, r_real, k, prior, observation_var):
    mean, var = prior if prior is not None else (None, None)
    floor = lambda r: F.when(r.isNotNull(), F.greatest(r, F.lit(MIN_RELIABILITY)))
    now = (floor(as_col(r_hat)), floor(bayes_shrink(r_real, mean, var, observation_var)))
    later = tuple(spearman_brown(r, k) for r in now)
    return now[0] * now[1], later[0] * later[1]


def correct_attenuation(
    r_obs, r_hat, r_real, k, prior=None, method: str = "original", observation_var=OBSERVATION_VAR
) -> Column:
    """Correct an observed correlation for unreliability and extrapolate it by a factor ``k``.

    Every argument may be a number or a column, ``prior`` is a (mean, variance) pair or None.
    """
    if method not in CORRECTION_METHODS:
        raise ValueError(f"unknown correction method {method!r}; expected one of {CORRECTION_METHODS}")
    r_obs = as_col(r_obs)
    now, later = _reliabilities(r_hat, r_real, k, prior, observation_var)
    if method == "fisher_z":
        return F.tanh(fisher_z(r_obs) + F.lit(0.5) * F.log(later / now))
    if method == "partial":
        return clip(r_obs * F.pow(later / now, F.lit(PARTIAL_ALPHA / 2)), -1, 1)
    scaled = r_obs * F.sqrt(later / now)
    return F.tanh(scaled) if method == "soft_clamp" else clip(scaled, -1, 1)


def correct_by_name(method, r_obs, r_hat, r_real, k, prior=None, observation_var=OBSERVATION_VAR) -> Column:
    """``correct_attenuation`` with the method held in a column; unknown names give NULL."""
    method = as_col(method)
    out = F.lit(None).cast("double")
    for name in CORRECTION_METHODS:
        value = correct_attenuation(r_obs, r_hat, r_real, k, prior, name, observation_var)
        out = F.when(method == name, value).otherwise(out)
    return out


def scaled_samples(seconds, tr) -> Column:
    """Whole samples inside a duration (truncating)."""
    return F.floor(as_col(seconds) / as_col(tr)).cast("int")
