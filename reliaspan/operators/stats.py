"""Group contrasts, tests, corrections for multiplicity and summary curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliaspan.functions.reliability import clip
from reliaspan.functions.special import t_two_sided
from reliaspan.operators.connectivity import KEYS, moment_corr
from reliaspan.operators.ranking import cumulate, exact_quantiles, number_rows, with_value_bucket
from reliaspan.session import ensure_checkpoint_dir


#: Differences of averaged values up to this are rounding noise, whose sign follows the order of summation.
NOISE = 1e-12


def difference_stationarity(series: DataFrame, keys: Sequence[str] = KEYS, order: str = "window_id", value: str = "r") -> DataFrame:
    """(keys, i, j, p): pseudo p from the lag-1 autocorrelation of first differences.

    1 below three values, 0.01 for constant differences, otherwise (1 - acf)/2 within [.01, .99].
    """
    keys = [*keys, "i", "j"]
    w = Window.partitionBy(*keys).orderBy(order)
    diffs = series.withColumn("d", F.col(value) - F.lag(value).over(w))
    pairs = diffs.withColumn("dp", F.lag("d").over(w))
    n, acf = F.col("n"), clip("acf", -0.999, 0.999)
    agg = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("d").alias("vd"), moment_corr("dp", "d").alias("acf")
    )
    p = F.when(n < 3, 1.0).when(F.col("vd") < 1e-10, 0.01).otherwise(clip((1 - acf) / 2, 0.01, 0.99))
    return agg.select(*keys, p.alias("p"))


def dickey_fuller(series: DataFrame, keys: Sequence[str] = KEYS, order: str = "window_id", value: str = "r") -> DataFrame:
    """(keys, i, j, df_t): t statistic of gamma in d x_t = a + gamma x_{t-1}, from regression sums."""
    keys = [*keys, "i", "j"]
    w = Window.partitionBy(*keys).orderBy(order)
    rows = series.withColumn("x", F.lag(value).over(w)).withColumn("d", F.col(value) - F.col("x")).filter("x IS NOT NULL")
    n = F.count(F.lit(1))
    sxx, sxy, syy = F.var_pop("x") * n, F.covar_pop("x", "d") * n, F.var_pop("d") * n
    agg = rows.groupBy(*keys).agg(n.alias("n"), sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    resid = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(resid, (F.col("n") - 2) * F.col("sxx")))
    return agg.select(*keys, F.when(F.col("n") > 2, F.try_divide(slope, se)).alias("df_t"))


def cohens_d(features: DataFrame, group: str, one, two, value: str, feature: Sequence[str], by: Sequence[str] = (), min_group: int = 5) -> DataFrame:
    """Standardised mean difference per feature with the pooled sample SD (floored at 1e-10).

    Groups are conditional sums in one aggregation keyed by feature, so no group is gathered.
    """
    side = lambda g: F.when(F.col(group) == g, F.col(value))
    a, b = side(one), side(two)
    agg = features.groupBy(*by, *feature).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
        F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"),
    ).filter((F.col("n1") >= min_group) & (F.col("n2") >= min_group))
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    return agg.select(*by, *feature, ((F.col("m1") - F.col("m2")) / F.greatest(pooled, F.lit(1e-10))).alias("d"))


def effect_summary(d_map: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    a = F.abs("d")
    return d_map.groupBy(*by).agg(
        F.avg(a).alias("d_mean"), F.max(a).alias("d_max"), F.count(F.when(a > 0.2, 1)).alias("n_small"), F.count(F.when(a > 0.5, 1)).alias("n_medium")
    )


def assign_tertiles(subjects: DataFrame, value: str, low: float = 0.3333, high: float = 0.6667, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``tertile`` by exact quantiles of the whole cohort (<= on both cuts)."""
    by = list(by)
    cuts = exact_quantiles(subjects, value, [low, high], by)
    if by:
        joined = subjects.join(cuts, by)
    else:
        cut = cuts.first()
        joined = subjects.withColumns({"q0": F.lit(cut["q0"]), "q1": F.lit(cut["q1"])}) if cut else subjects.withColumns(
            {"q0": F.lit(None).cast("double"), "q1": F.lit(None).cast("double")}
        )
    v = F.col(value)
    t = F.when(v <= F.col("q0"), "t1_low").when(v <= F.col("q1"), "t2_mid").when(v.isNotNull(), "t3_high")
    return joined.withColumn("tertile", t).drop("q0", "q1")


def monotone(per_stratum: DataFrame, stratum: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, monotone): whether the value rises strictly from stratum to stratum."""
    nxt = F.lead(value).over(Window.partitionBy(*by).orderBy(stratum))
    rows = per_stratum.withColumn("_next", nxt).filter("_next IS NOT NULL")
    return rows.groupBy(*by).agg(F.bool_and(F.col("_next") > F.col(value)).alias("monotone"))


def paired_t(rows: DataFrame, subject: str, condition: str, value: str, baseline: str, n_tests: int | None = None) -> DataFrame:
    """(condition, n, mean_diff, t, df): baseline minus condition over subjects, paired.

    The baseline value reaches the other rows through a conditional maximum over the subject's few
    conditions, and the differences are aggregated directly.
    """
    base = F.max(F.when(F.col(condition) == baseline, F.col(value))).over(Window.partitionBy(subject))
    d = rows.withColumn("_d", base - F.col(value)).filter(F.col(condition) != baseline)
    agg = d.groupBy(condition).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("sd"))
    t = F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))
    return agg.select(condition, "n", "mean_diff", t.alias("t"), (F.col("n") - 1).alias("df"))


def bonferroni(tests: DataFrame, n_tests: int) -> DataFrame:
    """Adds the two-sided p of (t, df) and its Bonferroni correction."""
    return tests.withColumn("p", t_two_sided(F.col("t"), F.col("df").cast("double"))).withColumn(
        "p_bonferroni", F.when(F.col("p").isNotNull(), F.least(F.col("p") * n_tests, F.lit(1.0)))
    )


def friedman(rows: DataFrame, subject: str, condition: str, value: str) -> DataFrame:
    """(n, k, chi2, w): Friedman statistic and Kendall's W from average ranks within subjects."""
    w = Window.partitionBy(subject)
    rank = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(subject, value)) - 1) / 2
    sums = rows.withColumn("_rank", rank).groupBy(condition).agg(F.sum("_rank").alias("rs"), F.count(F.lit(1)).alias("n"))
    agg = sums.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("rs") * F.col("rs")).alias("ss"))
    n, k = F.col("n"), F.col("k")
    chi2 = 12.0 * F.col("ss") / (n * k * (k + 1)) - 3.0 * n * (k + 1)
    return agg.select("n", "k", chi2.alias("chi2"), (chi2 / (n * (k - 1))).alias("w"))


def adjust_p(tests: DataFrame, p: str, family: Sequence[str]) -> DataFrame:
    """Adds ``holm`` and ``bh`` within each family of tests.

    Equal p-values get equal results, so everything runs on counts per distinct value: ties, however
    many, shrink on the map side. The step-down maximum and step-up minimum run inside buckets of p and
    are completed by the extremes of the buckets before and after, so a family of any size spreads over
    tasks. A NULL or NaN p is not counted in its family and gets NULLs; NULL is a family like others.
    """
    key = F.struct(*family) if family else F.struct(F.lit(0).alias("_all"))
    ensure_checkpoint_dir(tests.sparkSession)
    rows = tests.withColumns({"_by": key, "_v": F.col(p).cast("double")}).checkpoint()
    counts = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_by", "_v").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    values = cumulate(with_value_bucket(counts, "_v", name="_b"), ["_by"], "_v", F.col("_b"), {"_end": "_n"})
    stepped = values.join(counts.groupBy("_by").agg(F.sum("_n").alias("_m")), "_by").withColumns({
        "_h": F.least(F.lit(1.0), F.col("_v") * (F.col("_m") - F.col("_end") + F.col("_n"))), "_q": F.col("_v") * F.col("_m") / F.col("_end"),
    })
    edge = stepped.groupBy("_by", "_b").agg(F.max("_h").alias("_hmax"), F.min("_q").alias("_qmin"))
    along = Window.partitionBy("_by").orderBy("_b")
    edge = edge.select(
        "_by", "_b", F.max("_hmax").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_hprev"),
        F.min("_qmin").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_qnext"),
    )
    inside = Window.partitionBy("_by", "_b").orderBy("_v")
    holm = F.max("_h").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bh = F.min("_q").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    done = stepped.withColumn("_h", holm).withColumn("_q", bh).join(edge, ["_by", "_b"])
    done = done.select("_by", "_v", F.greatest("_h", "_hprev").alias("holm"), F.least("_q", "_qnext", F.lit(1.0)).alias("bh"))
    return rows.join(done, ["_by", "_v"], "left").select(*tests.columns, "holm", "bh")


def permutation_p(observed: DataFrame, nulls: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, observed, p): (1 + #{null >= observed})/(n + 1) over the finite nulls; values that are equal but for rounding noise are ties."""
    by = list(by)
    obs = observed.select(*by, F.col(metric).alias("observed"))
    if by:
        both = nulls.join(obs, by)
    else:
        both = nulls.withColumn("observed", F.lit(obs.first()["observed"]))
    finite = F.col(metric).isNotNull() & ~F.isnan(metric)
    hits = F.count(F.when(finite & (F.col(metric) >= F.col("observed") - NOISE), 1))
    return both.groupBy(*by, "observed").agg(((hits + 1) / (F.count(F.when(finite, 1)) + 1)).alias("p"))


def run_summary(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], p_cols: Sequence[str]) -> DataFrame:
    """Mean and population SD of each metric, significance rate of each p, and the invalid share."""
    real = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        aggs += [F.avg(real(m)).alias(f"{m}_mean"), F.stddev_pop(real(m)).alias(f"{m}_std")]
    for p in p_cols:
        aggs.append(F.avg(F.when(real(p) < 0.05, 1.0).when(real(p).isNotNull(), 0.0)).alias(f"{p}_sig_rate"))
    aggs.append(F.avg(F.when(real(metrics[0]).isNull(), 1.0).otherwise(0.0)).alias("invalid_rate"))
    return runs.groupBy(*keys).agg(*aggs)


def _settled(difference: Column, noise: float) -> Column:
    return F.when(F.abs(difference) <= noise, 0.0).otherwise(difference)


def equivalent_duration(curve: DataFrame, duration: str, r: str, target: Column, by: Sequence[str] = (), noise: float = NOISE) -> DataFrame:
    """(by, target, duration): duration at which the observed curve reaches the target similarity.

    Piecewise linear in (r, duration) sorted by r, extrapolating with the end segments. Values of r that
    are equal but for rounding noise go by duration; with noise 0 values are compared as they are. A curve has
    one row per duration, so its window is short.
    """
    w = Window.partitionBy(*by).orderBy(F.round(r, 12) if noise else r, duration)
    seg = curve.withColumn("r1", F.lead(r).over(w)).withColumn("d1", F.lead(duration).over(w)).withColumn("_k", F.row_number().over(w))
    seg = seg.withColumn("_last", F.max("_k").over(Window.partitionBy(*by)) - 1).filter("r1 IS NOT NULL").withColumn("_t", target)
    t, lo, hi, k = F.col("_t"), F.col(r), F.col("r1"), F.col("_k")
    inside = ((_settled(t - lo, noise) >= 0) | (k == 1)) & ((_settled(t - hi, noise) < 0) | (k == F.col("_last")))
    value = F.col(duration) + F.try_divide(_settled(t - lo, noise), _settled(hi - lo, noise)) * (F.col("d1") - F.col(duration))
    return seg.filter(inside).groupBy(*by).agg(F.max("_t").alias("target"), F.max(value).alias("equivalent"))


def crossover(curve: DataFrame, duration: str, above: str, below: str, by: Sequence[str] = (), noise: float = NOISE) -> DataFrame:
    """(by, crossover): first duration at which ``above`` falls below ``below``, interpolated; differences up to ``noise`` are none."""
    w = Window.partitionBy(*by).orderBy(duration)
    diff = _settled(F.col(above) - F.col(below), noise)
    seg = curve.withColumn("_d", diff).withColumn("_n", F.lead(diff).over(w)).withColumn("_next", F.lead(duration).over(w))
    hit = seg.filter((F.col("_d") >= 0) & (F.col("_n") < 0))
    at = F.col(duration) + F.col("_d") / (F.col("_d") - F.col("_n")) * (F.col("_next") - F.col(duration))
    return hit.groupBy(*by).agg(F.min_by(at, duration).alias("crossover"))


def marginal_gain(curve: DataFrame, duration: str, value: str, seed: str = "seed", lo: str = "ci_lower", hi: str = "ci_upper") -> DataFrame:
    """Per duration: mean and sample SD over seeds of the value, its first difference and interval width."""
    gain = F.col(value) - F.lag(value).over(Window.partitionBy(seed).orderBy(duration))
    rows = curve.withColumn("gain", gain).withColumn("width", F.col(hi) - F.col(lo))
    aggs = []
    for src, name in ((value, "pred"), ("gain", "mg"), ("width", "ciw")):
        aggs += [F.avg(src).alias(f"{name}_mean"), F.stddev_samp(src).alias(f"{name}_sd")]
    return rows.groupBy(duration).agg(*aggs)


def representative_subject(subjects: DataFrame, columns: Sequence[str], key: str = "subject_id") -> DataFrame:
    """(key, distance) of the subject closest to the cohort means of ``columns`` (sum of absolute
    deviations); ties go to the smaller key."""
    means = subjects.agg(*[F.avg(c).alias(c) for c in columns]).first()
    dist = sum((F.abs(F.col(c) - F.lit(means[c])) for c in columns), F.lit(0.0))
    scored = subjects.withColumn("distance", dist)
    return scored.agg(F.min_by(F.struct(key, "distance"), F.struct("distance", key)).alias("s")).select(f"s.{key}", "s.distance")


def median_subject(subjects: DataFrame, value: str, key: str = "subject_id") -> DataFrame:
    """The subject at position n // 2 (0-based) of the ascending order by value, then key; no rows if no value is known.

    Counts per distinct value find the value at that position; only subjects with that value are
    ordered by key, in ranges of the key, so no tie of any size meets in one window.
    """
    ensure_checkpoint_dir(subjects.sparkSession)
    known = subjects.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double")).checkpoint()
    counts = known.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    n = counts.agg(F.sum("_n")).first()[0]
    if not n:
        return known.drop("_v")
    ends = cumulate(with_value_bucket(counts, "_v", name="_b"), [], "_v", F.col("_b"), {"_end": "_n"})
    at = ends.filter((F.col("_end") > n // 2) & (F.col("_end") - F.col("_n") <= n // 2)).first()
    ties = known.filter(F.col("_v") == F.lit(at["_v"])).repartitionByRange(value, key).withColumn("_range", F.spark_partition_id()).checkpoint()
    ranked = number_rows(ties, [], [value, key], F.col("_range"))
    return ranked.filter(F.col("rn") == n // 2 - (at["_end"] - at["_n"]) + 1).drop("rn", "_v", "_range")


def regression_line(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, intercept and r of y on x; NULL for a constant x."""
    vx = F.var_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    slope = F.when(vx > 1e-14, F.covar_pop(x, y) / vx)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return rows.groupBy(*by).agg(
        slope.alias("slope"), (F.avg(F.when(both, F.col(y))) - slope * F.avg(F.when(both, F.col(x)))).alias("intercept"),
        moment_corr(x, y).alias("r"), F.count(F.when(both, 1)).alias("n"),
    )


def kernel_density(rows: DataFrame, value: str, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, x, density): Gaussian kernel density on fixed grid points, Scott bandwidth n^(-1/5) * SD.

    Each value contributes to every grid point inside its own task; partial sums are combined.
    """
    by = list(by)
    stats = rows.groupBy(*by).agg((F.pow(F.count(value), F.lit(-0.2)) * F.stddev_samp(value)).alias("h"))
    if by:
        joined = rows.join(stats, by)
    else:
        joined = rows.withColumn("h", F.lit(stats.first()["h"]))
    z = (F.col("x") - F.col(value)) / F.col("h")
    k = F.exp(-z * z / 2) / (F.col("h") * F.lit(2.5066282746310002))
    points = F.array(*[F.lit(float(g)) for g in grid])
    return joined.filter(F.col(value).isNotNull()).withColumn("x", F.explode(points)).groupBy(*by, "x").agg(F.avg(k).alias("density"))


def quartile_summary(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Exact quartiles and IQR of groups of any size."""
    q = exact_quantiles(rows, value, [0.25, 0.5, 0.75], by)
    return q.select(*by, F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), (F.col("q2") - F.col("q0")).alias("iqr"))


def improvement_counts(rows: DataFrame, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    better = F.col(after) > F.col(before)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(better, 1)).alias("n_improved"),
        (F.avg(F.when(better, 1.0).otherwise(0.0)) * 100).alias("pct_improved"), F.avg(F.col(after) - F.col(before)).alias("mean_delta"),
    )
