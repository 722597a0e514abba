"""Component removal, progressive levels and the reference-choice experiments.

All levels of a study share one set of replicates; a level is a column expression over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliaspan.config import EstimatorConfig
from reliaspan.functions.reliability import bayes_shrink, clip, correct_attenuation, fisher_z, spearman_brown

CONDITIONS = ("L_full", "L_no_sb", "L_no_lw", "L_no_boot", "L_no_prior", "L_no_atten")
LEVELS = (("L0", "raw"), ("L1", "shrinkage"), ("L2", "bootstrap"), ("L3", "sb_attenuation"), ("L4", "prior"), ("L5", "full"))


def _fixed(cfg: EstimatorConfig, k, prior, method="fisher_z") -> Column:
    return correct_attenuation("r_obs", cfg.reliability_coeff, "r_split", k, prior, method, cfg.observation_var)


def _medians(rows: DataFrame, values: dict[str, Column], keys: Sequence[str], label: str, back: bool) -> DataFrame:
    """Median over replicates of several expressions at once, one output row per expression."""
    aggs = [F.percentile(c, F.lit(0.5)).alias(n) for n, c in values.items()]
    wide = rows.groupBy(*keys).agg(*aggs)
    out = (lambda c: F.tanh(c)) if back else (lambda c: c)
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias(label), out(F.col(n)).alias("rho_hat_t")) for n in values
    ])).alias("e")).select(*keys, "e.*")


def component_necessity(
    replicates: DataFrame, single: DataFrame, seeds: Sequence[int], k, config: EstimatorConfig, method: str = "fisher_z"
) -> DataFrame:
    """(subject_id, seed, condition, rho_hat_t) with one component removed at a time.

    ``replicates`` holds scores of both kinds, ledoit_wolf and pearson; ``single`` the unresampled
    (subject_id, r_obs, r_split). One aggregation serves the five resampled conditions.
    """
    keys, prior = ["subject_id", "seed"], config.empirical_prior
    shrunk = lambda z: F.when(F.col("kind") == "ledoit_wolf", z)
    full = fisher_z(_fixed(config, k, prior, method))
    by_rep = _medians(
        replicates,
        {
            "L_full": shrunk(full),
            "L_no_sb": shrunk(fisher_z(_fixed(config, 1.0, prior, method))),
            "L_no_prior": shrunk(fisher_z(_fixed(config, k, None, method))),
            "L_no_atten": shrunk(fisher_z(spearman_brown("r_obs", k))),
            "L_no_lw": F.when(F.col("kind") == "pearson", full),
        },
        keys, "condition", back=True,
    )
    no_boot = single.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).select(
        *keys, F.lit("L_no_boot").alias("condition"), F.tanh(full).alias("rho_hat_t")
    )
    return by_rep.unionByName(no_boot)


def with_delta(rows: DataFrame, label: str, baseline: str, name: str = "delta") -> DataFrame:
    """Difference from the baseline condition of the same (subject, seed); a handful of rows each."""
    w = Window.partitionBy("subject_id", "seed")
    return rows.withColumn(name, F.col("rho_hat_t") - F.max(F.when(F.col(label) == baseline, F.col("rho_hat_t"))).over(w))


def condition_summary(rows: DataFrame, label: str = "condition", delta: str = "delta") -> DataFrame:
    """Subject means first, then mean and SD over subjects of value and paired delta."""
    per = rows.groupBy(label, "subject_id").agg(F.avg("rho_hat_t").alias("rho"), F.avg(delta).alias("d"))
    return per.groupBy(label).agg(
        F.count("rho").alias("n"), F.avg("rho").alias("rho_mean"), F.stddev_samp("rho").alias("rho_sd"),
        F.avg("d").alias("delta_mean"), F.stddev_samp("d").alias("delta_sd"),
    )


def progressive_levels(replicates: DataFrame, base: DataFrame, seeds: Sequence[int], k, config: EstimatorConfig) -> DataFrame:
    """(subject_id, seed, level, rho_hat_t): components added one by one.

    ``base`` has (subject_id, r_raw, r_lw): plain and shrunk similarity of the unresampled window.
    """
    keys, prior = ["subject_id", "seed"], config.empirical_prior
    resampled = _medians(
        replicates,
        {
            "L2": F.col("r_obs"), "L3": _fixed(config, k, None), "L4": _fixed(config, k, prior),
            "L5": fisher_z(_fixed(config, k, prior)),
        },
        keys, "level", back=False,
    )
    value = F.when(F.col("level") == "L5", F.tanh("rho_hat_t")).otherwise(F.col("rho_hat_t"))
    return resampled.withColumn("rho_hat_t", value).unionByName(_per_seed(base, seeds, {"L0": F.col("r_raw"), "L1": F.col("r_lw")}))


def _per_seed(base: DataFrame, seeds: Sequence[int], levels: dict[str, Column]) -> DataFrame:
    """Levels without resampling, repeated for every seed."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), c.alias("rho_hat_t")) for n, c in levels.items()]))
    return base.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).select("subject_id", "seed", rows.alias("e")).select(
        "subject_id", "seed", "e.*"
    )


def level_summary(rows: DataFrame) -> DataFrame:
    """Mean per level, gain over the raw level and over the previous one (six rows)."""
    per = rows.groupBy("level").agg(F.avg("rho_hat_t").alias("mean_rho"), F.stddev_pop("rho_hat_t").alias("sd_rho"))
    w = Window.orderBy("level")
    return per.withColumn("from_previous", F.col("mean_rho") - F.lag("mean_rho").over(w)).withColumn(
        "from_raw", F.col("mean_rho") - F.first("mean_rho").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )


def auto_short_rows(n_rows) -> Column:
    return F.when(n_rows > 200, 48).otherwise(60)


def scaled_levels(
    replicates: DataFrame, base: DataFrame, seeds: Sequence[int], k, config: EstimatorConfig, passing: float = 0.8
) -> DataFrame:
    """The alternative level scheme r * sqrt(SB(split)), with error against the plain similarity.

    ``base`` has (subject_id, r_raw, split_raw, r_lw, split_lw, r_reference).
    """
    keys = ["subject_id", "seed"]
    scaled = lambda r, s: clip(F.col(r) * F.sqrt(spearman_brown(s, k)), -1, 1)
    mean, var = config.empirical_prior
    shrunk = clip(bayes_shrink("r_split", mean, var, config.observation_var), 0.001, 0.999)
    reps = _medians(
        replicates,
        {
            "L3": scaled("r_obs", "r_split"),
            "L4": clip(F.col("r_obs") * F.sqrt(spearman_brown(shrunk, k)), -1, 1),
            "L5": clip(_fixed(config, k, config.empirical_prior), -1, 1),
        },
        keys, "level", back=False,
    )
    first = _per_seed(base, seeds, {
        "L0": clip("r_raw", -1, 1), "L1": scaled("r_raw", "split_raw"), "L2": scaled("r_lw", "split_lw"),
    })
    rows = reps.unionByName(first).join(base.select("subject_id", "r_reference"), "subject_id")
    return rows.select(
        *keys, "level", "rho_hat_t", F.abs(F.col("rho_hat_t") - F.col("r_reference")).alias("mae"),
        F.when(F.col("rho_hat_t") >= passing, 1).otherwise(0).alias("passed"),
    )


def stratified_levels(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(k_group, level columns): subject-level means per group, pivoted over the fixed level names."""
    joined = rows.join(groups, "subject_id")
    names = [n for n, _ in LEVELS]
    return joined.groupBy("k_group").pivot("level", names).agg(F.avg("rho_hat_t"))


def site_table(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site: subjects, mean k, raw and full levels, their difference, and inclusion (k >= 2)."""
    pick = lambda lv: F.avg(F.when(F.col("level") == lv, F.col("rho_hat_t")))
    per = rows.groupBy("subject_id").agg(pick("L0").alias("raw"), pick("L5").alias("full"))
    return per.join(sites, "subject_id").groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.avg("k").alias("k"), F.avg("raw").alias("raw"), F.avg("full").alias("full"),
        F.avg(F.col("full") - F.col("raw")).alias("delta"), (F.avg("k") >= 2).alias("included"),
    )
