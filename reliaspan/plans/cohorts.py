"""Cohort-level reports over per-subject results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliaspan.operators.ranking import exact_quantiles


def cohort_summary(rows: DataFrame, group: str = "grp", raw: str = "r_fc_raw", rho: str = "rho_hat_t") -> DataFrame:
    """Overall (NULL group) and per group: n, mean and SD of both values, exact median, % improved.

    Means come from one grouping-sets pass; medians use bucketed order statistics, since a group may
    hold most of the cohort.
    """
    better = F.col(rho) > F.col(raw)
    stats = rows.groupingSets([[group], []], group).agg(
        F.grouping(group).alias("overall"), F.count(F.lit(1)).alias("n"), F.avg(raw).alias("raw_mean"), F.stddev_pop(raw).alias("raw_sd"),
        F.avg(rho).alias("rho_mean"), F.stddev_pop(rho).alias("rho_sd"),
        (F.avg(F.when(better, 1.0).when(better.isNotNull(), 0.0)) * 100).alias("pct_improved"),
    )
    doubled = rows.select(F.col(rho).alias("_v"), F.explode(F.array(
        F.struct(F.lit(0).alias("overall"), F.col(group).alias("g")), F.struct(F.lit(1).alias("overall"), F.lit(None).cast(rows.schema[group].dataType).alias("g"))
    )).alias("e")).select("_v", "e.overall", "e.g")
    med = exact_quantiles(doubled, "_v", [0.5], ["overall", "g"]).withColumnRenamed("q0", "rho_median")
    return stats.join(
        med.withColumnRenamed("overall", "_o"),
        (stats["overall"] == F.col("_o")) & stats[group].eqNullSafe(F.col("g")), "left",
    ).drop("_o", "g", "overall")


def multi_seed_summary(per_subject: DataFrame, group: str = "grp", site: str = "site") -> DataFrame:
    """Grouping sets overall, by group and by site: estimate, seed stability, ceiling count."""
    return per_subject.groupingSets([[], [group], [site]], group, site).agg(
        F.count(F.lit(1)).alias("n"), F.avg("rho_mean").alias("rho_mean"), F.stddev_pop("rho_mean").alias("rho_sd"),
        F.avg("rho_std").alias("seed_sd"), F.count(F.when(F.col("rho_mean") >= 0.999, 1)).alias("n_ceiling"),
    )


def method_comparison(rows: DataFrame, raw: str = "r_raw", by: str = "method") -> DataFrame:
    """Per correction method: spread, exact median, ceiling and near-ceiling share, improvement.

    Improvement pairs each estimate with its own subject's raw similarity.
    """
    r = F.col("rho_hat_t")
    share = lambda c: F.avg(F.when(c, 100.0).when(r.isNotNull(), 0.0))
    stats = rows.groupBy(by).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), F.min(r).alias("min"), F.max(r).alias("max"),
        share(r >= 0.999).alias("ceiling_pct"), share(r > 0.99).alias("above_99_pct"), F.avg(r - F.col(raw)).alias("improvement"),
    )
    med = exact_quantiles(rows, "rho_hat_t", [0.5], [by]).withColumnRenamed("q0", "median")
    return stats.join(med, by)


def quality_metrics(edges: DataFrame, spread: DataFrame) -> DataFrame:
    """Per subject: mean, SD and median edge, channels with any variation, mean channel SD.

    ``edges`` are one subject's bounded pairs; ``spread`` is (subject_id, channel, sd).
    """
    e = edges.groupBy("subject_id").agg(
        F.avg("r").alias("fc_mean"), F.stddev_pop("r").alias("fc_sd"), F.percentile("r", F.lit(0.5)).alias("fc_median")
    )
    s = spread.groupBy("subject_id").agg(F.count(F.when(F.col("sd") > 0, 1)).alias("n_nonzero"), F.avg("sd").alias("mean_sd"))
    return e.join(s, "subject_id")


def pass_fail_profile(characteristics: DataFrame, columns: Sequence[str], rho: str = "rho_hat_t", passing: float = 0.8) -> DataFrame:
    """Mean of each characteristic among passing and failing subjects."""
    flagged = characteristics.withColumn("passed", F.coalesce(F.col(rho) >= passing, F.lit(False)))
    return flagged.groupBy("passed").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def subject_characteristics(short_samples: DataFrame, channel_limit: int = 50, signal: str | None = None) -> DataFrame:
    """Per subject: mean AR(1) of the first channels, near-constant channels, mean spatial variance,
    and the signal-to-noise ratio when a noise-free ``signal`` column exists."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject_id", "channel").orderBy("t")
    rows = short_samples.withColumn("_p", F.lag("value").over(w))
    v, p = F.col("value"), F.col("_p")
    noise = v - F.col(signal) if signal else F.lit(None).cast("double")
    sig = F.col(signal) if signal else F.lit(None).cast("double")
    per_channel = rows.groupBy("subject_id", "channel").agg(
        F.var_pop(v).alias("var"), F.var_pop(p).alias("vp"), F.var_pop(F.when(p.isNotNull(), v)).alias("vn"), F.covar_pop(p, v).alias("cv"),
        F.var_pop(sig).alias("sv"), F.var_pop(noise).alias("nv"),
    )
    ar = F.when(F.col("var") > 1e-20, F.try_divide(F.col("cv"), F.sqrt(F.col("vp") * F.col("vn"))))
    channels = per_channel.groupBy("subject_id").agg(
        F.coalesce(F.avg(F.when(F.col("channel") < channel_limit, ar)), F.lit(0.0)).alias("mean_ar1"),
        F.count(F.when(F.col("var") < 1e-6, 1)).alias("n_low_var"),
        F.try_divide(F.avg("sv"), F.when(F.avg("nv") > 1e-10, F.avg("nv"))).alias("snr"),
    )
    spatial = short_samples.groupBy("subject_id", "t").agg(F.var_pop("value").alias("v")).groupBy("subject_id").agg(F.avg("v").alias("temporal_var"))
    return channels.join(spatial, "subject_id")
