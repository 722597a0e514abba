"""Reliability formulas, block bootstrap and the estimator on the monthly supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliaspan.catalog.fixtures import K_FULL, segment_edges, short_frames
from reliaspan.catalog.registry import q6, query, r6
from reliaspan.catalog.sqlparts import (
    SHORT, SUFFIX, block_length, clip_sql, corr_expr, correction_sql, interval_sql, ledoit_wolf, pearson, replicates, resample, with_panel, zclip, z_space,
)
from reliaspan.config import EstimatorConfig
from reliaspan.functions.reliability import correct_by_name, CORRECTION_METHODS, fisher_z, spearman_brown, bayes_shrink
from reliaspan.operators.prep import normalise_weights
from reliaspan.operators.resample import (
    all_methods, average_edges, block_lengths, bootstrap_estimate, bootstrap_indices, channel_reliability, corrected_z,
    edge_reliability, replicate_edges, replicate_scores, seed_summary, split_half, summarise, window_estimates,
)
from reliaspan.operators.slices import sliding
from reliaspan.sources.panels import N_MONTHS, SHORT_ROWS, lineitem_frames

CONFIG = EstimatorConfig(n_channels=12, n_bootstraps=5, seed=1)
K = f"(CAST({N_MONTHS} AS DOUBLE) / {SHORT_ROWS})"
SEEDS = (1, 2)


def reference_edges(spark, sf_dir, fisher=True, segment="rest"):
    edges = segment_edges(spark, sf_dir, "ledoit_wolf", (segment,), fisher)
    return edges.drop("seg")


REF = [SHORT, SUFFIX, ledoit_wolf("REST", "REFR"), z_space("REFR", "REF")]


@query(
    "block_length",
    with_panel(block_length("S", "BL")) + f"SELECT subject_id, n_rows, {q6('ar1', 'ar1')}, block_len FROM BL",
)
def block_length_query(spark, sf_dir):
    return block_lengths(lineitem_frames(spark, sf_dir)).select("subject_id", "n_rows", r6("ar1"), "block_len")


@query(
    "split_half",
    with_panel(
        "HALF AS (SELECT *, CASE WHEN t < 41 THEN 1 ELSE 2 END AS half FROM S)",
        ledoit_wolf("HALF", "E", ("subject_id", "half")),
        f"""
H AS (SELECT a.subject_id, {corr_expr('a.r', 'b.r')} AS h FROM E a JOIN E b
  ON a.subject_id = b.subject_id AND a.i = b.i AND a.j = b.j AND a.half = 1 AND b.half = 2 GROUP BY ALL)""",
    )
    + f"SELECT subject_id, {q6(clip_sql('h', 0.001, 0.999), 'r_split')} FROM H",
)
def split_half_query(spark, sf_dir):
    return split_half(lineitem_frames(spark, sf_dir), N_MONTHS).select("subject_id", r6("r_split"))


@query(
    "bootstrap_indices",
    with_panel(SHORT, block_length("SHORT", "BL"), resample("BL", "IX", 5, SEEDS)) + "SELECT subject_id, seed, b, pos, src_t FROM IX",
)
def bootstrap_indices_query(spark, sf_dir):
    lengths = block_lengths(short_frames(spark, sf_dir))
    return bootstrap_indices(lengths, 5, SEEDS).select("subject_id", "seed", "b", "pos", "src_t")


REPS = with_panel(*REF, replicates("SHORT", "REF", "RP", 5, SEEDS, fisher=True))


@query(
    "bootstrap_replicates",
    REPS + f"SELECT subject_id, seed, b, {q6('r_obs', 'r_obs')}, {q6('r_split', 'r_split')} FROM RP",
)
def bootstrap_replicates(spark, sf_dir):
    out = replicate_scores(short_frames(spark, sf_dir), reference_edges(spark, sf_dir), 5, SEEDS, fisher=True)
    return out.select("subject_id", "seed", "b", r6("r_obs"), r6("r_split"))


def estimate_sql(method: str, extra: str = "", keys=("subject_id", "seed")) -> str:
    z = zclip(correction_sql(method, "r_obs", "r_split", K))
    return with_panel(*REF, replicates("SHORT", "REF", "RP", 5, SEEDS, fisher=True), interval_sql("RP", "EST", z, keys)) + extra


@query(
    "bootstrap_estimate",
    estimate_sql("fisher_z")
    + f"SELECT subject_id, seed, {q6('rho_hat_t', 'rho_hat_t')}, {q6('ci_lower', 'ci_lower')}, {q6('ci_upper', 'ci_upper')} FROM EST",
)
def bootstrap_estimate_query(spark, sf_dir):
    out = bootstrap_estimate(
        short_frames(spark, sf_dir), reference_edges(spark, sf_dir), CONFIG, SEEDS, K_FULL, "fisher_z", fisher=True
    )
    return out.select("subject_id", "seed", r6("rho_hat_t"), r6("ci_lower"), r6("ci_upper"))


METHOD_ROWS = " UNION ALL ".join(
    f"SELECT subject_id, '{m}' AS method, {zclip(correction_sql(m, 'r_obs', 'r_split', K))} AS zz FROM RP WHERE seed = 1"
    for m in CORRECTION_METHODS
)
METHODS_SQL = REPS[:-1] + f", MR AS ({METHOD_ROWS})," + interval_sql("MR", "EST", "zz", ("subject_id", "method")) + "\n"


def method_rows(spark, sf_dir):
    reps = replicate_scores(short_frames(spark, sf_dir), reference_edges(spark, sf_dir), 5, (1,), fisher=True)
    return all_methods(reps, CONFIG, K_FULL, ["subject_id"])


@query(
    "bootstrap_multi_method",
    METHODS_SQL
    + f"SELECT subject_id, method, {q6('rho_hat_t', 'rho_hat_t')}, {q6('ci_lower', 'ci_lower')}, {q6('ci_upper', 'ci_upper')} FROM EST",
)
def bootstrap_multi_method(spark, sf_dir):
    return method_rows(spark, sf_dir).select("subject_id", "method", r6("rho_hat_t"), r6("ci_lower"), r6("ci_upper"))


@query(
    "multi_seed",
    estimate_sql("fisher_z")
    + f"""SELECT subject_id, {q6('avg(rho_hat_t)', 'rho_mean')}, {q6('stddev_pop(rho_hat_t)', 'rho_std')},
      {q6('min(rho_hat_t)', 'rho_min')}, {q6('max(rho_hat_t)', 'rho_max')}, {q6('avg(ci_lower)', 'ci_lower_mean')},
      {q6('avg(ci_upper)', 'ci_upper_mean')} FROM EST GROUP BY subject_id""",
)
def multi_seed(spark, sf_dir):
    est = bootstrap_estimate(
        short_frames(spark, sf_dir), reference_edges(spark, sf_dir), CONFIG, SEEDS, K_FULL, "fisher_z", fisher=True
    )
    out = seed_summary(est)
    return out.select("subject_id", *[r6(c) for c in out.columns if c != "subject_id"])


SPLIT_SQL = with_panel(
    "HALF AS (SELECT *, CASE WHEN t < 41 THEN 1 ELSE 2 END AS half FROM S)",
    pearson("HALF", "E", ("subject_id", "half"), constant="0"),
    f"""
H AS (SELECT a.subject_id, {corr_expr('a.r', 'b.r')} AS h, avg(a.r * a.r) AS q FROM E a JOIN E b
  ON a.subject_id = b.subject_id AND a.i = b.i AND a.j = b.j AND a.half = 1 AND b.half = 2 GROUP BY ALL)""",
)


@query(
    "attenuation_methods",
    SPLIT_SQL
    + "SELECT subject_id, "
    + ", ".join(q6(correction_sql(m, "h", "q", "4"), m) for m in CORRECTION_METHODS)
    + f", {q6(correction_sql('original', 'h', 'q', '4', prior=None), 'no_prior')}"
    + f", {q6('atanh(' + clip_sql('h', -0.9999, 0.9999) + ')', 'z')}, {q6('4 * least(0.999, greatest(0.001, q)) / (1 + 3 * least(0.999, greatest(0.001, q)))', 'sb')}"
    + f", {q6('0.25 * q + 0.75 * 0.25', 'shrunk')} FROM H",
)
def attenuation_methods(spark, sf_dir):
    """Every scalar reliability formula on measured similarities."""
    from reliaspan.operators.connectivity import fc_edges, moment_corr, side_by_side
    from reliaspan.operators.slices import label_segments

    halves = label_segments(lineitem_frames(spark, sf_dir), {"a": F.col("t") < 41, "b": F.col("t") >= 41}, "half")
    wide = side_by_side(fc_edges(halves, ["subject_id", "half"], constant=0.0), ["subject_id"], "half", ("a", "b"))
    base = wide.groupBy("subject_id").agg(moment_corr("a", "b").alias("h"), F.avg(F.col("a") * F.col("a")).alias("q"))
    prior = (0.25, 0.05)
    cols = [r6(correct_by_name(F.lit(m), "h", 0.98, "q", 4, prior), m) for m in CORRECTION_METHODS]
    return base.select(
        "subject_id", *cols, r6(correct_by_name(F.lit("original"), "h", 0.98, "q", 4), "no_prior"),
        r6(fisher_z("h"), "z"), r6(spearman_brown("q", 4), "sb"), r6(bayes_shrink("q", *prior), "shrunk"),
    )


def replicate_edges_sql(kind, fixed_len=None):
    lens = (
        f"\nRL AS (SELECT DISTINCT subject_id, 16 AS n_rows, {fixed_len} AS block_len FROM subj)"
        if fixed_len else block_length("SHORT", "RL")
    )
    fc = ledoit_wolf if kind == "ledoit_wolf" else (lambda a, b, c, d: pearson(a, b, c, d, "0"))
    return [
        SHORT, lens, resample("RL", "RX", 5, (1,)),
        "\nRR AS (SELECT x.subject_id, seed, b, pos, channel, value FROM RX x JOIN SHORT s ON s.subject_id = x.subject_id AND s.t = x.src_t)",
        fc("RR", "RE", ("subject_id", "seed", "b"), "pos"),
    ]


def _replicate_edges(spark, sf_dir, kind, fixed_len=None):
    short = short_frames(spark, sf_dir)
    if fixed_len:
        lengths = short.groupBy("subject_id").agg(F.count(F.lit(1)).cast("int").alias("n_rows")).withColumn("block_len", F.lit(fixed_len))
    else:
        lengths = block_lengths(short)
    edges = replicate_edges(short, lengths, 5, (1,), kind=kind)
    return edges.withColumn("r", F.coalesce("r", F.lit(0.0)))


@query(
    "bootstrap_mean_fc",
    with_panel(*replicate_edges_sql("ledoit_wolf")) + f"SELECT subject_id, i, j, {q6('avg(r)', 'r')} FROM RE GROUP BY 1, 2, 3",
)
def bootstrap_mean_fc(spark, sf_dir):
    return average_edges(_replicate_edges(spark, sf_dir, "ledoit_wolf")).select("subject_id", "i", "j", r6("r"))


@query(
    "bootstrap_median_fc",
    with_panel(*replicate_edges_sql("ledoit_wolf"))
    + f"SELECT subject_id, i, j, {q6('quantile_cont(CAST(r AS DOUBLE), 0.5)', 'r')} FROM RE GROUP BY 1, 2, 3",
)
def bootstrap_median_fc(spark, sf_dir):
    return average_edges(_replicate_edges(spark, sf_dir, "ledoit_wolf"), how="median").select("subject_id", "i", "j", r6("r"))


RELIABILITY = with_panel(
    *replicate_edges_sql("pearson", 10),
    """
SD AS (SELECT subject_id, i, j, stddev_pop(r) AS sd FROM RE GROUP BY 1, 2, 3),
REL AS (SELECT subject_id, i, j, 1 - sd / max(sd) OVER (PARTITION BY subject_id) AS reliability FROM SD)""",
)


def _reliability(spark, sf_dir):
    return edge_reliability(_replicate_edges(spark, sf_dir, "pearson", 10))


@query("edge_reliability", RELIABILITY + f"SELECT subject_id, i, j, {q6('reliability', 'reliability')} FROM REL")
def edge_reliability_query(spark, sf_dir):
    return _reliability(spark, sf_dir).select("subject_id", "i", "j", r6("reliability"))


@query(
    "channel_reliability_weights",
    RELIABILITY[:-1]
    + f""", CH AS (SELECT subject_id, channel, avg(reliability) AS reliability FROM (
      SELECT subject_id, i AS channel, reliability FROM REL UNION ALL SELECT subject_id, j, reliability FROM REL) GROUP BY 1, 2)
      SELECT subject_id, channel, {q6('reliability', 'reliability')}, {q6('0.1 + 0.9 * (reliability - min(reliability) OVER w) / (max(reliability) OVER w - min(reliability) OVER w)', 'weight')}
      FROM CH WINDOW w AS (PARTITION BY subject_id)""",
)
def channel_reliability_weights(spark, sf_dir):
    out = normalise_weights(channel_reliability(_reliability(spark, sf_dir)))
    return out.select("subject_id", "channel", r6("reliability"), r6("weight"))


K_WINDOW = 83 / 8
WINDOWED = with_panel(
    *REF,
    "\nWIN AS (SELECT subject_id, CAST(w.w AS INTEGER) AS window_id, channel, t - w.w * 2 AS t, value FROM SHORT JOIN range(5) w(w) ON t >= w.w * 2 AND t < w.w * 2 + 8)",
    replicates("WIN", "REF", "RP", 3, (1,), ("subject_id", "window_id"), fisher=True, ref_keys=("subject_id",)),
    interval_sql("RP", "EST", zclip(correction_sql("fisher_z", "r_obs", "r_split", "(83 / CAST(8 AS DOUBLE))")), ("subject_id", "window_id")),
    """
WZ AS (SELECT subject_id, CAST(atanh(CASE WHEN rho_hat_t IS NOT NULL THEN least(0.9999, greatest(-0.9999, rho_hat_t)) END) AS DOUBLE) AS z FROM EST),
WA AS (SELECT subject_id, quantile_cont(z, 0.5) AS m, quantile_cont(z, 0.025) AS lo, quantile_cont(z, 0.975) AS hi, stddev_pop(z) AS sd, count(z) AS n FROM WZ GROUP BY 1)""",
)


@query(
    "sliding_window_estimate",
    WINDOWED
    + f"""SELECT subject_id, CAST(n AS BIGINT) AS n_windows, {q6('tanh(m)', 'rho_hat_t')},
      {q6('tanh(CASE WHEN n >= 4 THEN lo ELSE m - sd END)', 'ci_lower')}, {q6('tanh(CASE WHEN n >= 4 THEN hi ELSE m + sd END)', 'ci_upper')} FROM WA""",
)
def sliding_window_estimate(spark, sf_dir):
    windows = sliding(short_frames(spark, sf_dir), SHORT_ROWS, 8, 2)
    windows = windows.withColumn("t", F.col("t") - F.col("window_id") * 2)
    reps = replicate_scores(windows, reference_edges(spark, sf_dir), 3, (1,), ["subject_id", "window_id"], fisher=True)
    est = summarise(reps, corrected_z(CONFIG, K_WINDOW, "fisher_z"), ["subject_id", "window_id"])
    out = window_estimates(est, ["subject_id"])
    return out.select("subject_id", "n_windows", r6("rho_hat_t"), r6("ci_lower"), r6("ci_upper"))
