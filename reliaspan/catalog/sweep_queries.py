"""Sweep, ablation and cohort-run queries on the monthly supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliaspan.catalog.fixtures import K_FULL, segment_conditions, segment_edges, short_frames, with_attributes
from reliaspan.catalog.registry import q6, query, r6
from reliaspan.catalog.resample_queries import CONFIG, K, METHODS_SQL, REF, REPS, SEEDS, method_rows, reference_edges, replicate_edges_sql
from reliaspan.catalog.sqlparts import (
    SHORT, SUFFIX, clip_sql, corr_expr, correction_sql, hash_sql, interval_sql, ledoit_wolf, pearson, replicates, sb_sql, similarity,
    with_panel, z_space, zclip,
)
from reliaspan.operators.clean import channel_spread
from reliaspan.operators.connectivity import edge_similarity, fc_edges, moment_corr, side_by_side
from reliaspan.operators.edges import combine_edges
from reliaspan.operators.resample import (
    average_edges, block_lengths, bootstrap_estimate, corrected_z, replicate_edges, replicate_scores, seed_summary, summarise, window_estimates,
)
from reliaspan.operators.ridge import held_out_ridge, prediction_r2
from reliaspan.operators.similarity import spearman
from reliaspan.operators.slices import label_segments, sliding
from reliaspan.plans.ablations import (
    component_necessity, condition_summary, level_summary, progressive_levels, scaled_levels, site_table, stratified_levels, with_delta,
)
from reliaspan.plans.cohorts import (
    cohort_summary, method_comparison, multi_seed_summary, pass_fail_profile, quality_metrics, subject_characteristics,
)
from reliaspan.plans.sweeps import (
    add_noise, convergence_curve, convergence_similarity, convergence_summary, duration_sweep, grid_summary, keep_channels, offset_pairs, offset_subjects, offset_summary, parameter_grid_estimates, pass_interval, seed_first_summary, subject_first_summary,
)
from reliaspan.session import materialise
from reliaspan.sources.panels import N_CHANNELS, N_MONTHS, SHORT_ROWS, frames_to_samples, lineitem_frames, lineitem_samples

DURATIONS = (32, 60)


def timed_frames(spark, sf_dir):
    return with_attributes(lineitem_frames(spark, sf_dir)).withColumn("n_rows", F.lit(N_MONTHS)).drop("grp", "site")


def _sweep_ctes(mode, z=True):
    guard = "floor(d / tr) + 10 <= 83" + (" AND 83 - floor(d / tr) >= greatest(12, floor(30 / tr))" if mode == "split" else "")
    durs = ", ".join(map(str, DURATIONS))
    space = z_space if z else (lambda a, b, c=(): f"\n{b} AS (SELECT * FROM {a})")
    keys = ("subject_id", "duration_sec")
    base = [
        f"DD AS (SELECT a.subject_id, a.tr, CAST(d AS INTEGER) AS duration_sec, CAST(floor(d / tr) AS INTEGER) AS ns FROM attrs a CROSS JOIN (SELECT unnest([{durs}]) AS d) WHERE {guard})",
        "DS AS (SELECT S.*, duration_sec FROM S JOIN DD ON DD.subject_id = S.subject_id AND t < ns)",
        ledoit_wolf("DS", "DSE", keys), space("DSE", "DSZ", keys),
    ]
    if mode == "split":
        base += ["DR AS (SELECT S.*, duration_sec FROM S JOIN DD ON DD.subject_id = S.subject_id AND t >= ns)", ledoit_wolf("DR", "DRE", keys), space("DRE", "DRZ", keys)]
        ref_keys = keys
    else:
        base += [ledoit_wolf("S", "DRE"), space("DRE", "DRZ", ("subject_id",))]
        ref_keys = ("subject_id",)
    return [*base, similarity("DSZ", "DRZ", "RAW", keys, ref_keys, "r_fc_raw"),
            replicates("DS", "DRZ", "RP", 3, SEEDS, keys, fisher=z, ref_keys=ref_keys),
            "\nRK AS (SELECT RP.*, floor(900 / tr) / ns AS k FROM RP JOIN DD USING (subject_id, duration_sec))",
            interval_sql("RK", "EST", zclip(correction_sql("fisher_z", "r_obs", "r_split", "k")), (*keys, "seed")),
            "\nSWP AS (SELECT EST.*, r_fc_raw, rho_hat_t - r_fc_raw AS improvement FROM EST JOIN RAW USING (subject_id, duration_sec))"]


SWEEP_CONFIG = CONFIG.__class__(n_channels=12, n_bootstraps=3, seed=1)


def _sweep(spark, sf_dir, mode, fisher=True):
    return duration_sweep(timed_frames(spark, sf_dir), DURATIONS, SEEDS, SWEEP_CONFIG, mode, fisher=fisher)


SWEEP_COLS = ("r_fc_raw", "rho_hat_t", "ci_lower", "ci_upper", "improvement")
SWEEP_OUT = "SELECT subject_id, duration_sec, seed, " + ", ".join(q6(c, c) for c in SWEEP_COLS) + " FROM SWP"


@query("duration_sweep_split", with_panel(*_sweep_ctes("split")) + SWEEP_OUT)
def duration_sweep_split(spark, sf_dir):
    return _sweep(spark, sf_dir, "split").select("subject_id", "duration_sec", "seed", *[r6(c) for c in SWEEP_COLS])


@query("duration_sweep_full", with_panel(*_sweep_ctes("full")) + SWEEP_OUT)
def duration_sweep_full(spark, sf_dir):
    return _sweep(spark, sf_dir, "full").select("subject_id", "duration_sec", "seed", *[r6(c) for c in SWEEP_COLS])


@query("duration_sweep_plain_space", with_panel(*_sweep_ctes("full", z=False)) + SWEEP_OUT)
def duration_sweep_plain(spark, sf_dir):
    return _sweep(spark, sf_dir, "full", fisher=False).select("subject_id", "duration_sec", "seed", *[r6(c) for c in SWEEP_COLS])


@query(
    "duration_aggregate",
    with_panel(
        *_sweep_ctes("split"),
        """
SL AS (SELECT duration_sec, seed, count(*) AS n, avg(r_fc_raw) AS r_fc, avg(rho_hat_t) AS rho_hat_t, avg(improvement) AS improvement,
  avg(ci_upper - ci_lower) AS ci_width FROM SWP GROUP BY 1, 2)""",
    )
    + "SELECT duration_sec, CAST(arg_max(n, seed) AS BIGINT) AS n_subjects, CAST(count(*) AS BIGINT) AS n_seeds, "
    + ", ".join(f"{q6(f'avg({c})', f'{c}_mean')}, {q6(f'stddev_pop({c})', f'{c}_sd')}" for c in ("r_fc", "rho_hat_t", "improvement", "ci_width"))
    + " FROM SL GROUP BY 1",
)
def duration_aggregate(spark, sf_dir):
    out = seed_first_summary(_sweep(spark, sf_dir, "split"))
    return out.select("duration_sec", "n_subjects", "n_seeds", *[r6(c) for c in out.columns[3:]])


@query(
    "subject_first_aggregate",
    with_panel(*_sweep_ctes("split"), "SF AS (SELECT duration_sec, subject_id, avg(r_fc_raw) AS a, avg(rho_hat_t) AS b FROM SWP GROUP BY 1, 2)")
    + f"""SELECT duration_sec, CAST(count(*) AS BIGINT) AS n_subjects, {q6('avg(a)', 'r_fc_raw_mean')}, {q6('stddev_samp(a)', 'r_fc_raw_sd')},
      {q6('avg(b)', 'rho_hat_t_mean')}, {q6('stddev_samp(b)', 'rho_hat_t_sd')} FROM SF GROUP BY 1""",
)
def subject_first_aggregate(spark, sf_dir):
    out = subject_first_summary(_sweep(spark, sf_dir, "split"), "duration_sec", ["r_fc_raw", "rho_hat_t"])
    return out.select("duration_sec", "n_subjects", *[r6(c) for c in out.columns[2:]])


TAU_REFS = (30, 60, 90, 120)
CONV = [
    f"TS AS (SELECT a.subject_id, tr, CAST(s AS INTEGER) AS tau_short, CAST(floor(s / tr) AS INTEGER) AS ns FROM attrs a CROSS JOIN (SELECT unnest([{', '.join(map(str, DURATIONS))}]) AS s))",
    f"TR AS (SELECT TS.*, CAST(r AS INTEGER) AS tau_ref, CAST(floor(r / tr) AS INTEGER) AS nr FROM TS CROSS JOIN (SELECT unnest([{', '.join(map(str, TAU_REFS))}]) AS r) WHERE floor(r / tr) >= 12 AND floor(r / tr) <= 83 - ns)",
    "CS AS (SELECT S.*, tau_short FROM S JOIN TS ON TS.subject_id = S.subject_id AND t < ns)",
    "CR AS (SELECT S.*, tau_short, tau_ref FROM S JOIN TR ON TR.subject_id = S.subject_id AND t >= ns AND t < ns + nr)",
    ledoit_wolf("CS", "CSE", ("subject_id", "tau_short")), z_space("CSE", "CSZ", ("subject_id", "tau_short")),
    ledoit_wolf("CR", "CRE", ("subject_id", "tau_short", "tau_ref")), z_space("CRE", "CRZ", ("subject_id", "tau_short", "tau_ref")),
    similarity("CRZ", "CSZ", "CV0", ("subject_id", "tau_short", "tau_ref"), ("subject_id", "tau_short"), "r_fc"),
    "\nCV AS (SELECT CV0.*, nr * tr AS ref_actual_sec FROM CV0 JOIN TR USING (subject_id, tau_short, tau_ref))",
]


def _convergence(spark, sf_dir):
    return convergence_similarity(timed_frames(spark, sf_dir), DURATIONS, TAU_REFS)


@query("convergence_rfc", with_panel(*CONV) + f"SELECT subject_id, tau_short, tau_ref, {q6('ref_actual_sec', 'ref_actual_sec')}, {q6('r_fc', 'r_fc')} FROM CV")
def convergence_rfc(spark, sf_dir):
    return _convergence(spark, sf_dir).select("subject_id", "tau_short", "tau_ref", r6("ref_actual_sec"), r6("r_fc"))


CURVE = "\nCC AS (SELECT tau_short, tau_ref, avg(r_fc) AS mean_r, stddev_samp(r_fc) AS sd_r, count(r_fc) AS n FROM CV GROUP BY 1, 2 HAVING count(r_fc) >= 20)"


@query("convergence_curve", with_panel(*CONV, CURVE) + f"SELECT tau_short, tau_ref, {q6('mean_r', 'mean_r')}, {q6('sd_r', 'sd_r')}, CAST(n AS BIGINT) AS n FROM CC")
def convergence_curve_query(spark, sf_dir):
    return convergence_curve(_convergence(spark, sf_dir)).select("tau_short", "tau_ref", r6("mean_r"), r6("sd_r"), "n")


@query(
    "convergence_summary",
    with_panel(
        *CONV, CURVE, *_sweep_ctes("split"),
        """
PK AS (SELECT tau_short, max(mean_r) AS r_peak, arg_max(tau_ref, mean_r) AS tau_peak, max(tau_ref) AS tau_max FROM CC GROUP BY 1),
RH AS (SELECT duration_sec AS tau_short, subject_id, avg(rho_hat_t) AS rho, stddev_samp(rho_hat_t) AS seed_sd FROM SWP GROUP BY 1, 2),
LV AS (SELECT tau_short, avg(rho) AS rho_mean, stddev_samp(rho) AS rho_sd, avg(seed_sd) AS seed_sd FROM RH GROUP BY 1),
GP AS (SELECT CV.tau_short, avg(rho - r_fc) AS gap_subject_mean, avg(CASE WHEN rho - r_fc > 0 THEN 1.0 WHEN rho - r_fc IS NOT NULL THEN 0 END) AS share_positive
  FROM CV JOIN PK ON PK.tau_short = CV.tau_short AND CV.tau_ref = PK.tau_max JOIN RH ON RH.tau_short = CV.tau_short AND RH.subject_id = CV.subject_id GROUP BY 1)""",
    )
    + f"""SELECT tau_short, tau_peak, tau_max, {q6('r_peak', 'r_peak')}, {q6('rho_mean', 'rho_mean')}, {q6('rho_sd', 'rho_sd')}, {q6('seed_sd', 'seed_sd')},
      {q6('gap_subject_mean', 'gap_subject_mean')}, {q6('share_positive', 'share_positive')}, {q6('rho_mean - r_peak', 'gap')} FROM PK JOIN LV USING (tau_short) JOIN GP USING (tau_short)""",
)
def convergence_summary_query(spark, sf_dir):
    est = _sweep(spark, sf_dir, "split").withColumnRenamed("duration_sec", "tau_short")
    out = convergence_summary(_convergence(spark, sf_dir), est)
    return out.select("tau_short", "tau_peak", "tau_max", *[r6(c) for c in ("r_peak", "rho_mean", "rho_sd", "seed_sd", "gap_subject_mean", "share_positive", "gap")])


HELD_KEYS = ("subject_id", "seed")
HELD = [
    SHORT, SUFFIX, "B1 AS (SELECT * FROM REST WHERE t < 16 + 33)", "B2 AS (SELECT * FROM REST WHERE t >= 16 + 33)",
    pearson("SHORT", "FA", constant="0"), pearson("REST", "FB", constant="0"), pearson("B1", "FB1", constant="0"), pearson("B2", "FB2", constant="0"),
    ledoit_wolf("REST", "FBL"),
]


def _spear(a, b, out, where="TRUE", minimum=0):
    return f"""
{out} AS (SELECT subject_id, CASE WHEN count(*) > {minimum} THEN {corr_expr('ra', 'rb')} END AS s FROM (
  SELECT x.subject_id, rank() OVER (PARTITION BY x.subject_id ORDER BY x.r) + (count(*) OVER (PARTITION BY x.subject_id, x.r) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY x.subject_id ORDER BY y.r) + (count(*) OVER (PARTITION BY x.subject_id, y.r) - 1) / 2.0 AS rb
  FROM {a} x JOIN {b} y ON x.subject_id = y.subject_id AND x.i = y.i AND x.j = y.j WHERE {where}) GROUP BY 1)"""


HELD_FULL = [
    *HELD, _spear("FA", "FB", "AB"), _spear("FB1", "FB2", "BB"), _spear("FA", "FB", "STR", "abs(y.r) >= 0.05", 10),
    replicates("SHORT", "FBL", "RP", 3, SEEDS),
    interval_sql("RP", "BP", zclip(correction_sql("fisher_z", "r_obs", "r_split", K)), HELD_KEYS),
    "\nWIN AS (SELECT subject_id, CAST(w.w AS INTEGER) AS window_id, channel, t - w.w * 2 AS t, value FROM SHORT JOIN range(5) w(w) ON t >= w.w * 2 AND t < w.w * 2 + 8)",
    replicates("WIN", "FBL", "RW", 3, SEEDS, ("subject_id", "window_id"), ref_keys=("subject_id",)),
    interval_sql("RW", "WE", zclip(correction_sql("fisher_z", "r_obs", "r_split", "(83 / CAST(8 AS DOUBLE))")), ("subject_id", "window_id", "seed")),
    "\nWZ AS (SELECT subject_id, seed, CAST(atanh(CASE WHEN rho_hat_t IS NOT NULL THEN least(0.9999, greatest(-0.9999, rho_hat_t)) END) AS DOUBLE) AS z FROM WE)",
    """
SW AS (SELECT subject_id, seed, tanh(quantile_cont(z, 0.5)) AS rho_sw, tanh(CASE WHEN count(z) >= 4 THEN quantile_cont(z, 0.025) ELSE quantile_cont(z, 0.5) - stddev_pop(z) END) AS sw_lo,
  tanh(CASE WHEN count(z) >= 4 THEN quantile_cont(z, 0.975) ELSE quantile_cont(z, 0.5) + stddev_pop(z) END) AS sw_hi FROM WZ GROUP BY 1, 2)""",
    """
HO AS (SELECT BP.subject_id, BP.seed, AB.s AS r_ab, BB.s AS r_bb, STR.s AS r_ab_strong, BP.rho_hat_t AS rho_bp, BP.ci_lower AS bp_lo, BP.ci_upper AS bp_hi, rho_sw, sw_lo, sw_hi
  FROM BP JOIN AB USING (subject_id) JOIN BB USING (subject_id) LEFT JOIN STR USING (subject_id) LEFT JOIN SW ON SW.subject_id = BP.subject_id AND SW.seed = BP.seed)""",
]
HELD_COLS = ("r_ab", "r_bb", "r_ab_strong", "rho_bp", "bp_lo", "bp_hi", "rho_sw", "sw_lo", "sw_hi")


def _held_out(spark, sf_dir):
    t = F.col("t")
    segs = {**segment_conditions(("short", "rest")), "b1": (t >= SHORT_ROWS) & (t < SHORT_ROWS + 33), "b2": t >= SHORT_ROWS + 33}
    edges = fc_edges(label_segments(lineitem_frames(spark, sf_dir), segs), ["subject_id", "seg"], constant=0.0)
    wide = side_by_side(edges, ["subject_id"], "seg", list(segs))
    ab = spearman(wide, "short", "rest", name="r_ab").drop("n_edges")
    bb = spearman(wide, "b1", "b2", name="r_bb").drop("n_edges")
    strong = spearman(wide.filter(F.abs("rest") >= 0.05), "short", "rest", name="r_s").select(
        "subject_id", F.when(F.col("n_edges") > 10, F.col("r_s")).alias("r_ab_strong")
    )
    short = short_frames(spark, sf_dir)
    ref = reference_edges(spark, sf_dir, fisher=False)
    bp = bootstrap_estimate(short, ref, SWEEP_CONFIG, SEEDS, K_FULL, "fisher_z").select(
        "subject_id", "seed", F.col("rho_hat_t").alias("rho_bp"), F.col("ci_lower").alias("bp_lo"), F.col("ci_upper").alias("bp_hi")
    )
    win = sliding(short, SHORT_ROWS, 8, 2).withColumn("t", F.col("t") - F.col("window_id") * 2)
    reps = replicate_scores(win, ref, 3, SEEDS, ["subject_id", "window_id"])
    per_window = summarise(reps, corrected_z(SWEEP_CONFIG, N_MONTHS / 8, "fisher_z"), ["subject_id", "window_id", "seed"])
    sw = window_estimates(per_window, ["subject_id", "seed"]).select(
        "subject_id", "seed", F.col("rho_hat_t").alias("rho_sw"), F.col("ci_lower").alias("sw_lo"), F.col("ci_upper").alias("sw_hi")
    )
    return bp.join(ab, "subject_id").join(bb, "subject_id").join(strong, "subject_id", "left").join(sw, ["subject_id", "seed"], "left")


@query("held_out", with_panel(*HELD_FULL) + "SELECT subject_id, seed, " + ", ".join(q6(c, c) for c in HELD_COLS) + " FROM HO")
def held_out(spark, sf_dir):
    return _held_out(spark, sf_dir).select("subject_id", "seed", *[r6(c) for c in HELD_COLS])


@query(
    "held_out_summary",
    with_panel(*HELD_FULL, "HS AS (SELECT subject_id, avg(r_ab) AS r_ab, avg(rho_bp) AS rho_bp FROM HO GROUP BY 1)")
    + f"""SELECT CAST(count(r_ab + rho_bp) AS BIGINT) AS n, {q6('avg(rho_bp - r_ab)', 'gain')}, {q6('regr_slope(rho_bp, r_ab)', 'slope')},
      {q6('regr_intercept(rho_bp, r_ab)', 'intercept')}, {q6('covar_pop(r_ab, rho_bp) / sqrt(var_pop(CASE WHEN rho_bp IS NOT NULL THEN r_ab END) * var_pop(CASE WHEN r_ab IS NOT NULL THEN rho_bp END))', 'r')} FROM HS""",
)
def held_out_summary(spark, sf_dir):
    per = _held_out(spark, sf_dir).groupBy("subject_id").agg(F.avg("r_ab").alias("r_ab"), F.avg("rho_bp").alias("rho_bp"))
    both = F.col("r_ab").isNotNull() & F.col("rho_bp").isNotNull()
    vx = F.var_pop(F.when(both, F.col("r_ab")))
    slope = F.covar_pop("r_ab", "rho_bp") / vx
    return per.agg(
        F.count(F.when(both, 1)).alias("n"), r6(F.avg(F.col("rho_bp") - F.col("r_ab")), "gain"), r6(slope, "slope"),
        r6(F.avg(F.when(both, F.col("rho_bp"))) - slope * F.avg(F.when(both, F.col("r_ab"))), "intercept"), r6(moment_corr("r_ab", "rho_bp"), "r"),
    )


GRID = [dict(reliability=r, obs_var=v) for r in (0.7, 0.9, 0.98) for v in (0.1, 0.2)] + [dict(prior_mean=m, prior_var=v) for m in (0.1, 0.4) for v in (0.02, 0.1)]
GRID_ROWS = ", ".join(
    f"({p.get('reliability', 0.98)}, {p.get('prior_mean', 0.25)}, {p.get('prior_var', 0.05)}, {p.get('obs_var', 0.15)})" for p in GRID
)


def _grid_z():
    w = "(prior_var / (prior_var + obs_var))"
    a, b = "greatest(reliability, 0.05)", f"(CASE WHEN r_split IS NOT NULL THEN greatest({w} * r_split + (1 - {w}) * prior_mean, 0.05) END)"
    return zclip(f"tanh(atanh({clip_sql('r_obs', -0.9999, 0.9999)}) - 0.5 * ln({a} * {b}) + 0.5 * ln({sb_sql(a, K)} * {sb_sql(b, K)}))")


GRID_SQL = REPS[:-1] + f""", PG AS (SELECT CAST(col0 AS DOUBLE) AS reliability, CAST(col1 AS DOUBLE) AS prior_mean, CAST(col2 AS DOUBLE) AS prior_var, CAST(col3 AS DOUBLE) AS obs_var FROM (VALUES {GRID_ROWS})),
GR AS (SELECT * FROM RP CROSS JOIN PG)""" + "," + interval_sql("GR", "GE", _grid_z(), ("subject_id", "seed", "reliability", "prior_mean", "prior_var", "obs_var")) + "\n"
PARAMS = ("reliability", "prior_mean", "prior_var", "obs_var")


@query(
    "sensitivity_grid",
    GRID_SQL
    + f"""SELECT reliability, prior_mean, prior_var, obs_var, {q6('avg(rho_hat_t)', 'mean_rho')}, {q6('stddev_pop(rho_hat_t) / avg(rho_hat_t)', 'cv')},
      {q6('max(rho_hat_t) - min(rho_hat_t)', 'rho_range')}, {q6('avg(CASE WHEN rho_hat_t >= 0.8 THEN 1.0 WHEN rho_hat_t IS NOT NULL THEN 0 END)', 'pass_rate')} FROM GE GROUP BY 1, 2, 3, 4""",
)
def sensitivity_grid(spark, sf_dir):
    reps = replicate_scores(short_frames(spark, sf_dir), reference_edges(spark, sf_dir), 5, SEEDS, fisher=True)
    out = grid_summary(parameter_grid_estimates(reps, GRID, K_FULL, CONFIG), PARAMS)
    return out.select(*PARAMS, *[r6(c) for c in ("mean_rho", "cv", "rho_range", "pass_rate")])


PI = "3.141592653589793"


def _noise_sql(sigma, seed, src, where):
    u = lambda s: f"(({hash_sql('subject_id', 'channel', 't', str(seed), chr(39) + s + chr(39))} + 0.5) / 4294967296)"
    return f"SELECT subject_id, channel, t, value + {sigma} * sqrt(-2 * ln({u('u')})) * cos(2 * {PI} * {u('v')}) AS value FROM {src} WHERE {where}"


def _degraded_ctes(name, short_sql):
    return [short_sql, SUFFIX, ledoit_wolf("REST", "REFE"), replicates("DSRC", "REFE", "RP", 3, (1,)),
            interval_sql("RP", "EST", zclip(correction_sql("fisher_z", "r_obs", "r_split", K)), ("subject_id", "seed"))]


DEG_OUT = f"""SELECT subject_id, seed, {q6('rho_hat_t', 'rho_hat_t')}, {q6('ci_lower', 'ci_lower')}, {q6('ci_upper', 'ci_upper')},
  coalesce(rho_hat_t > 0.5 AND ci_upper - ci_lower < 0.5, FALSE) AS passed FROM EST"""


def _degraded(short, ref):
    reps = replicate_scores(short, ref, 3, (1,))
    out = pass_interval(summarise(reps, corrected_z(SWEEP_CONFIG, K_FULL, "fisher_z"), ["subject_id", "seed"]))
    return out.select("subject_id", "seed", r6("rho_hat_t"), r6("ci_lower"), r6("ci_upper"), "passed")


@query("degradation_noise", with_panel(*_degraded_ctes("n", "DSRC AS (" + _noise_sql(2.0, 9, "S", "t < 16") + ")")) + DEG_OUT)
def degradation_noise(spark, sf_dir):
    return _degraded(add_noise(short_frames(spark, sf_dir), 2.0, 9), reference_edges(spark, sf_dir, fisher=False))


@query(
    "degradation_channels",
    with_panel("DSRC AS (SELECT * FROM S WHERE t < 16 AND channel < 6)", "REST AS (SELECT * FROM S WHERE t >= 16 AND channel < 6)", ledoit_wolf("REST", "REFE"),
               replicates("DSRC", "REFE", "RP", 3, (1,)), interval_sql("RP", "EST", zclip(correction_sql("fisher_z", "r_obs", "r_split", K)), ("subject_id", "seed"))) + DEG_OUT,
)
def degradation_channels(spark, sf_dir):
    marked = keep_channels(label_segments(lineitem_frames(spark, sf_dir), segment_conditions(("short", "rest"))), 6)
    ref = fc_edges(marked.filter("seg = 'rest'"), kind="ledoit_wolf")
    return _degraded(marked.filter("seg = 'short'").drop("seg"), ref)


OFFS = (0, 30, 60)
OFF = [
    f"OW AS (SELECT subject_id, CAST(o AS INTEGER) AS offset_sec, CAST(floor(o / tr) AS INTEGER) AS lo FROM attrs CROSS JOIN (SELECT unnest([{', '.join(map(str, OFFS))}]) AS o))",
    "OI AS (SELECT S.*, offset_sec FROM S JOIN OW ON OW.subject_id = S.subject_id AND t >= lo AND t < lo + 16)",
    "OO AS (SELECT S.*, offset_sec FROM S JOIN OW ON OW.subject_id = S.subject_id AND NOT (t >= lo AND t < lo + 16))",
    pearson("OI", "OR_", ("subject_id", "offset_sec")), ledoit_wolf("OI", "OL", ("subject_id", "offset_sec")), ledoit_wolf("OO", "OF_", ("subject_id", "offset_sec")),
    similarity("OR_", "OF_", "OA", ("subject_id", "offset_sec"), name="r_raw"), similarity("OL", "OF_", "OB", ("subject_id", "offset_sec"), name="r_lw"),
    "\nOS AS (SELECT subject_id, offset_sec, r_raw, r_lw, r_lw - r_raw AS delta_r FROM OA JOIN OB USING (subject_id, offset_sec))",
]


@query("offset_robustness", with_panel(*OFF) + f"SELECT subject_id, offset_sec, {q6('r_raw', 'r_raw')}, {q6('r_lw', 'r_lw')}, {q6('delta_r', 'delta_r')} FROM OS")
def offset_robustness(spark, sf_dir):
    out = offset_subjects(offset_pairs(timed_frames(spark, sf_dir), OFFS, SHORT_ROWS))
    return out.select("subject_id", "offset_sec", r6("r_raw"), r6("r_lw"), r6("delta_r"))


@query(
    "offset_summary",
    with_panel(*OFF)
    + f"""SELECT offset_sec, {q6('avg(r_raw)', 'r_raw_mean')}, {q6('avg(r_lw)', 'r_lw_mean')}, {q6('avg(delta_r)', 'delta_mean')}, {q6('stddev_pop(delta_r)', 'delta_sd')},
      CAST(count(*) FILTER (WHERE delta_r > 0) AS BIGINT) AS n_improved, {q6('avg(CASE WHEN delta_r > 0 THEN 100.0 WHEN delta_r IS NOT NULL THEN 0 END)', 'pct_improved')} FROM OS GROUP BY 1""",
)
def offset_summary_query(spark, sf_dir):
    out = offset_summary(offset_subjects(offset_pairs(timed_frames(spark, sf_dir), OFFS, SHORT_ROWS)))
    return out.select("offset_sec", r6("r_raw_mean"), r6("r_lw_mean"), r6("delta_mean"), r6("delta_sd"), "n_improved", r6("pct_improved"))


def zmed(src, name, z, back):
    f = "tanh" if back else ""
    return f"SELECT subject_id, seed, '{name}' AS lab, {f}(quantile_cont(CAST({z} AS DOUBLE), 0.5)) AS rho_hat_t FROM {src} GROUP BY 1, 2"


COR = lambda k, prior=(0.25, 0.05): correction_sql("fisher_z", "r_obs", "r_split", k, prior)
SINGLE = [
    "HF AS (SELECT *, CASE WHEN t < 8 THEN 1 ELSE 2 END AS half FROM SHORT)", ledoit_wolf("HF", "HE", ("subject_id", "half")), pearson("HF", "HP", ("subject_id", "half")),
    ledoit_wolf("SHORT", "SL"), pearson("SHORT", "SP"),
    f"""
HS AS (SELECT a.subject_id, {corr_expr('a.r', 'b.r')} AS h FROM HE a JOIN HE b ON a.subject_id = b.subject_id AND a.i = b.i AND a.j = b.j AND a.half = 1 AND b.half = 2 GROUP BY ALL),
HQ AS (SELECT a.subject_id, {corr_expr('a.r', 'b.r')} AS h FROM HP a JOIN HP b ON a.subject_id = b.subject_id AND a.i = b.i AND a.j = b.j AND a.half = 1 AND b.half = 2 GROUP BY ALL)""",
]
ABL = [
    SHORT, SUFFIX, ledoit_wolf("REST", "REFE"), replicates("SHORT", "REFE", "RP", 3, SEEDS), replicates("SHORT", "REFE", "RN", 3, SEEDS, kind="pearson"), *SINGLE,
    similarity("SL", "REFE", "SO", name="r_obs"),
    f"\nSG AS (SELECT SO.subject_id, r_obs, {clip_sql('h', 0.001, 0.999)} AS r_split FROM SO JOIN HS USING (subject_id))",
    "\nCN AS (" + " UNION ALL ".join([
        zmed("RP", "L_full", zclip(COR(K)), True), zmed("RP", "L_no_sb", zclip(COR("1.0")), True), zmed("RP", "L_no_prior", zclip(COR(K, None)), True),
        zmed("RP", "L_no_atten", zclip(f"CASE WHEN r_obs IS NOT NULL THEN {sb_sql('r_obs', K)} END"), True), zmed("RN", "L_no_lw", zclip(COR(K)), True),
        f"SELECT SG.subject_id, s.seed, 'L_no_boot' AS lab, tanh({zclip(COR(K))}) AS rho_hat_t FROM SG JOIN (SELECT DISTINCT subject_id, seed FROM RP) s USING (subject_id)",
    ]) + ")",
    "\nCD AS (SELECT subject_id, seed, lab AS condition, rho_hat_t, rho_hat_t - max(CASE WHEN lab = 'L_full' THEN rho_hat_t END) OVER (PARTITION BY subject_id, seed) AS delta FROM CN)",
]


def _halved(spark, sf_dir, kinds=("ledoit_wolf", "pearson")):
    """(subject_id, i, j, <kind>_short/_first/_second/_rest/_full columns) from one scan and one moment pass."""
    from reliaspan.operators.connectivity import pair_moments, shrunk_pairs

    t = F.col("t")
    segs = {**segment_conditions(), "first": t < SHORT_ROWS // 2, "second": (t >= SHORT_ROWS // 2) & (t < SHORT_ROWS)}
    frames = label_segments(lineitem_frames(spark, sf_dir), segs)
    pairs = shrunk_pairs(pair_moments(frames, ["subject_id", "seg"], norm=True), ["subject_id", "seg"]).filter("i < j")
    lw = F.coalesce(F.try_divide(F.col("c"), F.sqrt(F.col("vi") * F.col("vj"))), F.lit(0.0))
    cols = []
    for s in segs:
        cols += [F.max(F.when(F.col("seg") == s, lw)).alias(f"lw_{s}"), F.max(F.when(F.col("seg") == s, F.col("raw"))).alias(f"raw_{s}")]
    return pairs.groupBy("subject_id", "i", "j").agg(*cols)


def _sides(spark, sf_dir):
    """One row per subject: packed references, window similarities and half-window reliabilities."""
    from reliaspan.functions.reliability import clip

    packed = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("i", "j", v))), lambda e: e[v]).alias(f"ref_{v}")
    r = lambda a, b: moment_corr(a, b, strict=True)
    return materialise(_halved(spark, sf_dir).groupBy("subject_id").agg(
        packed("lw_rest"), packed("lw_full"), r("lw_short", "lw_rest").alias("lw_vs_rest"), r("raw_short", "lw_rest").alias("raw_vs_rest"),
        r("raw_short", "raw_full").alias("raw_vs_full"), r("lw_short", "lw_full").alias("lw_vs_full"),
        clip(r("raw_first", "raw_second"), 0.001, 0.999).alias("split_raw"), clip(r("lw_first", "lw_second"), 0.001, 0.999).alias("split_lw"),
    ))


def _reference(sides, name):
    return sides.select("subject_id", F.col(name).alias("ref"))


def _necessity(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    reps = replicate_scores(short_frames(spark, sf_dir), _reference(sides, "ref_lw_rest"), 3, SEEDS, kind=["ledoit_wolf", "pearson"])
    single = sides.select("subject_id", F.col("lw_vs_rest").alias("r_obs"), F.col("split_lw").alias("r_split"))
    return with_delta(component_necessity(reps, single, SEEDS, K_FULL, SWEEP_CONFIG), "condition", "L_full")


@query("component_necessity", with_panel(*ABL) + f"SELECT subject_id, seed, condition, {q6('rho_hat_t', 'rho_hat_t')}, {q6('delta', 'delta')} FROM CD")
def component_necessity_query(spark, sf_dir):
    return _necessity(spark, sf_dir).select("subject_id", "seed", "condition", r6("rho_hat_t"), r6("delta"))


@query(
    "component_summary",
    with_panel(*ABL, "\nCP AS (SELECT condition, subject_id, avg(rho_hat_t) AS rho, avg(delta) AS d FROM CD GROUP BY 1, 2)")
    + f"""SELECT condition, CAST(count(rho) AS BIGINT) AS n, {q6('avg(rho)', 'rho_mean')}, {q6('stddev_samp(rho)', 'rho_sd')}, {q6('avg(d)', 'delta_mean')}, {q6('stddev_samp(d)', 'delta_sd')} FROM CP GROUP BY 1""",
)
def component_summary(spark, sf_dir):
    out = condition_summary(_necessity(spark, sf_dir))
    return out.select("condition", "n", *[r6(c) for c in out.columns[2:]])


PROG = [
    SHORT, SUFFIX, ledoit_wolf("REST", "REFE"), replicates("SHORT", "REFE", "RP", 3, SEEDS), ledoit_wolf("SHORT", "SL"), pearson("SHORT", "SP"),
    similarity("SL", "REFE", "SO", name="r_lw"), similarity("SP", "REFE", "SR", name="r_raw"),
    "\nLVL AS (" + " UNION ALL ".join([
        zmed("RP", "L2", "r_obs", False), zmed("RP", "L3", COR(K, None), False), zmed("RP", "L4", COR(K), False), zmed("RP", "L5", zclip(COR(K)), True),
        "SELECT subject_id, s.seed, 'L0' AS lab, r_raw AS rho_hat_t FROM SR JOIN (SELECT DISTINCT subject_id, seed FROM RP) s USING (subject_id)",
        "SELECT subject_id, s.seed, 'L1' AS lab, r_lw AS rho_hat_t FROM SO JOIN (SELECT DISTINCT subject_id, seed FROM RP) s USING (subject_id)",
    ]) + ")",
]


def _levels(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    reps = replicate_scores(short_frames(spark, sf_dir), _reference(sides, "ref_lw_rest"), 3, SEEDS)
    base = sides.select("subject_id", F.col("raw_vs_rest").alias("r_raw"), F.col("lw_vs_rest").alias("r_lw"))
    return progressive_levels(reps, base, SEEDS, K_FULL, SWEEP_CONFIG)


@query("progressive_ablation", with_panel(*PROG) + f"SELECT subject_id, seed, lab AS level, {q6('rho_hat_t', 'rho_hat_t')} FROM LVL")
def progressive_ablation(spark, sf_dir):
    return _levels(spark, sf_dir).select("subject_id", "seed", "level", r6("rho_hat_t"))


@query(
    "progressive_summary",
    with_panel(*PROG, "\nPM AS (SELECT lab AS level, avg(rho_hat_t) AS m, stddev_pop(rho_hat_t) AS s FROM LVL GROUP BY 1)")
    + f"""SELECT level, {q6('m', 'mean_rho')}, {q6('s', 'sd_rho')}, {q6('m - lag(m) OVER (ORDER BY level)', 'from_previous')}, {q6('m - first_value(m) OVER (ORDER BY level)', 'from_raw')} FROM PM""",
)
def progressive_summary(spark, sf_dir):
    out = level_summary(_levels(spark, sf_dir))
    return out.select("level", r6("mean_rho"), r6("sd_rho"), r6("from_previous"), r6("from_raw"))


@query(
    "levels_by_k_group",
    with_panel(*PROG, "\nKG AS (SELECT subject_id, CASE WHEN subject_id % 3 = 0 THEN 'low' ELSE 'high' END AS k_group FROM subj)")
    + "SELECT k_group, " + ", ".join(q6(f"avg(CASE WHEN lab = '{lv}' THEN rho_hat_t END)", lv) for lv in ("L0", "L1", "L2", "L3", "L4", "L5"))
    + " FROM LVL JOIN KG USING (subject_id) GROUP BY 1",
)
def levels_by_k_group(spark, sf_dir):
    rows = _levels(spark, sf_dir)
    groups = rows.select("subject_id").distinct().withColumn("k_group", F.when(F.col("subject_id") % 3 == 0, "low").otherwise("high"))
    out = stratified_levels(rows, groups)
    return out.select("k_group", *[r6(c) for c in ("L0", "L1", "L2", "L3", "L4", "L5")])


@query(
    "levels_by_site",
    with_panel(*PROG, "\nSB AS (SELECT subject_id, avg(CASE WHEN lab = 'L0' THEN rho_hat_t END) AS raw, avg(CASE WHEN lab = 'L5' THEN rho_hat_t END) AS full_r FROM LVL GROUP BY 1)")
    + f"""SELECT site, CAST(count(*) AS BIGINT) AS n, {q6('avg(83 / floor(40 / tr))', 'k')}, {q6('avg(raw)', 'raw')}, {q6('avg(full_r)', '"full"')}, {q6('avg(full_r - raw)', 'delta')},
      avg(83 / floor(40 / tr)) >= 2 AS included FROM SB JOIN attrs USING (subject_id) GROUP BY 1""",
)
def levels_by_site(spark, sf_dir):
    rows = _levels(spark, sf_dir)
    sites = with_attributes(rows.select("subject_id").distinct()).select("subject_id", "site", (F.lit(float(N_MONTHS)) / F.floor(F.lit(40.0) / F.col("tr"))).alias("k"))
    out = site_table(rows, sites)
    return out.select("site", "n", r6("k"), r6("raw"), r6("full"), r6("delta"), "included")


SCL = lambda r, s: clip_sql(f"{r} * sqrt({sb_sql(s, K)})", -1, 1)
SCALED = [
    SHORT, ledoit_wolf("S", "REFE"), pearson("S", "REFP"), replicates("SHORT", "REFE", "RP", 3, SEEDS), *SINGLE,
    similarity("SL", "REFE", "SO", name="r_lw"), similarity("SP", "REFP", "SR", name="r_raw"),
    f"\nBS AS (SELECT subject_id, r_raw, r_lw, {clip_sql('HQ.h', 0.001, 0.999)} AS split_raw, {clip_sql('HS.h', 0.001, 0.999)} AS split_lw FROM SO JOIN SR USING (subject_id) JOIN HS USING (subject_id) JOIN HQ USING (subject_id))",
    "\nSLV AS (" + " UNION ALL ".join([
        zmed("RP", "L3", SCL("r_obs", "r_split"), False),
        zmed("RP", "L4", SCL("r_obs", clip_sql("0.25 * r_split + 0.75 * 0.25", 0.001, 0.999)), False),
        zmed("RP", "L5", clip_sql(COR(K), -1, 1), False),
        *[f"SELECT subject_id, s.seed, '{n}' AS lab, {e} AS rho_hat_t FROM BS JOIN (SELECT DISTINCT subject_id, seed FROM RP) s USING (subject_id)"
          for n, e in (("L0", clip_sql("r_raw", -1, 1)), ("L1", f"CASE WHEN split_raw IS NOT NULL THEN {SCL('r_raw', 'split_raw')} END"), ("L2", f"CASE WHEN split_lw IS NOT NULL THEN {SCL('r_lw', 'split_lw')} END"))],
    ]) + ")",
]


@query(
    "scaled_ablation",
    with_panel(*SCALED)
    + f"SELECT subject_id, seed, lab AS level, {q6('rho_hat_t', 'rho_hat_t')}, {q6('abs(rho_hat_t - r_lw)', 'mae')}, CASE WHEN rho_hat_t >= 0.8 THEN 1 ELSE 0 END AS passed FROM SLV JOIN BS USING (subject_id)",
)
def scaled_ablation(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    reps = replicate_scores(short_frames(spark, sf_dir), _reference(sides, "ref_lw_full"), 3, SEEDS)
    base = sides.select(
        "subject_id", F.col("raw_vs_full").alias("r_raw"), "split_raw", F.col("lw_vs_full").alias("r_lw"), "split_lw",
        F.col("lw_vs_full").alias("r_reference"),
    )
    out = scaled_levels(reps, base, SEEDS, K_FULL, SWEEP_CONFIG)
    return out.select("subject_id", "seed", "level", r6("rho_hat_t"), r6("mae"), "passed")


COHORT = with_panel(
    *REF, ledoit_wolf("SHORT", "SLE"), z_space("SLE", "SLZ"), similarity("SLZ", "REF", "RAW", name="r_fc_raw"), replicates("SHORT", "REF", "RP", 5, SEEDS, fisher=True),
    interval_sql("RP", "EST", zclip(correction_sql("fisher_z", "r_obs", "r_split", K)), ("subject_id", "seed")),
    """
PS AS (SELECT EST.subject_id, any_value(r_fc_raw) AS r_fc_raw, avg(rho_hat_t) AS rho_mean, stddev_pop(rho_hat_t) AS rho_std FROM EST JOIN RAW USING (subject_id) GROUP BY 1),
PA AS (SELECT PS.*, grp, site FROM PS JOIN attrs USING (subject_id))""",
)


def _per_subject(spark, sf_dir):
    """(subject_id, grp, site, r_fc_raw, rho_mean, rho_std): one scan feeds both sides."""
    wide = side_by_side(segment_edges(spark, sf_dir, "ledoit_wolf", ("short", "rest"), True), ["subject_id"], "seg", ("short", "rest"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "rest"))), lambda e: e["rest"])
    sides = materialise(wide.groupBy("subject_id").agg(moment_corr("short", "rest", strict=True).alias("r_fc_raw"), packed.alias("ref")))
    reps = replicate_scores(short_frames(spark, sf_dir), sides, 5, SEEDS, fisher=True)
    est = seed_summary(summarise(reps, corrected_z(CONFIG, K_FULL, "fisher_z"), ["subject_id", "seed"]))
    return with_attributes(est.join(sides.select("subject_id", "r_fc_raw"), "subject_id"))


@query(
    "cohort_summary",
    COHORT
    + f"""SELECT grp, CAST(count(*) AS BIGINT) AS n, {q6('avg(r_fc_raw)', 'raw_mean')}, {q6('stddev_pop(r_fc_raw)', 'raw_sd')}, {q6('avg(rho_mean)', 'rho_mean')},
      {q6('stddev_pop(rho_mean)', 'rho_sd')}, {q6('quantile_cont(CAST(rho_mean AS DOUBLE), 0.5)', 'rho_median')},
      {q6('avg(CASE WHEN rho_mean > r_fc_raw THEN 100.0 WHEN rho_mean IS NOT NULL AND r_fc_raw IS NOT NULL THEN 0 END)', 'pct_improved')} FROM PA GROUP BY GROUPING SETS ((grp), ())""",
)
def cohort_summary_query(spark, sf_dir):
    out = cohort_summary(_per_subject(spark, sf_dir).withColumnRenamed("rho_mean", "rho_hat_t"))
    return out.select("grp", "n", *[r6(c) for c in ("raw_mean", "raw_sd", "rho_mean", "rho_sd", "rho_median", "pct_improved")])


@query(
    "multi_seed_summary",
    COHORT
    + f"""SELECT grp, site, CAST(count(*) AS BIGINT) AS n, {q6('avg(rho_mean)', 'rho_mean')}, {q6('stddev_pop(rho_mean)', 'rho_sd')}, {q6('avg(rho_std)', 'seed_sd')},
      CAST(count(*) FILTER (WHERE rho_mean >= 0.999) AS BIGINT) AS n_ceiling FROM PA GROUP BY GROUPING SETS ((), (grp), (site))""",
)
def multi_seed_summary_query(spark, sf_dir):
    out = multi_seed_summary(_per_subject(spark, sf_dir))
    return out.select("grp", "site", "n", r6("rho_mean"), r6("rho_sd"), r6("seed_sd"), "n_ceiling")


@query(
    "method_comparison",
    METHODS_SQL[:-1]
    + "," + ",".join([ledoit_wolf("SHORT", "SLE"), z_space("SLE", "SLZ"), similarity("SLZ", "REF", "RAW", name="r_raw")])
    + f"""
      SELECT method, CAST(count(rho_hat_t) AS BIGINT) AS n, {q6('avg(rho_hat_t)', 'mean')}, {q6('stddev_pop(rho_hat_t)', 'sd')}, {q6('min(rho_hat_t)', 'min')}, {q6('max(rho_hat_t)', 'max')},
      {q6('quantile_cont(CAST(rho_hat_t AS DOUBLE), 0.5)', 'median')}, {q6('avg(CASE WHEN rho_hat_t >= 0.999 THEN 100.0 WHEN rho_hat_t IS NOT NULL THEN 0 END)', 'ceiling_pct')},
      {q6('avg(CASE WHEN rho_hat_t > 0.99 THEN 100.0 WHEN rho_hat_t IS NOT NULL THEN 0 END)', 'above_99_pct')}, {q6('avg(rho_hat_t - r_raw)', 'improvement')}
      FROM EST JOIN RAW USING (subject_id) GROUP BY 1""",
)
def method_comparison_query(spark, sf_dir):
    wide = side_by_side(segment_edges(spark, sf_dir, "ledoit_wolf", ("short", "rest"), True), ["subject_id"], "seg", ("short", "rest"))
    raw = wide.groupBy("subject_id").agg(moment_corr("short", "rest", strict=True).alias("r_raw"))
    out = method_comparison(method_rows(spark, sf_dir).join(raw, "subject_id"))
    return out.select("method", "n", *[r6(c) for c in ("mean", "sd", "min", "max", "median", "ceiling_pct", "above_99_pct", "improvement")])


@query(
    "qc_metrics",
    with_panel(
        ledoit_wolf("S", "E"),
        """
QS AS (SELECT subject_id, channel, stddev_pop(value) AS sd FROM S GROUP BY 1, 2),
QA AS (SELECT subject_id, sum(CASE WHEN sd > 0 THEN 1 ELSE 0 END) AS nz, avg(sd) AS ms FROM QS GROUP BY 1)""",
    )
    + f"""SELECT subject_id, {q6('avg(r)', 'fc_mean')}, {q6('stddev_pop(r)', 'fc_sd')}, {q6('quantile_cont(CAST(r AS DOUBLE), 0.5)', 'fc_median')}, CAST(any_value(nz) AS BIGINT) AS n_nonzero,
      {q6('any_value(ms)', 'mean_sd')} FROM E JOIN QA USING (subject_id) GROUP BY 1""",
)
def qc_metrics(spark, sf_dir):
    edges = fc_edges(lineitem_frames(spark, sf_dir), kind="ledoit_wolf")
    out = quality_metrics(edges, channel_spread(lineitem_samples(spark, sf_dir)))
    return out.select("subject_id", r6("fc_mean"), r6("fc_sd"), r6("fc_median"), "n_nonzero", r6("mean_sd"))


CHARS = [
    SHORT,
    """
CL AS (SELECT *, lag(value) OVER (PARTITION BY subject_id, channel ORDER BY t) AS p FROM SHORT),
CR AS (SELECT subject_id, channel, var_pop(value) AS v, covar_pop(p, value) / nullif(sqrt(var_pop(p) * var_pop(CASE WHEN p IS NOT NULL THEN value END)), 0) AS ar FROM CL GROUP BY 1, 2),
CA AS (SELECT subject_id, coalesce(avg(ar), 0) AS mean_ar1, sum(CASE WHEN v < 1e-6 THEN 1 ELSE 0 END) AS n_low_var FROM CR GROUP BY 1),
CT AS (SELECT subject_id, avg(v) AS temporal_var FROM (SELECT subject_id, t, var_pop(value) AS v FROM SHORT GROUP BY 1, 2) GROUP BY 1),
CH AS (SELECT * FROM CA JOIN CT USING (subject_id))""",
]


@query("subject_characteristics", with_panel(*CHARS) + f"SELECT subject_id, {q6('mean_ar1', 'mean_ar1')}, CAST(n_low_var AS BIGINT) AS n_low_var, {q6('temporal_var', 'temporal_var', 9)} FROM CH")
def subject_characteristics_query(spark, sf_dir):
    out = subject_characteristics(frames_to_samples(short_frames(spark, sf_dir)))
    return out.select("subject_id", r6("mean_ar1"), "n_low_var", r6("temporal_var", digits=9))


@query(
    "pass_fail_profile",
    COHORT[:-1] + "," + CHARS[1]
    + f""" SELECT coalesce(rho_mean >= 0.3, FALSE) AS passed, CAST(count(*) AS BIGINT) AS n, {q6('avg(mean_ar1)', 'mean_ar1')}, {q6('avg(n_low_var)', 'n_low_var')}, {q6('avg(temporal_var)', 'temporal_var')}
      FROM CH JOIN PA USING (subject_id) GROUP BY 1""",
)
def pass_fail_profile_query(spark, sf_dir):
    chars = subject_characteristics(frames_to_samples(short_frames(spark, sf_dir))).join(_per_subject(spark, sf_dir).select("subject_id", "rho_mean"), "subject_id")
    out = pass_fail_profile(chars, ["mean_ar1", "n_low_var", "temporal_var"], "rho_mean", 0.3)
    return out.select("passed", "n", r6("mean_ar1"), r6("n_low_var"), r6("temporal_var"))


def _ridge(spark, sf_dir):
    from reliaspan.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    edges = segment_edges(spark, sf_dir, "pearson", ("short", "full"), constant=0.0)
    wide = side_by_side(edges, ["subject_id"], "seg", ("short", "full")).withColumnRenamed("full", "long").checkpoint()
    return held_out_ridge(wide, 1.0)


@query("held_out_ridge")
def held_out_ridge_query(spark, sf_dir):
    return _ridge(spark, sf_dir).select("subject_id", "i", "j", r6("predicted"))


@query("held_out_ridge_r2")
def held_out_ridge_r2(spark, sf_dir):
    return prediction_r2(_ridge(spark, sf_dir)).select("subject_id", r6("r2"))


REFERENCE_EXPERIMENTS = ("E0", "E1_self", "E1_teacher", "E2", "E3")


@query("reference_experiments")
def reference_experiments(spark, sf_dir):
    """E0: the rest of the recording; E1: the replicate mean; E2: the held-out prediction; E3: their blend.

    Subjects without a prediction fall back to the reference one step simpler.
    """
    short = short_frames(spark, sf_dir)
    teacher = reference_edges(spark, sf_dir, fisher=False)
    ensemble = average_edges(replicate_edges(short, block_lengths(short), 3, (101,), kind="ledoit_wolf"))
    predicted = _ridge(spark, sf_dir).select("subject_id", "i", "j", F.col("predicted").alias("r"))
    base = teacher.join(predicted.withColumnRenamed("r", "p"), ["subject_id", "i", "j"], "left").join(ensemble.withColumnRenamed("r", "e"), ["subject_id", "i", "j"])
    refs = base.select("subject_id", "i", "j", F.explode(F.array(
        F.struct(F.lit("E0").alias("experiment"), F.col("r").alias("r"), F.lit(0).alias("o")),
        F.struct(F.lit("E1_self").alias("experiment"), F.col("e").alias("r"), F.lit(1).alias("o")),
        F.struct(F.lit("E1_teacher").alias("experiment"), F.col("r").alias("r"), F.lit(2).alias("o")),
        F.struct(F.lit("E2").alias("experiment"), F.coalesce("p", "r").alias("r"), F.lit(3).alias("o")),
        F.struct(F.lit("E3").alias("experiment"), F.coalesce((F.col("p") + F.col("e")) / 2, F.col("e")).alias("r"), F.lit(4).alias("o")),
    )).alias("x")).select("subject_id", "i", "j", "x.experiment", "x.r")
    runs = short.withColumn("experiment", F.explode(F.array(*[F.lit(e) for e in REFERENCE_EXPERIMENTS])))
    est = bootstrap_estimate(runs, refs, SWEEP_CONFIG, SEEDS, K_FULL, "fisher_z", ["subject_id", "experiment"])
    return est.select("subject_id", "experiment", "seed", r6("rho_hat_t"), r6("ci_lower"), r6("ci_upper"))


@query(
    "ensemble_reference_similarity",
    with_panel(
        SHORT, SUFFIX, ledoit_wolf("REST", "REFE"),
        *replicate_edges_sql("ledoit_wolf")[1:],
        "\nEN AS (SELECT subject_id, i, j, avg(r) AS r FROM RE GROUP BY 1, 2, 3)", similarity("EN", "REFE", "ES", name="r_fc"),
        f"\nBL2 AS (SELECT EN.subject_id, EN.i, EN.j, 0.5 * EN.r + 0.5 * REFE.r AS r FROM EN JOIN REFE ON EN.subject_id = REFE.subject_id AND EN.i = REFE.i AND EN.j = REFE.j)",
        similarity("BL2", "REFE", "EB", name="r_blend"),
    )
    + f"SELECT subject_id, {q6('r_fc', 'r_fc')}, {q6('r_blend', 'r_blend')} FROM ES JOIN EB USING (subject_id)",
)
def ensemble_reference_similarity(spark, sf_dir):
    short = short_frames(spark, sf_dir)
    teacher = reference_edges(spark, sf_dir, fisher=False)
    ensemble = average_edges(replicate_edges(short, block_lengths(short), 5, (1,), kind="ledoit_wolf"))
    a = edge_similarity(ensemble, teacher)
    b = edge_similarity(combine_edges(ensemble, teacher, 0.5), teacher, name="r_blend")
    return a.join(b, "subject_id").select("subject_id", r6("r_fc"), r6("r_blend"))


WINDOW_LENGTHS = (24, 40)
STRONG = [
    pearson("S", "FR", constant="0"),
    f"""
SW0 AS (SELECT subject_id, CAST(s AS INTEGER) AS seed, CAST(l AS INTEGER) AS length, {hash_sql('subject_id', 's', 'l', "'window'")} % (83 - l + 1) AS st
  FROM subj CROSS JOIN (SELECT unnest([1, 2]) AS s) CROSS JOIN (SELECT unnest([24, 40]) AS l)),
SW1 AS (SELECT S.*, seed, length FROM S JOIN SW0 w ON w.subject_id = S.subject_id AND t >= st AND t < st + length)""",
    pearson("SW1", "FW", ("subject_id", "seed", "length"), constant="0"),
    f"""
SR0 AS (SELECT w.subject_id, seed, length, w.r AS a, f.r AS b FROM FW w JOIN FR f ON f.subject_id = w.subject_id AND f.i = w.i AND f.j = w.j WHERE abs(f.r) > 0.05),
SR1 AS (SELECT *, rank() OVER (PARTITION BY subject_id, seed, length ORDER BY a) + (count(*) OVER (PARTITION BY subject_id, seed, length, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY subject_id, seed, length ORDER BY b) + (count(*) OVER (PARTITION BY subject_id, seed, length, b) - 1) / 2.0 AS rb FROM SR0),
SR AS (SELECT subject_id, seed, length, {corr_expr('ra', 'rb')} AS r_strong FROM SR1 GROUP BY 1, 2, 3 HAVING count(*) >= 10)""",
]


@query(
    "strong_edge_sweep",
    with_panel(*STRONG) + f"SELECT length, CAST(count(r_strong) AS BIGINT) AS n, {q6('avg(r_strong)', 'r_strong_mean')}, {q6('stddev_pop(r_strong)', 'r_strong_sd')} FROM SR GROUP BY 1",
)
def strong_edge_sweep(spark, sf_dir):
    from reliaspan.plans.sweeps import strong_edge_similarity

    frames = lineitem_frames(spark, sf_dir).withColumn("n_rows", F.lit(N_MONTHS))
    r = strong_edge_similarity(frames, WINDOW_LENGTHS, SEEDS, 0.05, 10)
    return r.groupBy("length").agg(F.count("r_strong").alias("n"), r6(F.avg("r_strong"), "r_strong_mean"), r6(F.stddev_pop("r_strong"), "r_strong_sd"))


@query(
    "scheme_comparison",
    with_panel(
        "SCH AS (SELECT *, 'fine' AS scheme FROM S UNION ALL SELECT *, 'coarse' FROM S WHERE channel < 6)", "SCS AS (SELECT * FROM SCH WHERE t < 16)",
        pearson("SCS", "CA1", ("subject_id", "scheme"), constant="0"), pearson("SCH", "CB1", ("subject_id", "scheme"), constant="0"),
        similarity("CA1", "CB1", "CR1", ("subject_id", "scheme"), name="r"),
    )
    + f"SELECT scheme, CAST(count(r) AS BIGINT) AS n, {q6('avg(r)', 'r_mean')}, {q6('stddev_pop(r)', 'r_sd')} FROM CR1 GROUP BY 1",
)
def scheme_comparison_query(spark, sf_dir):
    from reliaspan.plans.sweeps import scheme_comparison

    out = scheme_comparison(lineitem_frames(spark, sf_dir), {"fine": N_CHANNELS, "coarse": 6}, SHORT_ROWS)
    return out.select("scheme", "n", r6("r_mean"), r6("r_sd"))
