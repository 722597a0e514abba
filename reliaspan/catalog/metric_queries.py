"""Agreement, stratification, contrast and test queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reliaspan.catalog.connectivity_queries import TRIPLET, TRIPLET_ROWS, triplet
from reliaspan.catalog.fixtures import segment_pairs, with_attributes
from reliaspan.catalog.registry import q6, query, r6
from reliaspan.catalog.sqlparts import SHORT, corr_expr, hash_sql, pearson, with_panel
from reliaspan.operators.connectivity import fc_edges, moment_corr
from reliaspan.operators.permutations import permuted_codes, permuted_sums
from reliaspan.operators.similarity import (
    adjacent_window_similarity, condition_numbers, edge_agreement, edge_quartiles, error_metrics, fingerprint_ranks, fingerprint_summary,
    pack_vectors, spearman, tertile_correlation, window_correlation, window_icc,
)
from reliaspan.operators.slices import tumbling
from reliaspan.operators.stats import (
    adjust_p, assign_tertiles, bonferroni, cohens_d, crossover, dickey_fuller, difference_stationarity, effect_summary, equivalent_duration, friedman,
    improvement_counts, kernel_density, marginal_gain, median_subject, monotone, paired_t, permutation_p, quartile_summary,
    regression_line, representative_subject, run_summary,
)
from reliaspan.session import materialise
from reliaspan.sources.panels import lineitem_frames, read_table

PAIR = [SHORT, pearson("SHORT", "A", constant="0"), pearson("S", "B", constant="0"), """
P AS (SELECT A.subject_id, A.i, A.j, A.r AS short, B.r AS full_r FROM A JOIN B ON A.subject_id = B.subject_id AND A.i = B.i AND A.j = B.j)"""]


def pair(spark, sf_dir):
    return segment_pairs(spark, sf_dir, constant=0.0)


RANKED = """
RK AS (SELECT *, rank() OVER (PARTITION BY subject_id ORDER BY short) + (count(*) OVER (PARTITION BY subject_id, short) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY subject_id ORDER BY full_r) + (count(*) OVER (PARTITION BY subject_id, full_r) - 1) / 2.0 AS rb FROM P)"""


@query("spearman", with_panel(*PAIR, RANKED) + f"SELECT subject_id, {q6(corr_expr('ra', 'rb'), 'spearman')}, CAST(count(*) AS BIGINT) AS n_edges FROM RK GROUP BY 1")
def spearman_query(spark, sf_dir):
    return spearman(pair(spark, sf_dir), "short", "full").select("subject_id", r6("spearman"), "n_edges")


@query(
    "error_metrics",
    with_panel(*PAIR)
    + f"""SELECT subject_id, {q6(corr_expr('short', 'full_r'), 'rho')}, {q6('avg(abs(short - full_r))', 'mae')},
      {q6('sqrt(2 * sum((short - full_r) * (short - full_r)))', 'frobenius')} FROM P GROUP BY 1""",
)
def error_metrics_query(spark, sf_dir):
    m = error_metrics(pair(spark, sf_dir), "full", "short")
    return m.select("subject_id", r6("rho"), r6("mae"), r6("frobenius"))


@query("condition_number")
def condition_number(spark, sf_dir):
    edges = fc_edges(lineitem_frames(spark, sf_dir), kind="ledoit_wolf")
    return condition_numbers(edges).select("subject_id", r6("condition_number"))


@query(
    "edge_agreement",
    with_panel(*PAIR)
    + f"""SELECT subject_id, {q6('least(1, greatest(-1, (b - w) / (b + w)))', 'edge_icc')} FROM (SELECT subject_id,
      count(*) * (pow(avg(short) - (avg(short) + avg(full_r)) / 2, 2) + pow(avg(full_r) - (avg(short) + avg(full_r)) / 2, 2)) AS b,
      sum(pow(short - full_r, 2)) / 2 / count(*) AS w FROM P GROUP BY 1)""",
)
def edge_agreement_query(spark, sf_dir):
    return edge_agreement(pair(spark, sf_dir), "short", "full").select("subject_id", r6("edge_icc"))


def windows(spark, sf_dir, width=20, count=4):
    return fc_edges(tumbling(lineitem_frames(spark, sf_dir), width, count), ["subject_id", "window_id"], constant=0.0)


def windows_sql(width=20, count=4):
    return [f"WN AS (SELECT *, CAST(floor(t / {width}) AS INTEGER) AS window_id FROM S WHERE t < {width * count})",
            pearson("WN", "E", ("subject_id", "window_id"), constant="0")]


@query(
    "window_icc",
    with_panel(
        *windows_sql(),
        """
G AS (SELECT subject_id, avg(r) AS g FROM E GROUP BY 1),
M AS (SELECT subject_id, window_id, avg(r) AS m, count(*) AS e FROM E GROUP BY 1, 2),
B AS (SELECT M.subject_id, count(*) AS k, max(e) AS e, count(*) * sum(pow(m - g, 2)) AS ssb FROM M JOIN G USING (subject_id) GROUP BY 1),
W AS (SELECT E.subject_id, sum(pow(r - m, 2)) AS ssw FROM E JOIN M ON E.subject_id = M.subject_id AND E.window_id = M.window_id GROUP BY 1),
V AS (SELECT B.subject_id, k, ssb / (k - 1) AS msb, ssw / (k * (e - 1)) AS msw FROM B JOIN W USING (subject_id))""",
    )
    + f"SELECT subject_id, CAST(k AS BIGINT) AS n_windows, {q6('least(1, greatest(-1, (msb - msw) / (msb + (k - 1) * msw)))', 'icc')} FROM V",
)
def window_icc_query(spark, sf_dir):
    return window_icc(windows(spark, sf_dir)).select("subject_id", "n_windows", r6("icc"))


@query(
    "window_correlation",
    with_panel(
        *windows_sql(),
        f"""
C AS (SELECT a.subject_id, a.window_id AS wa, b.window_id AS wb, {corr_expr('a.r', 'b.r')} AS c FROM E a JOIN E b
  ON a.subject_id = b.subject_id AND a.i = b.i AND a.j = b.j AND a.window_id < b.window_id GROUP BY ALL)""",
    )
    + f"SELECT subject_id, {q6('avg(c)', 'mean_window_r')} FROM C GROUP BY 1",
)
def window_correlation_query(spark, sf_dir):
    return window_correlation(windows(spark, sf_dir)).select("subject_id", r6("mean_window_r"))


@query(
    "adjacent_window_r",
    with_panel(
        *windows_sql(),
        f"""
C AS (SELECT a.subject_id, a.window_id, {corr_expr('a.r', 'b.r')} AS c FROM E a JOIN E b
  ON a.subject_id = b.subject_id AND a.i = b.i AND a.j = b.j AND a.window_id = b.window_id + 1 GROUP BY ALL)""",
    )
    + f"SELECT subject_id, window_id, {q6('c', 'r_prev')} FROM C",
)
def adjacent_window_r(spark, sf_dir):
    return adjacent_window_similarity(windows(spark, sf_dir)).select("subject_id", "window_id", r6("r_prev"))


DIFFS = """
D1 AS (SELECT *, r - lag(r) OVER w AS d, lag(r) OVER w AS x FROM E WINDOW w AS (PARTITION BY subject_id, i, j ORDER BY window_id)),
D2 AS (SELECT *, lag(d) OVER (PARTITION BY subject_id, i, j ORDER BY window_id) AS dp FROM D1),
ST AS (SELECT subject_id, i, j, count(*) AS n, var_samp(d) AS vd,
  covar_pop(dp, d) / nullif(sqrt(var_pop(dp) * var_pop(CASE WHEN dp IS NOT NULL THEN d END)), 0) AS acf FROM D2 GROUP BY 1, 2, 3),
PV AS (SELECT *, CASE WHEN n < 3 THEN 1 WHEN vd < 1e-10 THEN 0.01 ELSE least(0.99, greatest(0.01, (1 - least(0.999, greatest(-0.999, acf))) / 2)) END AS p FROM ST)"""


@query("stationarity_lag1", with_panel(*windows_sql(10, 8), DIFFS) + f"SELECT subject_id, i, j, {q6('p', 'p')} FROM PV")
def stationarity_lag1(spark, sf_dir):
    return difference_stationarity(windows(spark, sf_dir, 10, 8)).select("subject_id", "i", "j", r6("p"))


@query(
    "stationarity_rate",
    with_panel(*windows_sql(10, 8), DIFFS)
    + f"SELECT subject_id, CAST(count(*) AS BIGINT) AS n_edges, {q6('avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0 END)', 'rejection_rate')} FROM PV GROUP BY 1",
)
def stationarity_rate(spark, sf_dir):
    p = difference_stationarity(windows(spark, sf_dir, 10, 8))
    return p.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_edges"), r6(F.avg(F.when(F.col("p") < 0.05, 1.0).otherwise(0.0)), "rejection_rate")
    )


@query(
    "dickey_fuller_t",
    with_panel(*windows_sql(10, 8), DIFFS)
    + f"""SELECT subject_id, i, j, {q6('g / nullif(sqrt(greatest(rss, 0) / (n - 2) / sxx), 0)', 'df_t', 5)} FROM (
      SELECT subject_id, i, j, count(*) AS n, regr_slope(d, x) AS g, regr_sxx(d, x) AS sxx, regr_syy(d, x) - regr_slope(d, x) * regr_sxy(d, x) AS rss
      FROM D1 WHERE x IS NOT NULL GROUP BY 1, 2, 3)""",
)
def dickey_fuller_t(spark, sf_dir):
    return dickey_fuller(windows(spark, sf_dir, 10, 8)).select("subject_id", "i", "j", r6("df_t", digits=5))


@query(
    "reliability_tertile_r",
    with_panel(
        *PAIR,
        """
Q AS (SELECT subject_id, quantile_cont(CAST(abs(full_r) AS DOUBLE), 0.333) AS c0, quantile_cont(CAST(abs(full_r) AS DOUBLE), 0.667) AS c1 FROM P GROUP BY 1),
L AS (SELECT P.*, CASE WHEN abs(full_r) < c0 THEN 't1_low' WHEN abs(full_r) < c1 THEN 't2_mid' ELSE 't3_high' END AS tertile FROM P JOIN Q USING (subject_id))""",
    )
    + f"SELECT subject_id, tertile, CAST(count(*) AS BIGINT) AS n_edges, {q6('CASE WHEN count(*) > 2 THEN ' + corr_expr('short', 'full_r') + ' END', 'r')} FROM L GROUP BY 1, 2",
)
def reliability_tertile_r(spark, sf_dir):
    rows = pair(spark, sf_dir).withColumn("w", F.abs("full"))
    return tertile_correlation(rows, "short", "full", "w").select("subject_id", "tertile", "n_edges", r6("r"))


QUART = """
QC AS (SELECT subject_id, quantile_cont(CAST(abs(full_r) AS DOUBLE), 0.25) AS c1, quantile_cont(CAST(abs(full_r) AS DOUBLE), 0.5) AS c2,
  quantile_cont(CAST(abs(full_r) AS DOUBLE), 0.75) AS c3 FROM P GROUP BY 1),
QL AS (SELECT P.*, CASE WHEN abs(full_r) < c1 THEN 1 WHEN abs(full_r) < c2 THEN 2 WHEN abs(full_r) < c3 THEN 3 ELSE 4 END AS quartile FROM P JOIN QC USING (subject_id)),
QR AS (SELECT *, rank() OVER (PARTITION BY subject_id, quartile ORDER BY short) + (count(*) OVER (PARTITION BY subject_id, quartile, short) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY subject_id, quartile ORDER BY full_r) + (count(*) OVER (PARTITION BY subject_id, quartile, full_r) - 1) / 2.0 AS rb FROM QL),
QS AS (SELECT subject_id, quartile, """ + corr_expr("ra", "rb") + """ AS s FROM QR GROUP BY 1, 2 HAVING count(*) >= 10)"""


@query(
    "quartile_stratification",
    with_panel(*PAIR, QUART) + f"SELECT quartile, CAST(count(s) AS BIGINT) AS n, {q6('avg(s)', 'mean_r')}, {q6('stddev_pop(s)', 'sd_r')} FROM QS GROUP BY 1",
)
def quartile_stratification(spark, sf_dir):
    rows = edge_quartiles(pair(spark, sf_dir), "full")
    per = spearman(rows, "short", "full", ["subject_id", "quartile"]).filter("n_edges >= 10")
    return per.groupBy("quartile").agg(F.count("spearman").alias("n"), r6(F.avg("spearman"), "mean_r"), r6(F.stddev_pop("spearman"), "sd_r"))


THRESHOLDS = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3]


@query(
    "threshold_sweep",
    with_panel(
        *PAIR,
        f"""
TH AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS threshold),
TP AS (SELECT P.*, CAST(threshold AS DOUBLE) AS threshold FROM P JOIN TH ON abs(full_r) > threshold),
TR AS (SELECT *, rank() OVER (PARTITION BY subject_id, threshold ORDER BY short) + (count(*) OVER (PARTITION BY subject_id, threshold, short) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY subject_id, threshold ORDER BY full_r) + (count(*) OVER (PARTITION BY subject_id, threshold, full_r) - 1) / 2.0 AS rb FROM TP),
TS AS (SELECT subject_id, threshold, {corr_expr('ra', 'rb')} AS s, count(*) AS n FROM TR GROUP BY 1, 2 HAVING count(*) >= 10)""",
    )
    + f"SELECT threshold, CAST(count(s) AS BIGINT) AS n, {q6('avg(s)', 'mean_r')}, {q6('avg(100.0 * n / 66)', 'kept_pct')} FROM TS GROUP BY 1",
)
def threshold_sweep(spark, sf_dir):
    rows = pair(spark, sf_dir)
    hits = F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: F.abs("full") > t)
    kept = rows.withColumn("threshold", F.explode(hits))
    per = spearman(kept, "short", "full", ["subject_id", "threshold"]).filter("n_edges >= 10")
    return per.groupBy("threshold").agg(
        F.count("spearman").alias("n"), r6(F.avg("spearman"), "mean_r"), r6(F.avg(F.col("n_edges") * 100.0 / 66), "kept_pct")
    )


DMAP = [*TRIPLET, TRIPLET_ROWS, """
LONG AS (SELECT subject_id, i, j, 'raw' AS fc_type, raw_short AS v FROM T3 UNION ALL SELECT subject_id, i, j, 'lw', lw_short FROM T3
  UNION ALL SELECT subject_id, i, j, 'ref', reference FROM T3),
DG AS (SELECT fc_type, i, j, count(v) FILTER (WHERE grp = 1) AS n1, count(v) FILTER (WHERE grp = 0) AS n2, avg(v) FILTER (WHERE grp = 1) AS m1,
  avg(v) FILTER (WHERE grp = 0) AS m2, var_samp(v) FILTER (WHERE grp = 1) AS v1, var_samp(v) FILTER (WHERE grp = 0) AS v2
  FROM LONG JOIN attrs USING (subject_id) GROUP BY 1, 2, 3),
DM AS (SELECT fc_type, i, j, (m1 - m2) / greatest(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 1e-10) AS d FROM DG WHERE n1 >= 5 AND n2 >= 5)"""]


def d_maps(spark, sf_dir, by=()):
    rows = with_attributes(triplet(spark, sf_dir))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("fc_type"), F.col(c).alias("v")) for n, c in (("raw", "raw_short"), ("lw", "lw_short"), ("ref", "reference"))]))
    long = rows.withColumn("_e", kinds).select("subject_id", "i", "j", "grp", "site", "_e.fc_type", "_e.v", *by)
    return cohens_d(long, "grp", 1, 0, "v", ["i", "j"], ["fc_type", *by])


@query("cohens_d_map", with_panel(*DMAP) + f"SELECT fc_type, i, j, {q6('d', 'd')} FROM DM")
def cohens_d_map(spark, sf_dir):
    return d_maps(spark, sf_dir).select("fc_type", "i", "j", r6("d"))


@query(
    "effect_size_summary",
    with_panel(*DMAP)
    + f"""SELECT fc_type, {q6('avg(abs(d))', 'd_mean')}, {q6('max(abs(d))', 'd_max')}, CAST(count(*) FILTER (WHERE abs(d) > 0.2) AS BIGINT) AS n_small,
      CAST(count(*) FILTER (WHERE abs(d) > 0.5) AS BIGINT) AS n_medium FROM DM GROUP BY 1""",
)
def effect_size_summary(spark, sf_dir):
    return effect_summary(d_maps(spark, sf_dir), ["fc_type"]).select("fc_type", r6("d_mean"), r6("d_max"), "n_small", "n_medium")


@query(
    "effect_pattern_correlation",
    with_panel(*DMAP)
    + f"""SELECT a.fc_type, {q6(corr_expr('a.d', 'b.d'), 'r', 4)} FROM DM a JOIN DM b ON a.i = b.i AND a.j = b.j AND b.fc_type = 'ref' AND a.fc_type <> 'ref' GROUP BY 1""",
)
def effect_pattern_correlation(spark, sf_dir):
    d = d_maps(spark, sf_dir)
    wide = d.groupBy("i", "j").agg(*[F.max(F.when(F.col("fc_type") == t, F.col("d"))).alias(t) for t in ("raw", "lw", "ref")])
    return wide.agg(moment_corr("raw", "ref").alias("raw"), moment_corr("lw", "ref").alias("lw")).select(
        F.explode(F.array(F.struct(F.lit("raw").alias("fc_type"), F.col("raw").alias("r")), F.struct(F.lit("lw").alias("fc_type"), F.col("lw").alias("r")))).alias("e")
    ).select("e.fc_type", r6(F.col("e.r"), "r", 4))


SIMS = with_panel(*PAIR, f"""
SIM AS (SELECT subject_id, {corr_expr('short', 'full_r')} AS r_fc, avg(abs(short - full_r)) AS mae FROM P GROUP BY 1),
TC AS (SELECT quantile_cont(r_fc, 0.3333) AS q0, quantile_cont(r_fc, 0.6667) AS q1 FROM SIM),
TT AS (SELECT SIM.*, CASE WHEN r_fc <= q0 THEN 't1_low' WHEN r_fc <= q1 THEN 't2_mid' ELSE 't3_high' END AS tertile FROM SIM, TC)""")


def sims(spark, sf_dir):
    return pair(spark, sf_dir).groupBy("subject_id").agg(
        moment_corr("short", "full", strict=True).alias("r_fc"), F.avg(F.abs(F.col("short") - F.col("full"))).alias("mae")
    )


@query("tertiles", SIMS + f"SELECT subject_id, {q6('r_fc', 'r_fc')}, tertile FROM TT")
def tertiles(spark, sf_dir):
    return assign_tertiles(sims(spark, sf_dir), "r_fc").select("subject_id", r6("r_fc"), "tertile")


@query(
    "dose_response",
    SIMS[:-1]
    + f""", AG AS (SELECT tertile, count(*) AS n, avg(r_fc) AS m, stddev_pop(r_fc) AS s, avg(mae) AS e FROM TT GROUP BY 1 HAVING count(*) >= 10)
      SELECT tertile, CAST(n AS BIGINT) AS n, {q6('m', 'mean_r')}, {q6('s', 'sd_r')}, {q6('e', 'mean_mae')},
      (SELECT bool_and(nx > m) FROM (SELECT m, lead(m) OVER (ORDER BY tertile) AS nx FROM AG) WHERE nx IS NOT NULL) AS monotone FROM AG""",
)
def dose_response(spark, sf_dir):
    rows = assign_tertiles(sims(spark, sf_dir), "r_fc")
    per = rows.groupBy("tertile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r_fc").alias("m"), F.stddev_pop("r_fc").alias("s"), F.avg("mae").alias("e")
    ).filter("n >= 10").withColumn("all_strata", F.lit(1))
    flag = monotone(per, "tertile", "m", ["all_strata"])
    return per.join(flag, "all_strata").select("tertile", "n", r6("m", "mean_r"), r6("s", "sd_r"), r6("e", "mean_mae"), "monotone")


FINGER = with_panel(*TRIPLET, TRIPLET_ROWS, f"""
FZ AS (SELECT a.subject_id AS x, b.subject_id AS y, {corr_expr('a.raw_short', 'b.reference')} AS s FROM T3 a JOIN T3 b ON a.i = b.i AND a.j = b.j GROUP BY 1, 2),
FR AS (SELECT f.x AS subject_id, 1 + count(*) FILTER (WHERE f.s > o.s AND f.x <> f.y) AS rank FROM FZ f JOIN FZ o ON o.x = f.x AND o.y = f.x WHERE o.s IS NOT NULL GROUP BY 1)""")


def fingerprints(spark, sf_dir):
    from reliaspan.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    rows = triplet(spark, sf_dir).checkpoint()
    return fingerprint_ranks(pack_vectors(rows.filter("raw_short IS NOT NULL"), "raw_short"), pack_vectors(rows, "reference"))


@query("fingerprint_rank", FINGER + "SELECT subject_id, CAST(rank AS BIGINT) AS rank FROM FR")
def fingerprint_rank(spark, sf_dir):
    return fingerprints(spark, sf_dir)


@query(
    "fingerprint_summary",
    FINGER
    + f"SELECT CAST(count(*) AS BIGINT) AS n, {q6('avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END)', 'identification_rate')}, {q6('avg(rank)', 'mean_rank')}, {q6('quantile_cont(CAST(rank AS DOUBLE), 0.5)', 'median_rank')} FROM FR",
)
def fingerprint_summary_query(spark, sf_dir):
    s = fingerprint_summary(fingerprints(spark, sf_dir))
    return s.select("n", r6("identification_rate"), r6("mean_rank"), r6("median_rank"))


MODE_ORDER = ("REG", "A", "N", "R")
COND_SQL = """WITH C AS (SELECT l_suppkey AS subject_id, l_returnflag AS condition, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2)"""


def conditions(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("condition")).agg(
        F.avg("l_discount").alias("v")
    )


@query(
    "paired_t",
    COND_SQL
    + f""" SELECT c.condition, CAST(count(*) AS BIGINT) AS n, {q6('avg(b.v - c.v)', 'mean_diff')}, {q6('avg(b.v - c.v) / (stddev_samp(b.v - c.v) / sqrt(count(*)))', 't')},
      CAST(count(*) - 1 AS BIGINT) AS df FROM C c JOIN C b ON b.subject_id = c.subject_id AND b.condition = 'A' AND c.condition <> 'A' GROUP BY 1""",
)
def paired_t_query(spark, sf_dir):
    return paired_t(conditions(spark, sf_dir), "subject_id", "condition", "v", "A").select("condition", "n", r6("mean_diff"), r6("t"), "df")


@query("paired_t_bonferroni")
def paired_t_bonferroni(spark, sf_dir):
    t = paired_t(conditions(spark, sf_dir), "subject_id", "condition", "v", "A")
    return bonferroni(t, 2).select("condition", r6("t"), "df", r6("p"), r6("p_bonferroni"))


@query(
    "friedman_kendall",
    COND_SQL
    + f""", R AS (SELECT *, rank() OVER (PARTITION BY subject_id ORDER BY v) + (count(*) OVER (PARTITION BY subject_id, v) - 1) / 2.0 AS rk FROM C),
      G AS (SELECT condition, sum(rk) AS rs, count(*) AS n FROM R GROUP BY 1),
      H AS (SELECT max(n) AS n, count(*) AS k, 12.0 * sum(rs * rs) / (max(n) * count(*) * (count(*) + 1)) - 3.0 * max(n) * (count(*) + 1) AS chi2 FROM G)
      SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, {q6('chi2', 'chi2')}, {q6('chi2 / (n * (k - 1))', 'w')} FROM H""",
)
def friedman_kendall(spark, sf_dir):
    return friedman(conditions(spark, sf_dir), "subject_id", "condition", "v").select("n", "k", r6("chi2"), r6("w"))


PVALS = "WITH T AS (SELECT l_suppkey AS test, l_returnflag AS family, avg(l_discount) * 2 AS p FROM lineitem GROUP BY 1, 2), "


@query(
    "holm_bh",
    PVALS
    + f"""S AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS rn FROM T)
      SELECT test, family, {q6('max(least(1, p * (m - rn + 1))) OVER (PARTITION BY family ORDER BY rn ROWS UNBOUNDED PRECEDING)', 'holm')},
      {q6('least(1, min(p * m / rn) OVER (PARTITION BY family ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'bh')} FROM S""",
)
def holm_bh(spark, sf_dir):
    tests = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("test"), F.col("l_returnflag").alias("family")).agg(
        (F.avg("l_discount") * 2).alias("p")
    )
    return adjust_p(tests, "p", ["family"]).select("test", "family", r6("holm"), r6("bh"))


#: Permutations of a null distribution.
PERMUTATIONS = 1000


def _perm_sql(within):
    part = "perm" + (", site" if within else "")
    return f"""WITH B AS (SELECT vec_id AS subject_id, CAST(label % 2 AS INTEGER) AS label, CAST(vec_id % 3 AS INTEGER) AS site, embedding[1] + embedding[2] AS score FROM embeddings),
      R AS (SELECT B.*, CAST(p.p AS INTEGER) AS perm FROM B CROSS JOIN range(1, {PERMUTATIONS + 1}) p(p)),
      A AS (SELECT perm, subject_id, site, score, row_number() OVER (PARTITION BY {part} ORDER BY {hash_sql('subject_id', '7', "'anchor'")}, subject_id) AS rn FROM R),
      Z AS (SELECT perm, site, label, row_number() OVER (PARTITION BY {part} ORDER BY {hash_sql('subject_id', '7', 'perm', "'perm'")}, subject_id) AS rn FROM R),
      N AS (SELECT A.perm, abs(avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0)) AS stat FROM A JOIN Z ON A.perm = Z.perm AND A.rn = Z.rn {'AND A.site = Z.site' if within else ''} GROUP BY 1),
      O AS (SELECT abs(avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0)) AS observed FROM B)
      SELECT {q6('observed', 'observed')}, {q6(f'(1.0 + (SELECT count(*) FROM N WHERE stat >= observed)) / {PERMUTATIONS + 1}', 'p')} FROM O"""


def _perm(spark, sf_dir, within):
    emb = read_table(spark, sf_dir, "embeddings")
    rows = emb.select(
        F.col("vec_id").alias("subject_id"), (F.col("label") % 2).cast("int").alias("label"), (F.col("vec_id") % 3).cast("int").alias("site"),
        (F.col("embedding")[0] + F.col("embedding")[1]).alias("score"),
    )
    packed, codes = permuted_codes(rows, PERMUTATIONS, 7, within=["site"] if within else [], extra=["score"])
    mean = lambda c: F.max(F.when((F.col("label") == c) & (F.col("n") > 0), F.col("total") / F.col("n")))
    stats = materialise(permuted_sums(packed, codes, "score").groupBy("perm").agg(F.abs(mean(1) - mean(0)).alias("stat")))
    return permutation_p(stats.filter("perm = 0").agg(F.max("stat").alias("stat")), stats.filter("perm > 0"), "stat").select(r6("observed"), r6("p"))


@query("permutation_p", _perm_sql(False))
def permutation_free(spark, sf_dir):
    return _perm(spark, sf_dir, False)


@query("permutation_p_within_site", _perm_sql(True))
def permutation_within(spark, sf_dir):
    return _perm(spark, sf_dir, True)


CURVE_SQL = """
CV AS (SELECT l_suppkey AS subject_id, CAST(floor(l_quantity / 10) AS INTEGER) AS duration, avg(l_discount) AS r, avg(l_tax) AS rho,
  min(l_discount) AS ci_lower, max(l_discount) AS ci_upper FROM lineitem GROUP BY 1, 2)"""


def curves(spark, sf_dir):
    """A curve per supplier over quantity classes, standing in for similarity over duration."""
    return read_table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("subject_id"), F.floor(F.col("l_quantity") / 10).cast("int").alias("duration")
    ).agg(F.avg("l_discount").alias("r"), F.avg("l_tax").alias("rho"), F.min("l_discount").alias("ci_lower"), F.max("l_discount").alias("ci_upper"))


@query(
    "equivalent_duration",
    "WITH " + CURVE_SQL.strip()
    + f""", SG AS (SELECT *, lead(r) OVER w AS r1, lead(duration) OVER w AS d1, row_number() OVER w AS k FROM CV WINDOW w AS (PARTITION BY subject_id ORDER BY r)),
      SL AS (SELECT *, max(k) OVER (PARTITION BY subject_id) - 1 AS last FROM SG)
      SELECT subject_id, {q6('max(0.05)', 'target')}, {q6('max(duration + (0.05 - r) / nullif(r1 - r, 0) * (d1 - duration))', 'equivalent')} FROM SL
      WHERE r1 IS NOT NULL AND (0.05 >= r OR k = 1) AND (0.05 < r1 OR k = last) GROUP BY 1""",
)
def equivalent_duration_query(spark, sf_dir):
    # as the SQL compares: averages in table order, to the last digit
    return equivalent_duration(curves(spark, sf_dir), "duration", "r", F.lit(0.05), ["subject_id"], noise=0.0).select("subject_id", r6("target"), r6(F.round("equivalent", 9), "equivalent"))  # halves of the last digit stay halves


@query(
    "crossover_duration",
    "WITH " + CURVE_SQL.strip()
    + f""", SG AS (SELECT *, r - rho AS d, lead(r - rho) OVER w AS n, lead(duration) OVER w AS nd FROM CV WINDOW w AS (PARTITION BY subject_id ORDER BY duration))
      SELECT subject_id, {q6('arg_min(duration + d / (d - n) * (nd - duration), duration)', 'crossover')} FROM SG WHERE d >= 0 AND n < 0 GROUP BY 1""",
)
def crossover_query(spark, sf_dir):
    return crossover(curves(spark, sf_dir), "duration", "r", "rho", ["subject_id"], noise=0.0).select("subject_id", r6(F.round("crossover", 9), "crossover"))


@query(
    "marginal_gain",
    "WITH " + CURVE_SQL.strip()
    + f""", G AS (SELECT *, r - lag(r) OVER (PARTITION BY subject_id ORDER BY duration) AS gain, ci_upper - ci_lower AS width FROM CV)
      SELECT duration, {q6('avg(r)', 'pred_mean')}, {q6('stddev_samp(r)', 'pred_sd')}, {q6('avg(gain)', 'mg_mean')}, {q6('stddev_samp(gain)', 'mg_sd')},
      {q6('avg(width)', 'ciw_mean')}, {q6('stddev_samp(width)', 'ciw_sd')} FROM G GROUP BY 1""",
)
def marginal_gain_query(spark, sf_dir):
    out = marginal_gain(curves(spark, sf_dir), "duration", "r", "subject_id")
    return out.select("duration", *[r6(c) for c in out.columns if c != "duration"])


@query(
    "representative_subject",
    SIMS[:-1]
    + f""", AV AS (SELECT avg(r_fc) AS a, avg(mae) AS b FROM SIM)
      SELECT arg_min(subject_id, abs(r_fc - a) + abs(mae - b)) AS subject_id, {q6('min(abs(r_fc - a) + abs(mae - b))', 'distance')} FROM SIM, AV""",
)
def representative_subject_query(spark, sf_dir):
    return representative_subject(sims(spark, sf_dir), ["r_fc", "mae"]).select("subject_id", r6("distance"))


@query(
    "median_subject",
    SIMS[:-1] + f", O AS (SELECT *, row_number() OVER (ORDER BY r_fc, subject_id) AS rn, count(*) OVER () AS n FROM SIM WHERE r_fc IS NOT NULL) SELECT subject_id, {q6('r_fc', 'r_fc')} FROM O WHERE rn = n // 2 + 1",
)
def median_subject_query(spark, sf_dir):
    return median_subject(sims(spark, sf_dir), "r_fc").select("subject_id", r6("r_fc"))


GRID = [round(float(x), 3) for x in np.linspace(-0.5, 1.0, 31)]


@query(
    "kde_grid",
    SIMS[:-1]
    + f""", H AS (SELECT pow(count(r_fc), -0.2) * stddev_samp(r_fc) AS h FROM SIM)
      SELECT CAST(g.x AS DOUBLE) AS x, {q6('avg(exp(-(g.x - r_fc) * (g.x - r_fc) / (h * h) / 2) / (h * sqrt(2 * pi())))', 'density')}
      FROM SIM, H, (SELECT CAST(unnest([{', '.join(map(str, GRID))}]) AS DOUBLE) AS x) g WHERE r_fc IS NOT NULL GROUP BY 1""",
)
def kde_grid(spark, sf_dir):
    return kernel_density(sims(spark, sf_dir), "r_fc", GRID).select("x", r6("density"))


@query(
    "short_full_regression",
    with_panel(*PAIR)
    + f"""SELECT subject_id, {q6('regr_slope(full_r, short)', 'slope')}, {q6('regr_intercept(full_r, short)', 'intercept')}, {q6(corr_expr('short', 'full_r'), 'r')},
      CAST(count(*) AS BIGINT) AS n FROM P GROUP BY 1""",
)
def short_full_regression(spark, sf_dir):
    out = regression_line(pair(spark, sf_dir), "short", "full", ["subject_id"])
    return out.select("subject_id", r6("slope"), r6("intercept"), r6("r"), "n")


@query(
    "quartiles_by_condition",
    f"""SELECT l_returnflag AS condition, {q6('quantile_cont(l_extendedprice, 0.25)', 'p25')}, {q6('quantile_cont(l_extendedprice, 0.5)', 'median')},
      {q6('quantile_cont(l_extendedprice, 0.75)', 'p75')}, {q6('quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)', 'iqr')} FROM lineitem GROUP BY 1""",
)
def quartiles_by_condition(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("condition"), "l_extendedprice")
    q = quartile_summary(rows, "l_extendedprice", ["condition"])
    return q.select("condition", *[r6(c) for c in ("p25", "median", "p75", "iqr")])


@query(
    "improvement_counts",
    with_panel(*TRIPLET, TRIPLET_ROWS, f"""
IM AS (SELECT subject_id, {corr_expr('raw_short', 'reference')} AS a, {corr_expr('lw_short', 'reference')} AS b FROM T3 GROUP BY 1)""")
    + f"""SELECT grp, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE b > a) AS BIGINT) AS n_improved,
      {q6('avg(CASE WHEN b > a THEN 100.0 ELSE 0 END)', 'pct_improved')}, {q6('avg(b - a)', 'mean_delta')} FROM IM JOIN attrs USING (subject_id) GROUP BY 1""",
)
def improvement_counts_query(spark, sf_dir):
    per = triplet(spark, sf_dir).groupBy("subject_id").agg(
        moment_corr("raw_short", "reference", strict=True).alias("a"), moment_corr("lw_short", "reference", strict=True).alias("b")
    )
    out = improvement_counts(with_attributes(per), "a", "b", ["grp"])
    return out.select("grp", "n", "n_improved", r6("pct_improved"), r6("mean_delta"))


@query(
    "run_summary",
    COND_SQL
    + f""" SELECT condition, CAST(count(*) AS BIGINT) AS n_runs, {q6('avg(CASE WHEN subject_id % 7 <> 0 THEN v END)', 'metric_mean')}, {q6('stddev_pop(CASE WHEN subject_id % 7 <> 0 THEN v END)', 'metric_std')},
      {q6('avg(CASE WHEN v < 0.05 THEN 1.0 ELSE 0 END)', 'p_sig_rate')}, {q6('avg(CASE WHEN subject_id % 7 = 0 THEN 1.0 ELSE 0 END)', 'invalid_rate')} FROM C GROUP BY 1""",
)
def run_summary_query(spark, sf_dir):
    runs = conditions(spark, sf_dir).withColumns({
        "metric": F.when(F.col("subject_id") % 7 == 0, float("nan")).otherwise(F.col("v")), "p": F.col("v"),
    })
    s = run_summary(runs, ["condition"], ["metric"], ["p"])
    return s.select("condition", "n_runs", *[r6(c) for c in ("metric_mean", "metric_std", "p_sig_rate", "invalid_rate")])
