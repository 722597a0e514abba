"""Connectivity queries on the monthly supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliaspan.catalog.fixtures import (
    segment_conditions, segment_pairs, short_frames, with_attributes,
)
from reliaspan.catalog.registry import q6, query, r6
from reliaspan.catalog.sqlparts import (
    SHORT, SUFFIX, centred, corr_expr, covariance, ledoit_wolf, pearson, similarity, with_panel, z_space,
)
from reliaspan.operators.connectivity import (
    covariance_to_correlation, fc_edges, full_matrix, moment_corr, pair_moments, shrunk_pairs,
)
from reliaspan.operators.edges import (
    cross_subject_reliability, group_mean_edges, hemisphere_networks, keep_strongest, network_blocks, partial_edges, projections, shrunk_covariances, tangent_edges, tangent_fold_edges, threshold_report, value_distribution,
)
from reliaspan.operators.graph import block_assignment
from reliaspan.operators.prep import detrend_zscore
from reliaspan.operators.slices import label_segments
from reliaspan.session import ensure_checkpoint_dir
from reliaspan.sources.panels import N_CHANNELS, lineitem_frames, lineitem_samples, samples_to_frames

EDGE_SQL = f"SELECT subject_id, i, j, {q6('r', 'r')} FROM "


def _edges(df, *extra):
    return df.select("subject_id", *extra, "i", "j", r6("r"))


@query("fc_pearson", with_panel(pearson("S", "E")) + EDGE_SQL + "E")
def fc_pearson(spark, sf_dir):
    return _edges(fc_edges(lineitem_frames(spark, sf_dir)))


@query("fc_pearson_zero_filled", with_panel(SHORT, pearson("SHORT", "E", constant="0")) + EDGE_SQL + "E")
def fc_pearson_zero_filled(spark, sf_dir):
    return _edges(fc_edges(short_frames(spark, sf_dir), constant=0.0))


@query("fc_fisher_z", with_panel(pearson("S", "E"), z_space("E", "Z")) + EDGE_SQL + "Z")
def fc_fisher_z(spark, sf_dir):
    return _edges(fc_edges(lineitem_frames(spark, sf_dir), fisher=True))


@query("fc_ledoit_wolf", with_panel(ledoit_wolf("S", "E")) + EDGE_SQL + "E")
def fc_ledoit_wolf(spark, sf_dir):
    return _edges(fc_edges(lineitem_frames(spark, sf_dir), kind="ledoit_wolf"))


@query(
    "fc_ledoit_wolf_matrix",
    with_panel(ledoit_wolf("S", "E"))
    + f"""SELECT subject_id, i, j, {q6('r', 'r')} FROM (
      SELECT * FROM E UNION ALL SELECT subject_id, j, i, r FROM E
      UNION ALL SELECT DISTINCT subject_id, channel, channel, 1.0 FROM S)""",
)
def fc_ledoit_wolf_matrix(spark, sf_dir):
    return _edges(full_matrix(fc_edges(lineitem_frames(spark, sf_dir), kind="ledoit_wolf")))


OAS_SQL = """
OC AS (SELECT *, c * n / (n - 1) AS s FROM E_c),
OA AS (SELECT subject_id, max(n) AS n, sum(CASE WHEN i = j THEN 1 ELSE 0 END) AS p,
  sum(CASE WHEN i = j THEN s ELSE 0 END) AS tr, sum(CASE WHEN i = j THEN s * s ELSE 2 * s * s END) AS tr2
  FROM OC GROUP BY subject_id),
OW AS (SELECT *, least(1, greatest(0, ((1 - 2 / p) * tr2 + tr * tr) / ((n + 1 - 2 / p) * (tr2 - tr * tr / p)))) AS a FROM OA),
O AS (SELECT c.subject_id, c.i, c.j, (1 - a) * c.s / sqrt(((1 - a) * x.s + a * tr / p) * ((1 - a) * y.s + a * tr / p)) AS r
  FROM OC c JOIN OC x ON x.subject_id = c.subject_id AND x.i = c.i AND x.j = c.i
  JOIN OC y ON y.subject_id = c.subject_id AND y.i = c.j AND y.j = c.j
  JOIN OW w ON w.subject_id = c.subject_id WHERE c.i < c.j)"""


@query("fc_oas", with_panel(centred("S", "E_x"), covariance("E_x", "E_c"), OAS_SQL) + EDGE_SQL + "O")
def fc_oas(spark, sf_dir):
    return _edges(fc_edges(lineitem_frames(spark, sf_dir), kind="oas"))


@query("covariance_to_correlation", with_panel(pearson("S", "E")) + EDGE_SQL + "E")
def cov_to_corr(spark, sf_dir):
    m = pair_moments(lineitem_frames(spark, sf_dir), ["subject_id"])
    cov = m.select("subject_id", "i", "j", (F.col("sij") / F.col("n") - F.col("si") * F.col("sj") / F.col("n") / F.col("n")).alias("c"))
    return _edges(covariance_to_correlation(cov).filter("i < j"))


@query("fc_partial")
def fc_partial(spark, sf_dir):
    return _edges(partial_edges(lineitem_frames(spark, sf_dir)))


@query("fc_partial_pseudo_inverse")
def fc_partial_pinv(spark, sf_dir):
    return _edges(partial_edges(lineitem_frames(spark, sf_dir), shrink=False))


@query("fc_tangent")
def fc_tangent(spark, sf_dir):
    """Fitted on the even half of the cohort, applied to everyone."""
    ensure_checkpoint_dir(spark)
    z = detrend_zscore(lineitem_samples(spark, sf_dir), detrend=False)
    cov = shrunk_covariances(samples_to_frames(z)).checkpoint()
    return _edges(tangent_edges(cov, cov.filter("subject_id % 2 = 0")))


@query("fc_tangent_folds")
def fc_tangent_folds(spark, sf_dir):
    """Every subject around the mean of the folds that it is not in; three folds by id."""
    ensure_checkpoint_dir(spark)
    z = detrend_zscore(lineitem_samples(spark, sf_dir), detrend=False)
    cov = shrunk_covariances(samples_to_frames(z)).checkpoint()
    found = tangent_fold_edges(cov, cov.select("subject_id", (F.col("subject_id") % 3).alias("fold")))
    return found.select("fold", "subject_id", "i", "j", r6("r"))


SIM = with_panel(SHORT, pearson("SHORT", "A"), pearson("S", "B"), similarity("A", "B", "R"))


@query("fc_similarity", SIM + f"SELECT subject_id, {q6('r_fc', 'r_fc')} FROM R")
def fc_similarity(spark, sf_dir):
    wide = segment_pairs(spark, sf_dir)
    return wide.groupBy("subject_id").agg(moment_corr("short", "full", strict=True).alias("r_fc")).select("subject_id", r6("r_fc"))


TRIPLET = [SHORT, pearson("SHORT", "A"), ledoit_wolf("SHORT", "L"), pearson("S", "B")]


def triplet(spark, sf_dir):
    """(subject_id, i, j, raw_short, lw_short, reference): both kinds share one moment pass."""
    frames = label_segments(lineitem_frames(spark, sf_dir), segment_conditions(("short", "full")))
    pairs = shrunk_pairs(pair_moments(frames, ["subject_id", "seg"], norm=True), ["subject_id", "seg"]).filter("i < j")
    s = F.col("s")
    lw = F.coalesce(F.try_divide(F.col("c"), F.sqrt(F.col("vi") * F.col("vj"))), F.lit(0.0))
    raw = F.col("raw")
    return (
        pairs.withColumn("lw", lw)
        .groupBy("subject_id", "i", "j")
        .agg(
            F.max(F.when(F.col("seg") == "short", raw)).alias("raw_short"),
            F.max(F.when(F.col("seg") == "short", F.col("lw"))).alias("lw_short"),
            F.max(F.when(F.col("seg") == "full", raw)).alias("reference"),
        )
    )


TRIPLET_ROWS = """
T3 AS (SELECT A.subject_id, A.i, A.j, A.r AS raw_short, L.r AS lw_short, B.r AS reference FROM A
  JOIN L ON L.subject_id = A.subject_id AND L.i = A.i AND L.j = A.j
  JOIN B ON B.subject_id = A.subject_id AND B.i = A.i AND B.j = A.j)"""


@query(
    "fc_triplet_summary",
    with_panel(*TRIPLET, TRIPLET_ROWS)
    + f"""SELECT subject_id, {q6(corr_expr('raw_short', 'reference'), 'raw_vs_ref')},
      {q6(corr_expr('lw_short', 'reference'), 'lw_vs_ref')}, {q6('avg(abs(raw_short))', 'mean_abs_raw')}
      FROM T3 GROUP BY subject_id""",
)
def fc_triplet_summary(spark, sf_dir):
    agg = triplet(spark, sf_dir).groupBy("subject_id").agg(
        moment_corr("raw_short", "reference", strict=True).alias("raw_vs_ref"),
        moment_corr("lw_short", "reference", strict=True).alias("lw_vs_ref"),
        F.avg(F.abs("raw_short")).alias("mean_abs_raw"),
    )
    return agg.select("subject_id", r6("raw_vs_ref"), r6("lw_vs_ref"), r6("mean_abs_raw"))


@query(
    "group_mean_fc",
    with_panel(pearson("S", "E"))
    + f"""SELECT grp, i, j, CAST(n AS BIGINT) AS n_subjects, {q6('r', 'r')} FROM (
      SELECT a.grp, i, j, count(*) AS n, avg(r) AS r FROM E JOIN attrs a USING (subject_id)
      GROUP BY GROUPING SETS ((a.grp, i, j), (i, j))) WHERE n >= 3""",
)
def group_mean_fc(spark, sf_dir):
    out = group_mean_edges(with_attributes(fc_edges(lineitem_frames(spark, sf_dir))))
    return out.select("grp", "i", "j", "n_subjects", r6("r"))


@query(
    "group_mean_similarity",
    with_panel(*TRIPLET, TRIPLET_ROWS)
    + f"""SELECT grp, {q6('raw', 'raw_vs_ref', 4)}, {q6('lw', 'lw_vs_ref', 4)} FROM (
      SELECT grp, {corr_expr('raw_short', 'reference')} AS raw, {corr_expr('lw_short', 'reference')} AS lw FROM (
      SELECT a.grp, i, j, avg(raw_short) AS raw_short, avg(lw_short) AS lw_short, avg(reference) AS reference
      FROM T3 JOIN attrs a USING (subject_id) GROUP BY GROUPING SETS ((a.grp, i, j), (i, j)) HAVING count(*) >= 3)
      GROUP BY grp)""",
)
def group_mean_similarity(spark, sf_dir):
    rows = with_attributes(triplet(spark, sf_dir))
    means = rows.groupingSets([["grp", "i", "j"], ["i", "j"]], "grp", "i", "j").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("raw_short", "lw_short", "reference")]
    ).filter("n >= 3")
    return means.groupBy("grp").agg(
        r6(moment_corr("raw_short", "reference", strict=True), "raw_vs_ref", 4),
        r6(moment_corr("lw_short", "reference", strict=True), "lw_vs_ref", 4),
    )


NET = f"least(floor({{0}} / floor({N_CHANNELS} / 5)), 4)"


@query(
    "network_block_fc",
    with_panel(pearson("S", "E"))
    + f"""SELECT subject_id, network_i, network_j, CASE WHEN network_i = network_j THEN 'within' ELSE 'between' END AS pair_type,
      CAST(count(*) AS BIGINT) AS n_edges, {q6('avg(r)', 'mean_fc')} FROM (
      SELECT subject_id, r, CAST(least({NET.format('i')}, {NET.format('j')}) AS INTEGER) AS network_i,
        CAST(greatest({NET.format('i')}, {NET.format('j')}) AS INTEGER) AS network_j FROM E) GROUP BY 1, 2, 3""",
)
def network_block_fc(spark, sf_dir):
    edges = fc_edges(lineitem_frames(spark, sf_dir))
    nets = F.lit(N_CHANNELS)
    labelled = edges.withColumn("na", block_assignment("i", nets, 5)).withColumn("nb", block_assignment("j", nets, 5))
    # The channel count is the panel's own, so the lookup is arithmetic and needs no join.
    out = labelled.groupBy("subject_id", F.least("na", "nb").alias("network_i"), F.greatest("na", "nb").alias("network_j")).agg(
        F.avg("r").alias("mean_fc"), F.count(F.lit(1)).alias("n_edges")
    )
    kind = F.when(F.col("network_i") == F.col("network_j"), "within").otherwise("between").alias("pair_type")
    return out.select("subject_id", "network_i", "network_j", kind, "n_edges", r6("mean_fc"))


@query(
    "hemisphere_block_fc",
    with_panel(
        pearson("S", "E"),
        """
NODE AS (SELECT DISTINCT CAST(l_partkey % 12 AS INTEGER) AS channel FROM lineitem),
LAB AS (SELECT channel, CAST((channel % 3) * 2 + CASE WHEN channel - 5.5 > 0 THEN 1 ELSE 0 END AS INTEGER) AS network FROM NODE),
BLK AS (SELECT subject_id, least(a.network, b.network) AS network_i, greatest(a.network, b.network) AS network_j, avg(r) AS m
  FROM E JOIN LAB a ON a.channel = E.i JOIN LAB b ON b.channel = E.j GROUP BY 1, 2, 3),
CUT AS (SELECT subject_id, quantile_cont(CAST(abs(m) AS DOUBLE), 0.7) AS cut FROM BLK WHERE network_i <> network_j GROUP BY 1)""",
    )
    + f"""SELECT subject_id, network_i, network_j, {q6('CASE WHEN abs(m) < cut THEN 0 ELSE m END', 'mean_fc')}
      FROM BLK JOIN CUT USING (subject_id)""",
)
def hemisphere_block_fc(spark, sf_dir):
    channels = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .select((F.col("l_partkey") % N_CHANNELS).cast("int").alias("channel"))
        .distinct()
    )
    nets = channels.withColumn("network", F.col("channel") % 3)
    coords = channels.select("channel", (F.col("channel") - 5.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    nodes = hemisphere_networks(nets, coords)
    blocks = network_blocks(fc_edges(lineitem_frames(spark, sf_dir)), nodes)
    return keep_strongest(blocks, 0.3).select("subject_id", "network_i", "network_j", r6("mean_fc"))


@query(
    "fc_distribution",
    with_panel(pearson("S", "E", constant="0"))
    + f"""SELECT CAST(count(*) AS BIGINT) AS n_pairs, {q6('avg(CASE WHEN abs(r) < 0.05 THEN 100.0 ELSE 0 END)', 'below_05_pct')},
      {q6('avg(CASE WHEN abs(r) < 0.1 THEN 100.0 ELSE 0 END)', 'below_10_pct')},
      {q6('avg(CASE WHEN abs(r) < 0.2 THEN 100.0 ELSE 0 END)', 'below_20_pct')},
      {q6('avg(CASE WHEN r > 0.1 THEN 100.0 ELSE 0 END)', 'above_10_pct')},
      {q6('avg(r)', 'mean_fc')}, {q6('stddev_pop(r)', 'sd_fc')} FROM E""",
)
def fc_distribution(spark, sf_dir):
    d = value_distribution(fc_edges(lineitem_frames(spark, sf_dir), constant=0.0))
    return d.select("n_pairs", *[r6(c) for c in d.columns if c != "n_pairs"])


@query(
    "fc_threshold_report",
    with_panel(pearson("S", "E", constant="0"))
    + f"""SELECT CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(CASE WHEN abs(m) >= 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
      CAST(sum(CASE WHEN abs(m) >= 0.02 THEN 0 ELSE 1 END) AS BIGINT) AS n_removed,
      {q6('avg(CASE WHEN abs(m) >= 0.02 THEN 100.0 ELSE 0 END)', 'pct_kept')},
      {q6('greatest(quantile_cont(CAST(abs(m) AS DOUBLE), 0.99), 0.05)', 'scale')}
      FROM (SELECT i, j, avg(r) AS m FROM E GROUP BY i, j)""",
)
def fc_threshold_report(spark, sf_dir):
    mean = fc_edges(lineitem_frames(spark, sf_dir), constant=0.0).groupBy("i", "j").agg(F.avg("r").alias("r"))
    d = threshold_report(mean, 0.02)
    return d.select("n_pairs", "n_kept", "n_removed", r6("pct_kept"), r6("scale"))


@query(
    "cross_subject_edge_r",
    with_panel(SHORT, pearson("SHORT", "A"), pearson("S", "B"))
    + f"""SELECT A.i, A.j, CAST(count(A.r + B.r) AS BIGINT) AS n_subjects, {q6('coalesce(covar_pop(A.r, B.r) / nullif(sqrt(var_pop(CASE WHEN B.r IS NOT NULL THEN A.r END) * var_pop(CASE WHEN A.r IS NOT NULL THEN B.r END)), 0), 0)', 'r')}
      FROM A JOIN B ON A.subject_id = B.subject_id AND A.i = B.i AND A.j = B.j GROUP BY 1, 2""",
)
def cross_subject_edge_r(spark, sf_dir):
    return cross_subject_reliability(segment_pairs(spark, sf_dir)).select("i", "j", "n_subjects", r6("r"))


SCALED = with_panel(
    SHORT, SUFFIX, ledoit_wolf("SHORT", "A"), ledoit_wolf("REST", "B"), similarity("A", "B", "R", name="r_raw"),
    """
V AS (SELECT subject_id, r_raw, tanh(atanh(r_raw) + 0.2) AS rho FROM R)""",
)


@query(
    "edge_projection_variants",
    SCALED
    + f"""SELECT subject_id, i, j, {q6('CASE WHEN rho IS NOT NULL THEN least(1, greatest(-1, r * (rho / greatest(r_raw, 0.01)))) END', 'ratio')},
      {q6('CASE WHEN rho IS NOT NULL THEN tanh(atanh(r) * least(2, greatest(0.5, rho / greatest(r_raw, 0.01)))) END', 'z_ratio')},
      {q6('tanh(atanh(r) * least(rho / r_raw, 1.5))', 'z_capped')},
      {q6('tanh(atanh(r) + atanh(rho) - atanh(r_raw))', 'z_shift')}
      FROM A JOIN V USING (subject_id)""",
)
def edge_projection_variants(spark, sf_dir):
    """The scalar comes from the measured similarity, shifted by a constant in z space."""
    wide = segment_pairs(spark, sf_dir, "ledoit_wolf", ("short", "rest"))
    scal = wide.groupBy("subject_id").agg(moment_corr("short", "rest", strict=True).alias("r_raw"))
    scal = scal.withColumn("rho_hat_t", F.tanh(F.atanh("r_raw") + 0.2))
    edges = wide.select("subject_id", "i", "j", F.col("short").alias("r"))
    joined = edges.join(scal, "subject_id")
    return joined.select("subject_id", "i", "j", *[r6(c, name) for name, c in projections().items()])
