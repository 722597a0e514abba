"""Graph and community queries on the thresholded networks of the monthly supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliaspan.catalog.connectivity_queries import TRIPLET, TRIPLET_ROWS, triplet
from reliaspan.catalog.fixtures import segment_pairs
from reliaspan.catalog.registry import q6, query, r6
from reliaspan.catalog.sqlparts import corr_expr, hash_sql, pearson, with_panel
from reliaspan.operators.cluster import agreement, spectral_channel_labels
from reliaspan.operators.connectivity import fc_edges, moment_corr
from reliaspan.operators.edges import pack_symmetric
from reliaspan.operators.graph import (
    absolute_threshold, algebraic_connectivity, best_jaccard, block_assignment, communities, connected_components, degree_variance, density_threshold, edge_nodes, graph_metrics, largest_component, mark_density, mean_path_length, modularity, network_order, parse_networks, small_worldness, to_adjacency,
)
from reliaspan.operators.ranking import number_rows
from reliaspan.session import ensure_checkpoint_dir
from reliaspan.sources.panels import N_CHANNELS, lineitem_frames, read_table

FULL = [pearson("S", "E", constant="0"), """
CUT AS (SELECT subject_id, quantile_cont(CAST(abs(r) AS DOUBLE), 1 - 0.25) AS cut FROM E GROUP BY 1),
MK AS (SELECT E.*, abs(r) >= cut AS kept FROM E JOIN CUT USING (subject_id)),
ENDS AS (SELECT subject_id, i AS node, kept FROM MK UNION ALL SELECT subject_id, j, kept FROM MK),
DEG AS (SELECT subject_id, node, sum(CASE WHEN kept THEN 1 ELSE 0 END) AS k FROM ENDS GROUP BY 1, 2),
ADJ AS (SELECT subject_id, i AS s, j AS d FROM MK WHERE kept UNION ALL SELECT subject_id, j, i FROM MK WHERE kept),
TRI AS (SELECT a.subject_id, a.s AS node, count(*) / 2 AS t FROM ADJ a JOIN ADJ b ON a.subject_id = b.subject_id AND a.d = b.s
  JOIN ADJ c ON c.subject_id = b.subject_id AND c.s = b.d AND c.d = a.s GROUP BY 1, 2)"""]


def full_edges(spark, sf_dir):
    return fc_edges(lineitem_frames(spark, sf_dir), constant=0.0)


def marked(spark, sf_dir):
    return mark_density(full_edges(spark, sf_dir), 0.25)


@query("density_threshold", with_panel(*FULL) + f"SELECT subject_id, i, j, {q6('r', 'r')} FROM MK WHERE kept")
def density_threshold_query(spark, sf_dir):
    return density_threshold(full_edges(spark, sf_dir), 0.25).select("subject_id", "i", "j", r6("r"))


@query("absolute_threshold", with_panel(*FULL) + f"SELECT subject_id, i, j, {q6('r', 'r')} FROM E WHERE abs(r) > 0.2")
def absolute_threshold_query(spark, sf_dir):
    return absolute_threshold(full_edges(spark, sf_dir), 0.2).select("subject_id", "i", "j", r6("r"))


@query("degree_variance", with_panel(*FULL) + f"SELECT subject_id, {q6('var_pop(k)', 'degree_variance')} FROM DEG GROUP BY 1")
def degree_variance_query(spark, sf_dir):
    return degree_variance(marked(spark, sf_dir)).select("subject_id", r6("degree_variance"))


@query(
    "clustering_density",
    with_panel(*FULL)
    + f"""SELECT d.subject_id, {q6('avg(k)', 'mean_degree')}, {q6('sum(k) / (count(*) * (count(*) - 1))', 'density')},
      {q6('avg(coalesce(t, 0) / greatest(k * (k - 1), 1))', 'clustering')} FROM DEG d LEFT JOIN TRI t ON t.subject_id = d.subject_id AND t.node = d.node GROUP BY 1""",
)
def clustering_density(spark, sf_dir):
    m = graph_metrics(marked(spark, sf_dir))
    return m.select("subject_id", r6("mean_degree"), r6("density"), r6("clustering"))


PRESERVE = with_panel(*TRIPLET, TRIPLET_ROWS, """
L3 AS (SELECT subject_id, i, j, 'raw' AS kind, coalesce(raw_short, 0) AS r FROM T3 UNION ALL SELECT subject_id, i, j, 'lw', lw_short FROM T3 UNION ALL SELECT subject_id, i, j, 'ref', reference FROM T3),
K3 AS (SELECT subject_id, kind, 2.0 * sum(CASE WHEN abs(r) > 0.2 THEN 1 ELSE 0 END) / 12 AS mean_degree FROM L3 GROUP BY 1, 2),
W3 AS (SELECT subject_id, max(CASE WHEN kind = 'raw' THEN mean_degree END) AS raw, max(CASE WHEN kind = 'lw' THEN mean_degree END) AS lw, max(CASE WHEN kind = 'ref' THEN mean_degree END) AS ref FROM K3 GROUP BY 1)""")


@query("metric_preservation", PRESERVE + f"SELECT {q6(corr_expr('raw', 'ref'), 'raw_vs_ref', 4)}, {q6(corr_expr('lw', 'ref'), 'lw_vs_ref', 4)} FROM W3")
def metric_preservation(spark, sf_dir):
    rows = triplet(spark, sf_dir)
    kinds = F.explode(F.array(*[
        F.struct(F.lit(n).alias("kind"), F.coalesce(F.col(c), F.lit(0.0)).alias("r")) for n, c in (("raw", "raw_short"), ("lw", "lw_short"), ("ref", "reference"))
    ]))
    long = rows.select("subject_id", "i", "j", kinds.alias("e")).select("subject_id", "i", "j", "e.*").withColumn("kept", F.abs("r") > 0.2)
    m = graph_metrics(long, ["subject_id", "kind"])
    wide = m.groupBy("subject_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("mean_degree"))).alias(k) for k in ("raw", "lw", "ref")])
    return wide.agg(r6(moment_corr("raw", "ref"), "raw_vs_ref", 4), r6(moment_corr("lw", "ref"), "lw_vs_ref", 4))


@query("fiedler_value")
def fiedler_value(spark, sf_dir):
    return algebraic_connectivity(marked(spark, sf_dir)).select("subject_id", r6("fiedler"))


REACH = """
NODES AS (SELECT DISTINCT subject_id, node FROM ENDS),
REACH AS (SELECT subject_id, node AS root, node, 0 AS hops FROM NODES
  UNION SELECT r.subject_id, r.root, a.d, r.hops + 1 FROM REACH r JOIN ADJ a ON a.subject_id = r.subject_id AND a.s = r.node WHERE r.hops < 11),
DIST AS (SELECT subject_id, root, node, min(hops) AS hops FROM REACH GROUP BY 1, 2, 3),
COMP AS (SELECT subject_id, root AS node, min(node) AS component FROM DIST GROUP BY 1, 2),
SIZE AS (SELECT subject_id, component, count(*) AS size FROM COMP GROUP BY 1, 2),
BIG AS (SELECT subject_id, arg_max(component, size * 1000 - component) AS component, max(size) AS size FROM SIZE GROUP BY 1)"""
RECURSIVE = with_panel(*FULL, REACH).replace("WITH ", "WITH RECURSIVE ", 1)


def _network(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    m = marked(spark, sf_dir).checkpoint()
    return m, m.filter("kept").select("subject_id", "i", "j"), edge_nodes(m)


@query("connected_components", RECURSIVE + "SELECT subject_id, node, component FROM COMP")
def connected_components_query(spark, sf_dir):
    _, kept, nodes = _network(spark, sf_dir)
    return connected_components(to_adjacency(kept), nodes)


@query(
    "largest_component_paths",
    RECURSIVE
    + f"""SELECT b.subject_id, CAST(any_value(size) AS BIGINT) AS size, {q6('avg(hops)', 'path_length')} FROM BIG b JOIN COMP c ON c.subject_id = b.subject_id AND c.component = b.component
      JOIN DIST d ON d.subject_id = c.subject_id AND d.root = c.node WHERE d.root <> d.node GROUP BY 1""",
)
def largest_component_paths(spark, sf_dir):
    _, kept, nodes = _network(spark, sf_dir)
    adj = to_adjacency(kept)
    big = largest_component(connected_components(adj, nodes), ["subject_id"])
    paths = mean_path_length(adj, big)
    return big.groupBy("subject_id").agg(F.max("size").alias("size")).join(paths, "subject_id").select("subject_id", "size", r6("path_length"))


SMALL_WORLD = with_panel(*FULL, REACH, f"""
MAIN AS (SELECT c.subject_id, c.node, b.size FROM COMP c JOIN BIG b ON b.subject_id = c.subject_id AND b.component = c.component),
MN AS (SELECT subject_id, node FROM MAIN WHERE size >= 3),
MP AS (SELECT MK.subject_id, MK.i, MK.j, MK.kept FROM MK JOIN MN a ON a.subject_id = MK.subject_id AND a.node = MK.i JOIN MN b ON b.subject_id = MK.subject_id AND b.node = MK.j),
DE AS (SELECT n.subject_id, 2.0 * e.c / (n.c * (n.c - 1)) AS d FROM (SELECT subject_id, count(*) AS c FROM MN GROUP BY 1) n JOIN (SELECT subject_id, count(*) AS c FROM MP WHERE kept GROUP BY 1) e ON e.subject_id = n.subject_id),
RE AS (SELECT MP.subject_id, i, j FROM MP JOIN DE ON DE.subject_id = MP.subject_id WHERE {hash_sql('MP.subject_id', '42', 'i', 'j')} / 4294967296.0 < d),
RA AS (SELECT subject_id, i AS s, j AS d FROM RE UNION ALL SELECT subject_id, j, i FROM RE),
RR AS (SELECT subject_id, node AS root, node, 0 AS hops FROM MN UNION SELECT r.subject_id, r.root, a.d, r.hops + 1 FROM RR r JOIN RA a ON a.subject_id = r.subject_id AND a.s = r.node WHERE r.hops < 11),
RD AS (SELECT subject_id, root, node, min(hops) AS hops FROM RR GROUP BY 1, 2, 3),
RC AS (SELECT subject_id, root AS node, min(node) AS component FROM RD GROUP BY 1, 2),
RS AS (SELECT subject_id, component, count(*) AS size FROM RC GROUP BY 1, 2),
RB AS (SELECT subject_id, arg_max(component, size * 1000 - component) AS component FROM RS GROUP BY 1),
RN AS (SELECT RC.subject_id, RC.node FROM RC JOIN RB ON RB.subject_id = RC.subject_id AND RB.component = RC.component),
GN AS (SELECT 'real' AS graph, subject_id, node FROM MN UNION ALL SELECT 'random', subject_id, node FROM RN),
GA AS (SELECT 'real' AS graph, subject_id, i AS s, j AS d FROM MP WHERE kept UNION ALL SELECT 'real', subject_id, j, i FROM MP WHERE kept UNION ALL
  SELECT 'random', RA.subject_id, RA.s, RA.d FROM RA JOIN RN ON RN.subject_id = RA.subject_id AND RN.node = RA.s),
GK AS (SELECT graph, subject_id, s AS node, count(*) AS k FROM GA GROUP BY ALL),
GT AS (SELECT a.graph, a.subject_id, a.s AS node, count(*) AS t FROM GA a JOIN GA b ON a.graph = b.graph AND a.subject_id = b.subject_id AND a.d = b.s
  JOIN GA c ON c.graph = b.graph AND c.subject_id = b.subject_id AND c.s = b.d AND c.d = a.s GROUP BY ALL),
GC AS (SELECT n.graph, n.subject_id, avg(coalesce(t, 0) / greatest(coalesce(k, 0) * (coalesce(k, 0) - 1), 1)) AS c FROM GN n LEFT JOIN GK ON GK.graph = n.graph AND GK.subject_id = n.subject_id AND GK.node = n.node
  LEFT JOIN GT ON GT.graph = n.graph AND GT.subject_id = n.subject_id AND GT.node = n.node GROUP BY ALL),
GD AS (SELECT 'real' AS graph, subject_id, root, node, hops FROM DIST UNION ALL SELECT 'random', subject_id, root, node, hops FROM RD),
GL AS (SELECT n.graph, n.subject_id, coalesce(avg(hops) FILTER (WHERE d.root <> d.node), 0) AS l FROM GN n JOIN GD d ON d.graph = n.graph AND d.subject_id = n.subject_id AND d.root = n.node GROUP BY ALL),
GM AS (SELECT subject_id, max(c) FILTER (WHERE graph = 'real') AS c, max(l) FILTER (WHERE graph = 'real') AS l, max(c) FILTER (WHERE graph = 'random') AS c0, max(l) FILTER (WHERE graph = 'random') AS l0 FROM GC JOIN GL USING (graph, subject_id) GROUP BY 1)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "small_world",
    SMALL_WORLD
    + f"""SELECT b.subject_id, CAST(b.size AS INTEGER) AS n_nodes, {q6('c', 'clustering')}, {q6('l', 'path_length')},
      {q6('CASE WHEN c0 > 0 THEN c / c0 ELSE 1 END / nullif(CASE WHEN l0 > 0 THEN l / l0 ELSE 1 END, 0)', 'sigma')} FROM BIG b LEFT JOIN GM ON GM.subject_id = b.subject_id""",
)
def small_world(spark, sf_dir):
    out = small_worldness(marked(spark, sf_dir))
    return out.select("subject_id", "n_nodes", r6("clustering"), r6("path_length"), r6("sigma"))


@query("communities")
def communities_query(spark, sf_dir):
    return communities(marked(spark, sf_dir))


BLOCKS_SQL = f"""
RB AS (SELECT DISTINCT subject_id, channel AS node, CAST(least(floor(channel / floor({N_CHANNELS} / 5)), 4) AS INTEGER) AS community FROM S),
PB AS (SELECT subject_id, node, CAST(k % 4 AS INTEGER) AS pred FROM DEG),
CB AS (SELECT RB.subject_id, community, pred, count(*) AS inter FROM RB JOIN PB ON PB.subject_id = RB.subject_id AND PB.node = RB.node GROUP BY 1, 2, 3)"""


def _blocks(spark, sf_dir):
    """Reference blocks against a labelling by degree modulo 4 (any deterministic labelling will do)."""
    ends = marked(spark, sf_dir).select("subject_id", "kept", F.explode(F.array("i", "j")).alias("node"))
    pred = ends.groupBy("subject_id", "node").agg((F.sum(F.when(F.col("kept"), 1).otherwise(0)) % 4).cast("int").alias("community"))
    return pred.withColumn("reference", block_assignment("node", N_CHANNELS, 5))


@query("block_assignment", with_panel(*FULL, BLOCKS_SQL) + "SELECT subject_id, node, community FROM RB")
def block_assignment_query(spark, sf_dir):
    return _blocks(spark, sf_dir).select("subject_id", "node", F.col("reference").alias("community"))


@query(
    "jaccard_best",
    with_panel(*FULL, BLOCKS_SQL)
    + f"""SELECT subject_id, community, {q6('max(inter / (a + b - inter))', 'jaccard')} FROM (SELECT *, sum(inter) OVER (PARTITION BY subject_id, community) AS a,
      sum(inter) OVER (PARTITION BY subject_id, pred) AS b FROM CB) GROUP BY 1, 2""",
)
def jaccard_best(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    ref = rows.select("subject_id", "node", F.col("reference").alias("community"))
    return best_jaccard(ref, rows.select("subject_id", "node", "community")).select("subject_id", "community", r6("jaccard"))


@query(
    "community_agreement",
    with_panel(*FULL, BLOCKS_SQL, """
CA AS (SELECT subject_id, community, sum(inter) AS n FROM CB GROUP BY 1, 2), CBB AS (SELECT subject_id, pred, sum(inter) AS n FROM CB GROUP BY 1, 2),
I2 AS (SELECT subject_id, sum(inter * (inter - 1) / 2) AS c2, sum(inter) AS n FROM CB GROUP BY 1), A2 AS (SELECT subject_id, sum(n * (n - 1) / 2) AS a2 FROM CA GROUP BY 1), B2 AS (SELECT subject_id, sum(n * (n - 1) / 2) AS b2 FROM CBB GROUP BY 1),
MI AS (SELECT CB.subject_id, sum(inter / t.n * ln(inter * t.n / (CA.n * CBB.n))) AS mi FROM CB JOIN CA ON CA.subject_id = CB.subject_id AND CA.community = CB.community
  JOIN CBB ON CBB.subject_id = CB.subject_id AND CBB.pred = CB.pred JOIN I2 t ON t.subject_id = CB.subject_id GROUP BY 1),
HA AS (SELECT CA.subject_id, -sum(CA.n / t.n * ln(CA.n / t.n)) AS h FROM CA JOIN I2 t ON t.subject_id = CA.subject_id GROUP BY 1), HB AS (SELECT CBB.subject_id, -sum(CBB.n / t.n * ln(CBB.n / t.n)) AS h FROM CBB JOIN I2 t ON t.subject_id = CBB.subject_id GROUP BY 1)""")
    + f"""SELECT subject_id, {q6('(c2 - a2 * b2 / (n * (n - 1) / 2)) / ((a2 + b2) / 2 - a2 * b2 / (n * (n - 1) / 2))', 'ari')}, {q6('greatest(mi, 0) / ((HA.h + HB.h) / 2)', 'nmi')}
      FROM I2 JOIN A2 USING (subject_id) JOIN B2 USING (subject_id) JOIN MI USING (subject_id) JOIN HA USING (subject_id) JOIN HB USING (subject_id)""",
)
def community_agreement(spark, sf_dir):
    return agreement(_blocks(spark, sf_dir), "reference", "community", ["subject_id"]).select("subject_id", r6("ari"), r6("nmi"))


def _labelled_models(spark, sf_dir):
    """Communities of the short and the full network of every subject, in one run over both."""
    ensure_checkpoint_dir(spark)
    wide = segment_pairs(spark, sf_dir, constant=0.0)
    sides = F.explode(F.array(F.struct(F.lit("short").alias("model"), F.col("short").alias("r")), F.struct(F.lit("full").alias("model"), F.col("full").alias("r"))))
    edges = wide.select("subject_id", "i", "j", sides.alias("e")).select("subject_id", "i", "j", "e.*")
    m = mark_density(edges, 0.15, ["subject_id", "model"]).checkpoint()
    keys = ["subject_id", "model"]
    return m, communities(m, keys), keys


@query("community_evaluation")
def community_evaluation(spark, sf_dir):
    """ARI between the communities of the short and the full network, and both community counts."""
    _, labels, _ = _labelled_models(spark, sf_dir)
    wide = labels.groupBy("subject_id", "node").agg(*[F.max(F.when(F.col("model") == k, F.col("community"))).alias(k) for k in ("short", "full")])
    out = agreement(wide, "full", "short", ["subject_id"])
    return out.select("subject_id", r6("ari"), F.col("n_b").alias("n_comm_pred"), F.col("n_a").alias("n_comm_ref"))


@query("community_modularity")
def community_modularity(spark, sf_dir):
    m, labels, keys = _labelled_models(spark, sf_dir)
    return modularity(m.filter("kept").select(*keys, "i", "j"), labels, keys).select(*keys, r6("modularity"))


@query("spectral_network_ari")
def spectral_network_ari(spark, sf_dir):
    wide = segment_pairs(spark, sf_dir, constant=0.0)
    sides = F.explode(F.array(F.struct(F.lit("short").alias("model"), F.col("short").alias("r")), F.struct(F.lit("full").alias("model"), F.col("full").alias("r"))))
    edges = wide.select("subject_id", "i", "j", sides.alias("e")).select("subject_id", "i", "j", "e.*")
    keys = ["subject_id", "model"]
    diag = edge_nodes(edges, keys).select(*keys, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("r"))
    labels = spectral_channel_labels(pack_symmetric(edges.select(*keys, "i", "j", "r").unionByName(diag), keys, "r"), 4, keys)
    both = labels.groupBy("subject_id", "node").agg(*[F.max(F.when(F.col("model") == k, F.col("community"))).alias(k) for k in ("short", "full")])
    return agreement(both, "full", "short", ["subject_id"]).select("subject_id", r6("ari"))


@query(
    "topology_by_model",
    with_panel(*TRIPLET, TRIPLET_ROWS, """
M3 AS (SELECT subject_id, i, j, 'raw' AS model, coalesce(raw_short, 0) AS r FROM T3 UNION ALL SELECT subject_id, i, j, 'reference', reference FROM T3),
C3 AS (SELECT subject_id, model, quantile_cont(CAST(abs(r) AS DOUBLE), 0.75) AS cut FROM M3 GROUP BY 1, 2),
N3 AS (SELECT M3.*, abs(r) >= cut AS kept FROM M3 JOIN C3 USING (subject_id, model)),
D3 AS (SELECT subject_id, model, node, sum(CASE WHEN kept THEN 1 ELSE 0 END) AS k FROM (SELECT subject_id, model, i AS node, kept FROM N3 UNION ALL SELECT subject_id, model, j, kept FROM N3) GROUP BY 1, 2, 3)""")
    + f"SELECT subject_id, model, {q6('var_pop(k)', 'degree_variance')} FROM D3 GROUP BY 1, 2",
)
def topology_by_model(spark, sf_dir):
    rows = triplet(spark, sf_dir)
    kinds = F.explode(F.array(
        F.struct(F.lit("raw").alias("model"), F.coalesce("raw_short", F.lit(0.0)).alias("r")), F.struct(F.lit("reference").alias("model"), F.col("reference").alias("r"))
    ))
    long = rows.select("subject_id", "i", "j", kinds.alias("e")).select("subject_id", "i", "j", "e.*")
    out = degree_variance(mark_density(long, 0.25, ["subject_id", "model"]), ["subject_id", "model"])
    return out.select("subject_id", "model", r6("degree_variance"))


@query(
    "network_labels",
    """WITH P AS (SELECT p_partkey AS channel, 'set_' || p_brand || '_' || p_partkey AS label, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS b FROM part WHERE regexp_extract(p_brand, '(\\d+)', 1) <> '')
      SELECT channel, CAST(row_number() OVER (ORDER BY b, channel) - 1 AS INTEGER) AS position, coalesce(lag(b) OVER (ORDER BY b, channel) <> b, FALSE) AS boundary FROM P""",
)
def network_labels(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part").withColumn("label", F.concat(F.lit("set_"), "p_brand", F.lit("_"), F.col("p_partkey").cast("string")))
    number = F.coalesce(F.regexp_extract("network_name", r"(\d+)", 1).try_cast("bigint"), F.lit(0))
    brands = parts.select(F.col("p_brand").alias("network_name")).distinct()
    names = number_rows(brands, [], [number, "network_name"], number, "network").withColumn("network", F.col("network") - 1)
    labelled = parse_networks(parts.select(F.col("p_partkey").cast("int").alias("channel"), "label"), names)
    return network_order(labelled).select(F.col("channel").cast("bigint").alias("channel"), "position", "boundary")
