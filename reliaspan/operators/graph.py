"""Graph operators on edge tables keyed by subject.

``adj`` is (keys..., src, dst) with both directions and no self loops; ``nodes`` is (keys..., node).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.functions.hashing import HASH_RANGE, seeded_hash
from reliaspan.functions.reliability import as_col
from reliaspan.operators.connectivity import KEYS
from reliaspan.operators.kernels import scalar_kernel, small_world_kernel
from reliaspan.operators.ranking import number_rows
from reliaspan.session import ensure_checkpoint_dir, spread

#: Pairs of a network, all of its nodes with each other, up to which it is one row: 64 nodes.
PACKED_PAIRS = 64 * 63 // 2


def density_threshold(edges: DataFrame, density: float = 0.15, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep the edges with |r| at or above the (1 - density) quantile of the subject (ties kept)."""
    cut = edges.groupBy(*keys).agg(F.percentile(F.abs("r"), F.lit(1 - density)).alias("cut"))
    return edges.join(cut, list(keys)).filter(F.abs("r") >= F.col("cut")).drop("cut")


def absolute_threshold(edges: DataFrame, threshold: float = 0.2) -> DataFrame:
    return edges.filter(F.abs("r") > threshold)


def to_adjacency(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"))))
    return edges.select(*keys, both.alias("e")).select(*keys, "e.src", "e.dst")


def edge_nodes(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All channels of a subject, taken from its complete edge table."""
    return edges.select(*keys, F.explode(F.array("i", "j")).alias("node")).distinct()


def degrees(edges: DataFrame, kept: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node, degree) from a complete edge table with a keep flag; isolated nodes count 0."""
    ends = edges.select(*keys, kept.alias("k"), F.explode(F.array("i", "j")).alias("node"))
    return ends.groupBy(*keys, "node").agg(F.sum(F.when(F.col("k"), 1).otherwise(0)).alias("degree"))


def mark_density(edges: DataFrame, density: float = 0.15, keys: Sequence[str] = KEYS) -> DataFrame:
    """The complete edge table with a ``kept`` flag instead of a filter."""
    cut = edges.groupBy(*keys).agg(F.percentile(F.abs("r"), F.lit(1 - density)).alias("cut"))
    return edges.join(cut, list(keys)).withColumn("kept", F.abs("r") >= F.col("cut")).drop("cut")


def degree_variance(marked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return degrees(marked, F.col("kept"), keys).groupBy(*keys).agg(F.var_pop("degree").alias("degree_variance"))


def triangles(kept_edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node, triangles). Paths start at the smaller channel, so each triangle forms once."""
    keys = list(keys)
    e = kept_edges.select(*keys, "i", "j")
    ab = e.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"))
    bc = e.select(*keys, F.col("i").alias("b"), F.col("j").alias("c"))
    ac = e.select(*keys, F.col("i").alias("a"), F.col("j").alias("c"))
    closed = ab.join(bc, [*keys, "b"]).join(ac, [*keys, "a", "c"], "left_semi")
    return closed.select(*keys, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("triangles")
    )


def graph_metrics(marked: DataFrame, keys: Sequence[str] = KEYS, standard: bool = False) -> DataFrame:
    """Mean degree, density and mean clustering. The default clustering is triangles/(k(k-1)), half
    the usual coefficient, as the published results use it; ``standard`` doubles it."""
    keys = list(keys)
    deg = degrees(marked, F.col("kept"), keys)
    tri = triangles(marked.filter("kept"), keys)
    k = F.col("degree")
    local = F.coalesce(F.try_divide(F.coalesce("triangles", F.lit(0)) * (2.0 if standard else 1.0), k * (k - 1)), F.lit(0.0))
    n = F.count(F.lit(1))
    return deg.join(tri, [*keys, "node"], "left").groupBy(*keys).agg(
        F.avg(k).alias("mean_degree"),
        F.coalesce(F.try_divide(F.sum(k), n * (n - 1)), F.lit(0.0)).alias("density"),
        F.avg(local).alias("clustering"),
    )


def algebraic_connectivity(marked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Second smallest Laplacian eigenvalue; Spark builds each small Laplacian, NumPy decomposes it."""
    keys = list(keys)
    deg = degrees(marked, F.col("kept"), keys)
    cells = marked.select(*keys, "i", "j", F.when(F.col("kept"), -1.0).otherwise(0.0).alias("v")).unionByName(
        deg.select(*keys, F.col("node").alias("i"), F.col("node").alias("j"), F.col("degree").cast("double").alias("v"))
    )
    from reliaspan.operators.edges import pack_symmetric

    packed = pack_symmetric(cells, keys, "v")
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField("fiedler", T.DoubleType())])
    second = lambda m: np.linalg.eigvalsh(m)[1] if len(m) > 1 else 0.0
    return spread(packed, *keys).mapInArrow(scalar_kernel(keys, second, "fiedler"), schema)


def _cut(df: DataFrame) -> DataFrame:
    """Reliable lineage cut; the files go to the shared checkpoint folder and survive executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame) -> DataFrame:
    """The table as Parquet in the shared checkpoint folder, read again.

    Many steps that join a table with itself stay cheap to plan that way: a checkpoint hands equal
    keys and orders on to the next plan, where they double, a file does not, and its size is known.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(adj: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node, component): smallest reachable node id, by label propagation with pointer jumping.

    Runs until no label changes, so it needs no round limit; each round is two joins on (key, node).
    """
    keys = list(keys)
    labels = _cut(nodes.select(*keys, "node", F.col("node").alias("component")))
    adj = _cut(adj)
    while True:
        nb = adj.join(labels.withColumnRenamed("node", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(
            F.min("component").alias("best")
        )
        hop = labels.join(nb, [*keys, "node"], "left").select(
            *keys, "node", F.col("component").alias("old"), F.least("component", F.coalesce("best", "component")).alias("near")
        )
        jump = hop.select(*keys, F.col("node").alias("near"), F.col("near").alias("far"))
        new = _cut(hop.join(jump, [*keys, "near"]).select(*keys, "node", "old", F.least("near", "far").alias("component")))
        labels = new.drop("old")
        if new.filter("old <> component").isEmpty():
            return labels


def largest_component(components: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node) of the biggest component; equal sizes resolve to the smaller label."""
    keys = list(keys)
    size = components.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    best = size.groupBy(*keys).agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"), F.max("size").alias("size"))
    return components.join(best, [*keys, "component"]).select(*keys, "node", "size")


def mean_path_length(adj: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, path_length): mean hops over ordered reachable pairs, by frontier expansion."""
    keys = list(keys)
    adj = _cut(adj)
    seen = _cut(nodes.select(*keys, F.col("node").alias("root"), F.col("node").alias("node"), F.lit(0).alias("hops")))
    frontier, hops = seen, 0
    step = adj.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next"))
    while True:
        hops += 1
        reached = (
            frontier.join(step, [*keys, "node"]).select(*keys, "root", F.col("next").alias("node")).distinct()
            .join(seen, [*keys, "root", "node"], "left_anti")
            .withColumn("hops", F.lit(hops))
        )
        frontier = _cut(reached)
        if frontier.isEmpty():
            break
        seen = _cut(seen.unionByName(frontier))
    return seen.filter("root <> node").groupBy(*keys).agg(F.avg("hops").alias("path_length"))


def mean_clustering(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, clustering): mean standard coefficient; ``edges`` (i < j) are the kept ones only."""
    keys = list(keys)
    deg = edges.select(*keys, F.explode(F.array("i", "j")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("k"))
    tri = triangles(edges, keys)
    local = F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("k") * (F.col("k") - 1)), F.lit(0.0))
    return nodes.join(deg, [*keys, "node"], "left").join(tri, [*keys, "node"], "left").groupBy(*keys).agg(
        F.avg(local).alias("clustering"), F.count(F.lit(1)).alias("n_nodes")
    )


def small_worldness(marked: DataFrame, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_nodes, clustering, path_length, sigma): (C/C_rand)/(L/L_rand) on the largest component.

    One reference graph per network: a pair of its nodes is an edge if the pair's seeded uniform number
    is below the component's density; of that graph, too, the largest component counts. A reference without
    triangles or paths counts as equal. NULL below three nodes. Networks of at most PACKED_PAIRS pairs are
    a row each and measured in one pass; the larger ones are tables and advance together.
    """
    keys = list(keys)
    sized = _cut(marked.select(*keys, "i", "j", "kept"))
    sized = sized.join(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs")).hint("merge"), keys)
    small, large = sized.filter(F.col("_pairs") <= PACKED_PAIRS), sized.filter(F.col("_pairs") > PACKED_PAIRS).drop("_pairs")
    u = seeded_hash(*[F.col(k) for k in keys], seed, F.col("i"), F.col("j")) / HASH_RANGE
    pair = F.collect_list(F.struct("i", "j", F.coalesce("kept", F.lit(False)).alias("kept"), u.alias("u")))
    packed = small.groupBy(*keys).agg(pair.alias("_pair")).select(*keys, *[F.col(f"_pair.{c}").alias(c) for c in ("i", "j", "kept", "u")])
    fields = [packed.schema[k] for k in keys] + [T.StructField("n_nodes", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("clustering", "path_length", "sigma")]
    out = packed.mapInArrow(small_world_kernel(keys), T.StructType(fields))
    return out if large.isEmpty() else out.unionByName(_small_worldness_tables(large, seed, keys))


def _small_worldness_tables(marked: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """small_worldness of networks of any size. Paths of both graphs of all networks are found by one frontier search."""
    keys, graph = list(keys), [*keys, "graph"]
    marked = _cut(marked)
    nodes = edge_nodes(marked, keys)
    kept = marked.filter("kept").select(*keys, "i", "j")
    main = _cut(largest_component(connected_components(to_adjacency(kept, keys), nodes, keys), keys))
    enough = main.filter("size >= 3").select(*keys, "node")
    inside = kept.join(enough.withColumnRenamed("node", "i"), [*keys, "i"], "left_semi")
    n = F.col("_n")
    density = enough.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_e")), keys)
    density = density.select(*keys, (2 * F.col("_e") / (n * (n - 1))).alias("_d"))
    u = seeded_hash(*[F.col(k) for k in keys], seed, F.col("i"), F.col("j")) / HASH_RANGE
    pairs = marked.select(*keys, "i", "j").join(enough.withColumnRenamed("node", "i"), [*keys, "i"], "left_semi").join(enough.withColumnRenamed("node", "j"), [*keys, "j"], "left_semi")
    drawn = _cut(pairs.join(density, keys).filter(u < F.col("_d")).select(*keys, "i", "j"))
    part = largest_component(connected_components(to_adjacency(drawn, keys), enough, keys), keys).select(*keys, "node")
    tag = lambda df, name: df.withColumn("graph", F.lit(name))
    both_nodes = _cut(tag(enough, "real").unionByName(tag(part, "random")))
    both = _cut(tag(inside, "real").unionByName(tag(drawn, "random").join(both_nodes.withColumnRenamed("node", "i"), [*graph, "i"], "left_semi")))
    cluster = mean_clustering(both, both_nodes, graph)
    measured = cluster.join(mean_path_length(to_adjacency(both, graph), both_nodes, graph), graph, "left").select(*graph, "clustering", F.coalesce("path_length", F.lit(0.0)).alias("path_length"))
    side = lambda g, c: F.max(F.when(F.col("graph") == g, F.col(c)))
    wide = measured.groupBy(*keys).agg(side("real", "clustering").alias("clustering"), side("real", "path_length").alias("path_length"), side("random", "clustering").alias("_c"), side("random", "path_length").alias("_l"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    wide = wide.withColumn("sigma", F.try_divide(ratio("clustering", "_c"), ratio("path_length", "_l"))).drop("_c", "_l")
    sizes = main.groupBy(*keys).agg(F.max("size").cast("int").alias("n_nodes"))
    return sizes.join(wide, keys, "left").select(*keys, "n_nodes", "clustering", "path_length", "sigma")


def modularity(kept: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, modularity) of a labelling of an unweighted graph."""
    keys = list(keys)
    adj = to_adjacency(kept, keys)
    lab = lambda side: labels.select(*keys, F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
    ends = adj.join(lab("src"), [*keys, "src"]).join(lab("dst"), [*keys, "dst"])
    per = ends.groupBy(*keys, F.col("c_src").alias("community")).agg(
        F.count(F.lit(1)).alias("tot"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), 1).otherwise(0)).alias("inside")
    )
    m2 = F.sum("tot").over(Window.partitionBy(*keys))
    return per.withColumn("m2", m2).groupBy(*keys).agg(
        F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), F.lit(2))).alias("modularity")
    )


def communities(marked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node, community) by Louvain on the kept edges of each network; communities are numbered from 0 by their smallest node.

    All networks move together. A step takes, for each node, the community of greatest gain (the smallest
    id among equals), and of these moves those that are the best, then the smallest node, among all that touch
    their source or their target. Such moves share no community, so their gains add up exactly and modularity only
    rises; when none is left, communities become the nodes of the next level. Every step is written to the
    checkpoint folder. Edges count equally, nodes without edges stay alone.
    """
    keys = list(keys)
    base = _written(to_adjacency(marked.filter("kept"), keys).withColumn("w", F.lit(1.0)))
    member = _written(edge_nodes(marked, keys).select(*keys, "node", F.col("node").alias("community")))
    while (placed := _local_moves(base, keys, member)) is not None:
        member, graph = _renamed(member, placed, keys, "node"), _merged(base, placed, keys)
        while (placed := _local_moves(graph, keys)) is not None:
            member, graph = _renamed(member, placed, keys, "community"), _merged(graph, placed, keys)
    first = member.groupBy(*keys, "community").agg(F.min("node").alias("_first"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")) - 1  # no more rows than communities of a network
    first = first.withColumn("_number", number.cast("int"))
    return _beside(member, first, [*keys, "community"]).select(*keys, "node", F.col("_number").alias("community"))


def _beside(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join whose sides meet in the tasks. Written tables look small, and a broadcast of one in each of many steps adds up on the driver."""
    return left.join(right.hint("merge"), list(on), how)


def _renamed(member: DataFrame, placed: DataFrame, keys: list[str], by: str) -> DataFrame:
    """member with the communities that `placed` gives to its column `by`; others stay."""
    new = placed.select(*keys, F.col("node").alias(by), F.col("community").alias("_c"))
    return _written(_beside(member, new, [*keys, by], "left").select(*keys, "node", F.coalesce("_c", "community").alias("community")))


def _merged(graph: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """The graph whose nodes are the communities of another."""
    label = lambda side: placed.select(*keys, F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
    ends = _beside(_beside(graph, label("src"), [*keys, "src"]), label("dst"), [*keys, "dst"])
    return _written(ends.groupBy(*keys, F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")))


def _local_moves(graph: DataFrame, keys: list[str], member: DataFrame | None = None) -> DataFrame | None:
    """(keys, node, community) after moving single nodes while modularity rises; None if no node moves.

    `graph` is (keys, src, dst, w) in both directions, loops count in a node's strength. The moves begin
    with the communities of `member`, or with each node alone.
    """
    strength = _written(graph.groupBy(*keys, F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    total = strength.groupBy(*keys).agg(F.sum("k").alias("m2"))
    placed = _beside(strength, total, keys)
    placed = placed.withColumn("community", F.col("node")) if member is None else _beside(placed, member, [*keys, "node"])
    placed = _written(placed.select(*keys, "node", "k", "m2", "community"))
    steps = graph.filter("src <> dst")
    moved = False
    while True:
        load = placed.groupBy(*keys, "community").agg(F.sum("k").alias("load"))
        near = _beside(steps, placed.select(*keys, F.col("node").alias("dst"), "community"), [*keys, "dst"]).select(*keys, F.col("src").alias("node"), "community", "w")
        near = near.unionByName(placed.select(*keys, "node", "community", F.lit(0.0).alias("w")))
        links = _beside(near.groupBy(*keys, "node", "community").agg(F.sum("w").alias("links")), load, [*keys, "community"])
        own = placed.select(*keys, "node", "k", "m2", F.col("community").alias("own"))
        at_home = F.col("community") == F.col("own")
        gain = F.col("links") - F.col("k") * (F.col("load") - F.when(at_home, F.col("k")).otherwise(0.0)) / F.col("m2")
        options = _beside(links, own, [*keys, "node"]).withColumn("gain", F.round(gain, 9))
        best = options.groupBy(*keys, "node").agg(
            F.max(F.struct("gain", (-F.col("community")).alias("_c"))).alias("b"), F.max(F.when(at_home, F.col("gain"))).alias("now"), F.max("own").alias("own")
        )
        wish = best.filter(F.col("b.gain") > F.col("now")).select(*keys, "node", F.col("own").alias("from"), (-F.col("b._c")).alias("to"), F.struct((F.col("b.gain") - F.col("now")).alias("rise"), (-F.col("node")).alias("_n")).alias("rank"))
        wish = _written(wish)
        if wish.isEmpty():
            return placed if moved else None
        moved = True
        touched = wish.select(*keys, F.explode(F.array("from", "to")).alias("c"), "rank").groupBy(*keys, "c").agg(F.max("rank").alias("top"))
        side = lambda c: touched.select(*keys, F.col("c").alias(c), F.col("top").alias(f"top_{c}"))
        chosen = _beside(_beside(wish, side("from"), [*keys, "from"]), side("to"), [*keys, "to"]).filter((F.col("rank") == F.col("top_from")) & (F.col("rank") == F.col("top_to")))
        placed = _written(_beside(placed, chosen.select(*keys, "node", "to"), [*keys, "node"], "left").select(*keys, "node", "k", "m2", F.coalesce("to", "community").alias("community")))


def best_jaccard(reference: DataFrame, predicted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, community, jaccard): best overlap of each reference set with any predicted one.

    ``reference`` is (node, community) or (keys, node, community); ``predicted`` is keyed. Counts of
    the contingency table are enough, no sets are built.
    """
    keys = list(keys)
    ref_keys = [k for k in keys if k in reference.columns]
    both = predicted.withColumnRenamed("community", "pred").join(reference, [*ref_keys, "node"])
    cell = both.groupBy(*keys, "community", "pred").agg(F.count(F.lit(1)).alias("inter"))
    a = F.sum("inter").over(Window.partitionBy(*keys, "community"))
    b = F.sum("inter").over(Window.partitionBy(*keys, "pred"))
    return cell.withColumn("a", a).withColumn("b", b).groupBy(*keys, "community").agg(
        F.max(F.col("inter") / (F.col("a") + F.col("b") - F.col("inter"))).alias("jaccard")
    )


def block_assignment(node, n_nodes, n_networks: int = 7) -> Column:
    """Even block of a node; the last block absorbs the remainder."""
    size = F.floor(as_col(n_nodes) / n_networks)
    return F.least(F.floor(as_col(node) / size), F.lit(n_networks - 1)).cast("int")


def parse_networks(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(channel, label) -> adds the network of `names(network_name, network)` that the label text names, and its number.

    A name stands between two underscores or an underscore and the end; it may hold underscores itself. The stretches
    of a label that could be a name are joined with the names, so any number of names will do; the first place
    counts, there the smallest number. Channels are distinct; labels without a known name, NULL ones too, have NULLs.
    """
    parts = F.split("label", "_")
    stretches = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda a: F.transform(
        F.sequence(a, F.size("_parts") - 1), lambda b: F.struct(a.alias("at"), F.array_join(F.slice("_parts", a + 1, b - a + 1), "_").alias("network_name")))))
    spans = labels.select("channel", parts.alias("_parts")).filter(F.size("_parts") > 1).select("channel", F.inline(stretches))
    found = spans.join(names, "network_name").groupBy("channel").agg(F.min(F.struct("at", "network", "network_name")).alias("_best"))
    return labels.join(found, "channel", "left").select(*labels.columns, F.col("_best.network_name").alias("network_name"), F.col("_best.network").cast("int").alias("network"))


def network_order(labelled: DataFrame) -> DataFrame:
    """Display position of every channel, sorted by (network, channel), with a flag at network
    boundaries. Ranked in blocks of channel ids, so a big network is not sorted in one task."""
    bucket = F.col("network").cast("bigint") * (1 << 32) + F.floor(F.col("channel") / 4096)
    ranked = number_rows(labelled.filter("network IS NOT NULL"), [], ["network", "channel"], bucket).withColumn(
        "position", (F.col("rn") - 1).cast("int")
    ).drop("rn")
    firsts = ranked.groupBy("network").agg(F.min("position").alias("_first"))
    return ranked.join(firsts, "network").withColumn(
        "boundary", (F.col("position") == F.col("_first")) & (F.col("position") > 0)
    ).drop("_first")
