"""Connected components by alternating stars (large-star, small-star) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliaspan.session import materialise


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on canonical edges (v < u).

    Large: the greater neighbours of u move to the smallest of u and its neighbours. Small: u and its
    smaller neighbours move to the smallest of them. The minima are written before they are joined
    back, so both join inputs are plain shuffles and a node with very many edges can be split.
    """
    side = materialise(_mirrored(edges)) if large else edges
    low = materialise(side.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = side.join(low, "u")
    if large:
        new = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return materialise(new.filter("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(u, v)` with an edge; the component is its smallest node.

    NULL ends and loops are ignored; no edges give no rows. Runs until the edges no longer change, in
    O(log^2 n) rounds; every round's edges are written to the checkpoint folder, so a lost executor
    costs one round at most. No node's neighbours are gathered in one task.
    """
    edges = materialise(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFFFF))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
