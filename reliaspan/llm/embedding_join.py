"""Embedding near-duplicates by an epsilon grid order join.

Vectors of length one with cosine >= t are within epsilon = sqrt(2 (1 - t)) of each other, also after
projection. The vectors are projected to the leading principal directions, sorted by the cells of a
grid of that width, and cut into blocks, each with the box of its coordinates. Intervals of that
sequence are joined recursively: a pair of intervals whose boxes are farther apart than epsilon is
skipped with all below it, others are replaced by pairs of their parts, down to pairs of range partitions.
Their blocks meet where they are stored, if their boxes do, and are compared in double precision; no block is
shuffled for a pair.

Equal vectors are one class and compared once. A task adds up, for each vector, the number of links, and
keeps one edge to the smallest vector that it is connected with: all pairs of a dense group are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.llm.common import sum_matrices
from reliaspan.llm.components import components
from reliaspan.operators.blocks import group_count
from reliaspan.session import materialise

#: Leading directions of the grid, vectors of a block, parts of an interval.
DIRECTIONS, BLOCK, PARTS = 6, 512, 8
#: Widening of distances for rounding.
SLACK = 1e-7
#: Links that a task holds besides one for each vector.
HELD = 1 << 20

BLOCKS = "block long, dims int, ids array<long>, copies array<long>, vectors binary, " + ", ".join(f"low{k} double, high{k} double" for k in range(DIRECTIONS))


def _valid(v: Column) -> Column:
    """Whether a vector can link at all: no NULL, no non-finite component, not empty, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.asarray(rows, float)
    top = np.abs(x).max(axis=1, keepdims=True)  # before squaring, so that tiny and huge vectors keep their length
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(classes: DataFrame, dims: int) -> np.ndarray:
    """The leading principal directions (dims x DIRECTIONS), from sums over all classes; shorter vectors count as padded."""

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for b in batches:
            by_size: dict[int, list] = {}
            for v in b.column(0).to_pylist():
                by_size.setdefault(len(v), []).append(v)
            for n, rows in by_size.items():
                x = _unit(rows)
                total[:n, :n] += x.T @ x
                total[dims, :n] += x.sum(0)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    total = sum_matrices(classes.select("vector").mapInArrow(second, "part binary"), "part", (dims + 1) * dims).reshape(dims + 1, dims)
    n = max(1.0, np.trace(total[:dims]))
    mean = total[dims] / n
    _, vectors = np.linalg.eigh(total[:dims] / n - np.outer(mean, mean))
    out = np.zeros((dims, DIRECTIONS))
    k = min(dims, DIRECTIONS)
    out[:, :k] = vectors[:, ::-1][:, :k]
    return out


def _blocks(classes: DataFrame, directions: np.ndarray, eps: float, most: int) -> DataFrame:
    """Rows of BLOCKS: the classes in grid order, up to `most` of them each, of one length."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(directions)
    fields = ", ".join(f"p{k} double, cell{k} long" for k in range(DIRECTIONS))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2).to_pylist()
            p = np.zeros((len(vectors), DIRECTIONS))
            sizes = np.array([len(v) for v in vectors])
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                p[at] = _unit([vectors[i] for i in at]) @ shared.value[:n]
            cells = np.floor(p / eps).astype(np.int64)
            columns = [x for k in range(DIRECTIONS) for x in (pa.array(p[:, k]), pa.array(cells[:, k]))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int32()), *columns], [*b.schema.names, "dims", *[x for k in range(DIRECTIONS) for x in (f"p{k}", f"cell{k}")]])

    placed = classes.select("node", "copies", "vector").mapInArrow(project, f"node long, copies long, vector array<double>, dims int, {fields}")
    order = ["dims", *(f"cell{k}" for k in range(DIRECTIONS)), "node"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sequence = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            p = np.array([[r[4 + 2 * k] for k in range(DIRECTIONS)] for r in held])
            row = {
                "block": held[0][-1] << 32 | number, "dims": held[0][3], "ids": [r[0] for r in held], "copies": [r[1] for r in held],
                "vectors": _unit([r[2] for r in held]).tobytes(),
            }
            for k in range(DIRECTIONS):
                row |= {f"low{k}": float(p[:, k].min()), f"high{k}": float(p[:, k].max())}
            number += 1
            held.clear()
            schema = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("vectors", pa.binary()), *[x for k in range(DIRECTIONS) for x in ((f"low{k}", pa.float64()), (f"high{k}", pa.float64()))]])
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == most or held[0][3] != r[3]):
                    yield block()
                held.append(r)
        if held:
            yield block()

    return materialise(sequence.mapInArrow(pack, BLOCKS))


def _box() -> list[Column]:
    return [F.min(f"low{k}").alias(f"low{k}") for k in range(DIRECTIONS)] + [F.max(f"high{k}").alias(f"high{k}") for k in range(DIRECTIONS)]


def _near(a: str, b: str, eps: float) -> Column:
    """Whether the boxes of two intervals come within eps, and their vectors may be of one length."""
    square = F.lit(0.0)
    for k in range(DIRECTIONS):
        gap = F.greatest(F.lit(0.0), F.col(f"{a}.low{k}") - F.col(f"{b}.high{k}"), F.col(f"{b}.low{k}") - F.col(f"{a}.high{k}"))
        square = square + gap * gap
    return (square <= (eps + SLACK) ** 2) & (F.col(f"{a}.dims_low") <= F.col(f"{b}.dims_high")) & (F.col(f"{b}.dims_low") <= F.col(f"{a}.dims_high"))


def interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(left, right), left <= right: the pairs of range partitions that the recursive interval join leaves.

    Intervals are runs of PARTS^level range partitions.
    """
    boxes = [f"{x}{k}" for x in ("low", "high") for k in range(DIRECTIONS)]
    level = blocks.select(F.shiftright("block", 32).alias("parent"), F.col("dims").alias("dims_low"), F.col("dims").alias("dims_high"), *boxes)
    levels = []
    last = (blocks.agg(F.max("block")).first()[0] or 0) >> 32
    while True:
        level = level.groupBy(F.col("parent").alias("id")).agg(F.min("dims_low").alias("dims_low"), F.max("dims_high").alias("dims_high"), *_box()).withColumn("parent", F.expr(f"id div {PARTS}"))
        levels.append(materialise(level))
        if not last:
            break
        last //= PARTS
    pairs = levels[-1].select(F.col("id").alias("left"), F.col("id").alias("right"))
    for level in levels[-2::-1]:
        a, b = level.alias("a"), level.alias("b")
        halves = pairs.join(a, F.col("left") == F.col("a.parent"))
        pairs = materialise(
            halves.join(b, (F.col("right") == F.col("b.parent")) & (F.col("a.id") <= F.col("b.id")) & _near("a", "b", eps)).select(F.col("a.id").alias("left"), F.col("b.id").alias("right"))
        )
    return pairs


def _meeting(blocks: DataFrame, eps: float, rows: int) -> DataFrame:
    """The pairs of blocks, left <= right, whose boxes meet, side by side: ids, copies and vectors of both.

    Left blocks know the range partitions that theirs has to meet. The right ones are read in groups that a task can hold.
    """
    spark = blocks.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    partners = interval_pairs(blocks, eps).groupBy("left").agg(F.collect_set("right").alias("partners"))
    dealt = blocks.withColumn("part", F.shiftright("block", 32)).repartition(n, "part").join(partners.hint("merge"), F.col("part") == F.col("left")).drop("left")
    stored = materialise(dealt.withColumns({"dims_low": F.col("dims"), "dims_high": F.col("dims")}))
    right = stored.drop("partners").coalesce(group_count(rows)).hint("shuffle_replicate_nl").alias("b")  # not to become a broadcast
    met = _near("a", "b", eps) & (F.col("a.block") <= F.col("b.block")) & F.array_contains("a.partners", F.col("b.part"))
    columns = [F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("block", "ids", "copies", "vectors")]
    return stored.alias("a").join(right, met).select(F.col("a.dims").alias("dims"), *columns)


def _connect(mask: np.ndarray) -> np.ndarray:
    """For each row, then each column, of a boolean matrix: the smallest row in its connected part, -1 without a link."""
    rows = np.where(mask.any(1), np.arange(len(mask)), -1)
    columns = np.full(mask.shape[1], -1)
    big = len(mask)
    while True:
        at = np.where(mask, rows[:, None], big).min(0)
        columns = np.where(at == big, -1, at)
        new = np.where(mask, columns[None, :], big).min(1)
        new = np.where(new == big, -1, np.minimum(rows, new))
        if (new == rows).all():
            return np.concatenate([rows, columns])
        rows = new


def _merged(node: np.ndarray, links: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each node: its links added up, and the smallest node that it is connected with."""
    names, at = np.unique(np.concatenate([node, to]), return_inverse=True)
    i, j = at[: len(node)], at[len(node) :]
    least = np.arange(len(names))
    while True:
        old = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if (least == old).all():
            break
    total = np.bincount(i, links, len(names)).astype(np.int64)
    return names, total, names[least]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = kept = 0
    for b in batches:
        for r in range(b.num_rows):
            row = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
            dims = row["dims"].as_py()
            (a, copies_a, x), (c, copies_b, y) = (
                (row[f"ids_{s}"].values.to_numpy(), row[f"copies_{s}"].values.to_numpy(), np.frombuffer(row[f"vectors_{s}"].as_buffer()).reshape(-1, dims)) for s in "ab"
            )
            mask = x @ y.T >= threshold
            same = row["block_a"].as_py() == row["block_b"].as_py()
            if same:
                np.fill_diagonal(mask, False)
            if not mask.any():
                continue
            links = [mask @ copies_b, *([] if same else [copies_a @ mask])]
            nodes = a if same else np.concatenate([a, c])
            links = np.concatenate(links)
            if same:  # each vector as a row and as a column is one node
                np.fill_diagonal(mask, mask.any(1))
            part = _connect(mask)[: len(nodes)]
            hit = np.flatnonzero(links)
            held.append((nodes[hit], links[hit].astype(np.int64), a[part[hit]]))
            size += len(hit)
            if size > HELD + 2 * kept:
                held = [_merged(*map(np.concatenate, zip(*held, strict=True)))]
                size = kept = len(held[0][0])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in _merged(*map(np.concatenate, zip(*held, strict=True)))], ["node", "links", "to"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    n_links counts the other rows with cosine >= threshold, component_id is the smallest id reachable
    by links, kept whether it is the row's own. Vectors that are NULL, empty, zero, or hold a NULL or
    non-finite component link with nothing, nor do vectors of different lengths. Repeated rows link with
    each other. NULL ids count as rows; a part that has only such has component NULL and is kept.
    """
    eps = math.sqrt(max(0.0, 2 * (1 - threshold)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("valid", _valid(F.col("vector")))
    grouped = rows.filter("valid").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()))
    dims = classes.agg(F.max(F.size("vector"))).first()[0]
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    blocks = _blocks(classes, _directions(classes, dims), max(eps, 1e-6), block)
    work = _meeting(blocks, eps, classes.count())
    found = materialise(work.mapInArrow(lambda batches: _compare(batches, threshold), "node long, links long, to long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    named = classes.select("vector", "copies", "first_id", "node").join(counts, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = materialise(named.select("vector", "part", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    ids = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = materialise(named.join(ids, "part").select(F.col("vector").alias("of"), "n_links", "component_id"))
    linked = rows.filter("valid").join(named, F.col("vector") == F.col("of")).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
