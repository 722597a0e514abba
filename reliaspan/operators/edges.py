"""Operators on edge tables: group means, network blocks, projections, partial and tangent forms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.functions.reliability import as_col, clip, fisher_z
from reliaspan.operators.connectivity import KEYS, moment_corr, pair_moments, pearson_from_moments, shrunk_pairs
from reliaspan.operators.kernels import matrix_kernel, partial_corr
from reliaspan.operators.sums import add_up
from reliaspan.session import spread


def pack_symmetric(pairs: DataFrame, keys: Sequence[str] = KEYS, value: str = "c") -> DataFrame:
    """One row per key: sorted channel ids and the upper triangle (with diagonal) of its matrix."""
    cell = F.array_sort(F.collect_list(F.struct("i", "j", F.col(value).alias("v"))))
    return pairs.groupBy(*keys).agg(cell.alias("cells")).select(
        *keys,
        F.transform(F.filter("cells", lambda e: e["i"] == e["j"]), lambda e: e["i"]).alias("channels"),
        F.transform("cells", lambda e: e["v"]).alias("packed"),
    )


def map_matrices(packed: DataFrame, fn, keys: Sequence[str] = KEYS, diagonal: bool = False, argument: str | None = None) -> DataFrame:
    """Apply a p x p -> p x p function to every key's matrix; one small matrix per call. ``argument`` names a key
    whose value the function gets too."""
    fields = [packed.schema[k] for k in keys]
    fields += [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("r", T.DoubleType())]
    return spread(packed.select(*keys, "channels", "packed"), *keys).mapInArrow(matrix_kernel(list(keys), fn, diagonal, argument), T.StructType(fields))


def partial_edges(frames: DataFrame, keys: Sequence[str] = KEYS, shrink: bool = True) -> DataFrame:
    """Partial correlations from the inverse of the shrunk covariance, or the pseudo-inverse of the
    plain correlation. The moments are distributed; only a p x p inverse runs in Python."""
    if shrink:
        packed = pack_symmetric(shrunk_pairs(pair_moments(frames, keys, norm=True), keys), keys)
        return map_matrices(packed, partial_corr, keys)
    edges = pearson_from_moments(pair_moments(frames, keys), keys, constant=0.0)
    ones = edges.select(*keys, F.explode(F.array("i", "j")).alias("i")).distinct()
    cells = edges.unionByName(ones.select(*keys, "i", F.col("i").alias("j"), F.lit(1.0).alias("r")))
    return map_matrices(pack_symmetric(cells, keys, "r"), lambda m: partial_corr(m, pseudo=True), keys)


def shrunk_covariances(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Packed shrunk covariances, the tangent input. Standardise the frames first (PREP z-score)."""
    return pack_symmetric(shrunk_pairs(pair_moments(frames, keys, norm=True), keys), keys)


def tangent_edges(
    covariances: DataFrame, train: DataFrame, keys: Sequence[str] = KEYS, max_iter: int = 100, tol: float = 1e-7
) -> DataFrame:
    """Tangent-space connectivity around the geometric mean of the training covariances.

    ``covariances`` is (keys, channels, packed) and read once per iteration, so pass a checkpointed
    table. Only the p x p mean of the whitened logarithms reaches the driver, never a subject. Raises
    RuntimeError where the mean has not settled within ``tol`` after ``max_iter`` rounds.
    """
    fit = covariances.join(train.select(*keys).distinct(), list(keys), "left_semi")
    start = _mean_matrix(map_matrices(fit, lambda m: m, keys, diagonal=True))
    mean = start
    previous, step = np.inf, 1.0
    for _ in range(max_iter):
        inv_root = _eig_map(mean, lambda v: 1 / np.sqrt(v))
        root = _eig_map(mean, np.sqrt)
        logs = _mean_matrix(map_matrices(fit, _whitened_log(inv_root), keys, diagonal=True))
        norm = float(np.linalg.norm(logs))
        mean = root @ _eig_map(step * logs, np.exp) @ root
        if norm < tol * len(mean):
            break
        step, previous = (step / 2 if norm > previous else step), norm
    else:
        raise RuntimeError(f"the mean has not settled: norm {norm:g} after {max_iter} rounds")
    whiten = _eig_map(mean, lambda v: 1 / np.sqrt(v))
    return map_matrices(covariances, _whitened_log(whiten), keys)


#: Matrix cells that a task holds at once while it adds up logarithms.
HELD_CELLS = 1 << 21


def tangent_fold_edges(
    covariances: DataFrame, folds: DataFrame, key: str = "subject_id", held_only: bool = True, max_iter: int = 100, tol: float = 1e-7
) -> DataFrame:
    """(fold, key, i, j, r, held): tangent edges around the geometric mean of each fold's training side.

    `covariances` is (key, channels, packed), read once per round, so pass a checkpointed table; `folds` is
    (key, fold), one row per subject. All folds advance in one aggregation, a settled one drops out. A held-out
    subject is seen from its own fold's mean, which it had no part in; with `held_only` false the training subjects
    of each fold follow, held false. Subjects without a fold have no rows, a fold without training subjects none either.
    The driver sees one p x p matrix a fold. ValueError where the channels differ; RuntimeError where a mean has not settled.
    """
    spark = covariances.sparkSession
    numbers = [r[0] for r in folds.select("fold").where("fold IS NOT NULL").distinct().orderBy("fold").collect()]
    if covariances.select("channels").distinct().limit(2).count() > 1:
        raise ValueError("the channels differ between subjects")
    split = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(len(numbers), 1) - 1).cast("long")))
    own = F.array_position(F.array(*[F.lit(f) for f in numbers]), F.col("fold")) - 1
    rows = covariances.join(folds.select(key, "fold").where("fold IS NOT NULL"), key).select(key, "channels", "packed", own.alias("own"), split.alias("split"))
    train = rows.filter("own <> split")

    def summed(active: list[int], roots: list[np.ndarray | None]) -> dict[int, np.ndarray]:
        shared = spark.sparkContext.broadcast(roots)

        def part(s, packed):
            w = shared.value[s]
            cells = packed.flatten().to_numpy(zero_copy_only=False).reshape(len(packed), -1)
            p = int((2 * cells.shape[1]) ** 0.5)
            a, b = np.triu_indices(p)
            out, at = np.zeros((p, p)), max(1, HELD_CELLS // (p * p))
            for first in range(0, len(cells), at):
                m = np.zeros((len(cells[first : first + at]), p, p))
                m[:, a, b] = m[:, b, a] = cells[first : first + at]
                if w is not None:
                    values, vectors = np.linalg.eigh(w @ m @ w)
                    m = (vectors * np.log(np.maximum(values, 1e-300))[:, None, :]) @ vectors.transpose(0, 2, 1)
                out += m.sum(0)
            return [out, np.array([len(cells)], float)]

        found = add_up(train.filter(F.col("split").isin(active)), ["packed"], part, ["total", "n"]).collect()
        totals = {r["split"]: np.frombuffer(r["total"]) / np.frombuffer(r["n"])[0] for r in found}
        return {s: t.reshape(int(len(t) ** 0.5), -1) for s, t in totals.items()}

    means: list[np.ndarray | None] = [None] * len(numbers)
    for s, m in (summed(list(range(len(numbers))), means) if numbers else {}).items():
        means[s] = m
    active = [s for s, m in enumerate(means) if m is not None]
    step, previous = [1.0] * len(means), [np.inf] * len(means)
    for _ in range(max_iter):
        if not active:
            break
        logs = summed(active, [_eig_map(m, lambda v: 1 / np.sqrt(v)) if s in active else None for s, m in enumerate(means)])
        for s, log in logs.items():
            root, norm = _eig_map(means[s], np.sqrt), float(np.linalg.norm(log))
            means[s] = root @ _eig_map(step[s] * log, np.exp) @ root
            if norm < tol * len(log):
                active.remove(s)
            elif norm > previous[s]:
                step[s] /= 2
            else:
                previous[s] = norm
    if active:
        raise RuntimeError(f"the means of folds {[numbers[s] for s in active]} have not settled after {max_iter} rounds")
    shared = spark.sparkContext.broadcast([None if m is None else _eig_map(m, lambda v: 1 / np.sqrt(v)) for m in means])
    wanted = rows.filter(F.col("split").isin([s for s, m in enumerate(means) if m is not None]) & (F.col("own") == F.col("split") if held_only else F.lit(True)))
    edges = map_matrices(wanted, lambda m, s: _whitened_log(shared.value[s])(m), [key, "own", "split"], argument="split")
    of = F.element_at(F.array(*[F.lit(f) for f in numbers]), F.col("split").cast("int") + 1) if numbers else F.lit(None)
    return edges.select(of.alias("fold"), key, "i", "j", "r", (F.col("own") == F.col("split")).alias("held"))


def _eig_map(m: np.ndarray, fn) -> np.ndarray:
    vals, vecs = np.linalg.eigh((m + m.T) / 2)
    return (vecs * fn(vals)) @ vecs.T


def _whitened_log(w: np.ndarray):
    def apply(m: np.ndarray) -> np.ndarray:
        vals, vecs = np.linalg.eigh(w @ m @ w)
        return (vecs * np.log(np.maximum(vals, 1e-300))) @ vecs.T

    return apply


def _mean_matrix(cells: DataFrame) -> np.ndarray:
    """Element-wise mean over subjects; the result is p(p+1)/2 numbers."""
    rows = cells.groupBy("i", "j").agg(F.avg("r").alias("r")).collect()
    ids = sorted({r["i"] for r in rows})
    at = {c: k for k, c in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in rows:
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["r"]
    return out


def group_mean_edges(edges: DataFrame, group: str = "grp", extra: Sequence[str] = (), min_subjects: int = 3) -> DataFrame:
    """Mean edge per group and overall (NULL group) in one grouping-sets aggregation."""
    sets = [[*extra, group, "i", "j"], [*extra, "i", "j"]]
    out = edges.groupingSets(sets, *extra, group, "i", "j").agg(
        F.grouping(group).alias("overall"), F.count(F.lit(1)).alias("n_subjects"), F.avg("r").alias("r")
    )
    return out.filter(F.col("n_subjects") >= min_subjects)


def network_blocks(edges: DataFrame, networks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean edge inside and between networks; ``networks`` (channel, network) is one row per channel."""
    a = networks.select(F.col("channel").alias("i"), F.col("network").alias("na"))
    b = networks.select(F.col("channel").alias("j"), F.col("network").alias("nb"))
    return (
        edges.join(a, "i")
        .join(b, "j")
        .groupBy(*keys, F.least("na", "nb").alias("network_i"), F.greatest("na", "nb").alias("network_j"))
        .agg(F.avg("r").alias("mean_fc"), F.count(F.lit(1)).alias("n_edges"))
        .withColumn("pair_type", F.when(F.col("network_i") == F.col("network_j"), "within").otherwise("between"))
    )


def hemisphere_networks(networks: DataFrame, coords: DataFrame) -> DataFrame:
    """Composite node 2 * network + (x > 0), per channel."""
    return networks.join(coords, "channel").select(
        "channel", (F.col("network") * 2 + F.when(F.col("x") > 0, 1).otherwise(0)).alias("network"), "x", "y", "z"
    )


def centroids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("network").agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")])


def keep_strongest(blocks: DataFrame, keep_share: float, keys: Sequence[str] = KEYS, value: str = "mean_fc") -> DataFrame:
    """Zero the off-diagonal blocks below the (1 - keep_share) percentile of their absolute values."""
    off = F.col("network_i") != F.col("network_j")
    cut = blocks.groupBy(*keys).agg(
        F.percentile(F.when(off, F.abs(value)), F.lit(1 - keep_share)).alias("cut")
    )
    return blocks.join(cut, list(keys)).withColumn(
        value, F.when(F.abs(value) < F.col("cut"), 0.0).otherwise(F.col(value))
    )


def projections(r="r", rho="rho_hat_t", raw="r_raw") -> dict[str, Column]:
    """Ways to project a subject's scalar estimate back onto its edges.

    ``ratio``: r * rho/max(r_raw, .01), clipped; ``z_ratio``: tanh(z * clip(rho/max(r_raw, .01), .5, 2));
    ``z_capped``: tanh(z * min(rho/r_raw, 1.5)); ``z_shift``: tanh(z + atanh(rho) - atanh(r_raw)).
    """
    r, rho, raw = as_col(r), as_col(rho), as_col(raw)
    safe = F.greatest(raw, F.lit(0.01))
    return {
        "ratio": clip(r * (rho / safe), -1, 1),
        "z_ratio": F.tanh(fisher_z(r) * clip(rho / safe, 0.5, 2.0)),
        "z_capped": F.tanh(fisher_z(r) * F.least(F.try_divide(rho, raw), F.lit(1.5))),
        "z_shift": F.tanh(fisher_z(r) + fisher_z(rho) - fisher_z(raw)),
    }


def scale_edges(edges: DataFrame, scalars: DataFrame, variant: str = "ratio", keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges of every subject rescaled by its (rho_hat_t, r_raw) row."""
    forms = projections()
    if variant not in forms:
        raise ValueError(f"unknown variant {variant!r}")
    return edges.join(scalars.select(*keys, "rho_hat_t", "r_raw"), list(keys)).select(
        *keys, "i", "j", forms[variant].alias("r")
    )


def cross_subject_reliability(wide: DataFrame, short: str = "short", full: str = "full") -> DataFrame:
    """Per edge: correlation over subjects of short and reference values; 0 where undefined."""
    both = (F.col(short).isNotNull()) & F.col(full).isNotNull()
    spread = F.sqrt(
        F.var_pop(F.when(both, F.col(short))) * F.var_pop(F.when(both, F.col(full)))
    ) * F.count(F.when(both, 1))
    r = F.when(spread > 1e-12, moment_corr(short, full)).otherwise(0.0)
    return wide.groupBy("i", "j").agg(F.coalesce(r, F.lit(0.0)).alias("r"), F.count(F.when(both, 1)).alias("n_subjects"))


def value_distribution(edges: DataFrame, r: str = "r") -> DataFrame:
    """Share of weak and positive edges, mean and SD over everything."""
    a = F.abs(r)
    share = lambda cond: F.avg(F.when(cond, 100.0).otherwise(0.0))
    return edges.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        share(a < 0.05).alias("below_05_pct"),
        share(a < 0.10).alias("below_10_pct"),
        share(a < 0.20).alias("below_20_pct"),
        share(F.col(r) > 0.10).alias("above_10_pct"),
        F.avg(r).alias("mean_fc"),
        F.stddev_pop(r).alias("sd_fc"),
    )


def threshold_report(mean_edges: DataFrame, threshold) -> DataFrame:
    """Kept and removed edges of a group-average network and its 99th percentile scale.

    The input is one group-average network, so the exact percentile sees at most p(p-1)/2 values.
    """
    strong = F.abs("r") >= as_col(threshold)
    return mean_edges.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count(F.when(strong, 1)).alias("n_kept"),
        F.count(F.when(~strong, 1)).alias("n_removed"),
        (F.avg(F.when(strong, 1.0).otherwise(0.0)) * 100).alias("pct_kept"),
        F.greatest(F.percentile(F.abs("r"), F.lit(0.99)), F.lit(0.05)).alias("scale"),
    )


def combine_edges(left: DataFrame, right: DataFrame, alpha: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """alpha * left + (1 - alpha) * right on aligned edges."""
    joined = left.withColumnRenamed("r", "a").join(right.withColumnRenamed("r", "b"), [*keys, "i", "j"])
    return joined.select(*keys, "i", "j", (F.lit(alpha) * F.col("a") + F.lit(1 - alpha) * F.col("b")).alias("r"))
