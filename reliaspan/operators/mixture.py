"""Diagonal Gaussian mixtures by expectation-maximisation as grouped sums, all starts in one keyed job."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliaspan.functions.hashing import seeded_hash
from reliaspan.operators.sums import add_up
from reliaspan.session import materialise

#: Added to every variance, as is usual against collapsing components; the gain of the mean log-likelihood that counts as settled.
FLOOR, SETTLED = 1e-6, 1e-3


@dataclass
class Mixture:
    """Weights (k), means and variances (k x d) of each start, and each start's mean log-likelihood by round."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    history: np.ndarray

    @property
    def best(self) -> int:
        return int(self.history[-1].argmax())


def densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """log(weight x density) of each row (n x k)."""
    inverse = 1 / variances
    square = (x * x) @ inverse.T - 2 * x @ (means * inverse).T + (means * means * inverse).sum(1)
    return np.log(np.maximum(weights, 1e-300)) - 0.5 * (square + np.log(2 * np.pi * variances).sum(1))


def _parts(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logs.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    return np.exp(logs - total[:, None]), total


def fit_mixture(rows: DataFrame, k: int = 2, seed: int = 42, n_init: int = 5, most: int = 500, settled: float = SETTLED, key: str = "subject_id") -> Mixture:
    """The mixtures of all starts from `rows(key, vec)`; a start's means are k rows drawn by a seeded hash, its variances those of all rows.

    Each round is one pass over the rows: partitions add up responsibilities, values and squares of every
    start, the driver gets n_init x k x d numbers. Ends when no start gains `settled` a row; not
    settling within `most` rounds is an error. Needs k rows at least.
    """
    spark = rows.sparkSession
    data = materialise(rows.select(key, F.col("vec").cast("array<double>").alias("vec")))
    # the starts' numbers stand where the grid has its splits
    packed = data.select(F.lit(0).cast("long").alias("split"), "vec")

    def moments(_, vec):
        x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
        return [np.array([len(x)]), x.sum(0), (x * x).sum(0)]

    n, total, squares = (np.frombuffer(v) for v in add_up(packed, ["vec"], moments, ["n", "total", "squares"]).first()[1:])
    n, d = n[0], len(total)
    spread = np.maximum(squares / n - (total / n) ** 2, 0.0) + FLOOR
    chosen = [data.withColumn("_h", seeded_hash(F.col(key), seed, s, "mixture")).orderBy("_h", key).limit(k).select("vec").collect() for s in range(n_init)]
    means = np.array([[r["vec"] for r in c] for c in chosen], float)
    weights, variances = np.full((n_init, k), 1 / k), np.broadcast_to(spread, (n_init, k, d)).copy()
    history: list[np.ndarray] = []
    for _ in range(most):
        shared = spark.sparkContext.broadcast((weights, means, variances))

        def part(_, vec, shared=shared):
            x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
            out = [np.zeros((n_init, k)), np.zeros((n_init, k, d)), np.zeros((n_init, k, d)), np.zeros(n_init)]
            for s in range(n_init):
                r, logs = _parts(densities(x, *(v[s] for v in shared.value)))
                out[0][s], out[1][s], out[2][s], out[3][s] = r.sum(0), r.T @ x, r.T @ (x * x), logs.sum()
            return out

        sums = add_up(packed, ["vec"], part, ["n", "total", "squares", "logs"]).first()
        mass, total, squares, logs = (np.frombuffer(v) for v in sums[1:])
        history.append(logs / n)
        if len(history) > 1 and (history[-1] - history[-2]).max() < settled:
            return Mixture(weights, means, variances, np.array(history))
        mass = mass.reshape(n_init, k) + 1e-300
        weights = mass / n
        means = total.reshape(n_init, k, d) / mass[..., None]
        variances = np.maximum(squares.reshape(n_init, k, d) / mass[..., None] - means**2, 0.0) + FLOOR
    raise RuntimeError(f"the mixtures have not settled after {most} rounds; last gain {(history[-1] - history[-2]).max():.2g}")


def mixture_labels(rows: DataFrame, k: int = 2, seed: int = 42, n_init: int = 5, key: str = "subject_id") -> DataFrame:
    """(key, cluster) by the start of greatest likelihood; components are numbered by falling weight."""
    m = fit_mixture(rows, k, seed, n_init, key=key)
    order = np.argsort(-m.weights[m.best], kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast([v[m.best][order] for v in (m.weights, m.means, m.variances)])
    data = rows.select(key, F.col("vec").cast("array<double>").alias("vec"))

    def label(batches):
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            best = densities(x, *shared.value).argmax(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(best.astype(np.int32))], [key, "cluster"])

    return data.mapInArrow(label, f"`{key}` {data.schema[key].dataType.simpleString()}, cluster int")
