"""Principal components by a randomised range finder: sums of features x directions, never features x features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliaspan.operators.sums import add_up

#: Directions beyond twice those asked for; change of the found share of the variance that counts as settled, and that
#: tells roughly whether enough are sought; rounds at most.
SPARE, SETTLED, ROUGH, ROUNDS = 12, 1e-9, 1e-4, 200


@dataclass
class Components:
    """Column means, unit directions (features x components), variance along each (population), and the total variance."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def leading_components(rows: DataFrame, k: int, seed: int = 42, vec: str = "vec", settled: float = SETTLED) -> Components:
    """The k leading components of `rows(vec array<double>)`, all of one length and without NULLs.

    Random directions are multiplied by the covariance, one pass over the rows each time, and made orthogonal,
    until the variance they hold settles. Read several times, so checkpoint the rows. k is cut to the
    smaller of rows - 1 and features. Not settling within ROUNDS passes is an error.
    """
    spark = rows.sparkSession
    packed = rows.select(F.lit(0).cast("long").alias("split"), F.col(vec).cast("array<double>").alias("vec"))

    def moments(_, column):
        x = _matrix(column)
        return [np.array([len(x)]), x.sum(0), (x * x).sum(0)]

    first = add_up(packed, ["vec"], moments, ["n", "total", "squares"]).first()
    if first is None:
        raise ValueError("no rows")
    n, total, squares = (np.frombuffer(v) for v in first[1:])
    n, mean = n[0], total / n[0]
    d = len(mean)
    whole = float(np.maximum(squares / n - mean**2, 0.0).sum())
    k = max(1, min(k, d, int(n) - 1))
    width = min(d, 2 * k + SPARE)
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    held = -1.0
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((mean, turn))

        def part(_, column, shared=shared):
            mean, turn = shared.value
            x = _matrix(column) - mean
            return [x.T @ (x @ turn)]

        product = np.frombuffer(add_up(packed, ["vec"], part, ["y"]).first()["y"]).reshape(d, width) / n
        small = turn.T @ product
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
        found = float(values.sum())
        directions = turn @ vectors
        if width == d or abs(found - held) <= settled * max(whole, 1e-300):
            return Components(mean, directions, values, whole)
        held, turn = found, np.linalg.qr(product)[0]
    raise RuntimeError(f"the components have not settled after {ROUNDS} passes")


def components_for(rows: DataFrame, variance: float, start: int = 32, seed: int = 42, vec: str = "vec") -> Components:
    """The fewest leading components that hold a share of the variance; twice as many are sought until they do."""
    k = start
    while True:
        rough = leading_components(rows, k, seed, vec, ROUGH)
        if len(rough.variances) == k and rough.variances.sum() < (variance - 10 * ROUGH) * rough.total:
            k *= 2
            continue
        c = leading_components(rows, k, seed, vec)
        share = np.cumsum(c.variances) / max(c.total, 1e-300)
        keep = int(np.searchsorted(share, variance - 1e-12)) + 1
        if keep <= len(share) or len(c.variances) < k:
            keep = min(keep, len(share))
            return Components(c.mean, c.directions[:, :keep], c.variances[:keep], c.total)
        k *= 2


def project(rows: DataFrame, components: Components, vec: str = "vec", out: str = "projected") -> DataFrame:
    """rows with the array column `out`: the coordinates of each centred vector along the components."""
    shared = rows.sparkSession.sparkContext.broadcast((components.mean, components.directions))

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        mean, directions = shared.value
        return pa.array(list((_matrix(column) - mean) @ directions), pa.list_(pa.float64()))

    return rows.withColumn(out, run(F.col(vec).cast("array<double>")))
