"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

A document becomes a vector of statistics; cosines of random projections approximate a Gaussian kernel
over them. Each partition adds up its part of the normal equations, the driver solves one system of
FEATURES + 1 unknowns. Rows kept apart from that fit calibrate the ridge value by isotonic regression
on BINS bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.llm.common import sum_matrices
from reliaspan.session import materialise

FEATURES, SEED, RIDGE, WIDTH, BINS = 192, 11, 1e-3, 0.6, 512
STATISTICS = 18


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS numbers of a UTF-8 text; an empty one and None have zeros."""
    text = text or b""
    if not text:
        return [0.0] * STATISTICS
    b = np.frombuffer(text, np.uint8)
    c = np.bincount(b, minlength=256)
    n = len(b)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    kinds = set(words)
    w = max(1, len(words))
    upper, lower, digit = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    space = int(c[32] + c[9:14].sum())
    symbol = int(c[[35, 36, 37, 38, 42, 60, 62, 124]].sum())
    mark = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    p = c[c > 0] / n
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n), math.log1p(len(words)), (n - space) / w, upper / n, lower / n, digit / n, space / n, symbol / n, mark / n, float(c[33]) / n, float(c[124]) / n,
        int(c[128:].sum()) / n, float(-(p * np.log(p)).sum()), len(kinds) / w, len(kinds) / math.sqrt(w), pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)), math.log1p(len(words) / max(1, len(lines))),
    ]


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x) for x in texts.to_pylist()], pa.list_(pa.float64()))

    return run(text.cast("binary"))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    coefficients: np.ndarray
    #: Calibration: raw values, ascending, and the probability at each.
    raw: np.ndarray
    probability: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        cos = np.cos(z @ self.project + self.phase) * math.sqrt(2 / FEATURES)
        return np.hstack([cos, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.coefficients

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(x), self.raw, self.probability), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of least weighted squares, by pooling adjacent violators."""
    out: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            v2, w2, n2 = out.pop()
            v1, w1, n1 = out.pop()
            out.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in out]) if out else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, STATISTICS)


def fit(labelled: DataFrame) -> QualityModel:
    """A model from `labelled(stats array<double>, label 0/1, calibrate boolean)`.

    Three passes over the statistics: their mean and spread, the normal equations of the rows that do
    not calibrate, the binned scores of those that do. All rows count; the driver gets sums only. With
    one kind of label or none, the score is the share of label 1, or 0.5.
    """
    spark = labelled.sparkSession

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(1 + 2 * STATISTICS + 1)
        for b in batches:
            x = _matrix(b.column(0))
            s += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0), [np.asarray(b.column(1), float).sum()]])
        yield pa.RecordBatch.from_pydict({"part": pa.array([s.tobytes()], pa.binary())})

    columns = labelled.select("stats", "label")
    s = sum_matrices(columns.mapInArrow(moments, "part binary"), "part", 2 * STATISTICS + 2)
    n = max(1.0, s[0])
    mean = s[1 : 1 + STATISTICS] / n
    scale = np.sqrt(np.maximum(s[1 + STATISTICS : -1] / n - mean**2, 0.0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    project = rng.normal(size=(STATISTICS, FEATURES)) * WIDTH / math.sqrt(STATISTICS / 4)
    model = QualityModel(mean, scale, project, rng.uniform(0, 2 * math.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.array([s[-1] / n if s[0] else 0.5]))
    if not 0 < s[-1] < s[0]:
        return model
    size = FEATURES + 1
    first = spark.sparkContext.broadcast(model)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            z = first.value.fourier(_matrix(b.column(0)))
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ np.asarray(b.column(1), float)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    fitted = labelled.filter("not calibrate").select("stats", "label")
    total = sum_matrices(fitted.mapInArrow(normal, "part binary"), "part", size * (size + 1)).reshape(size, size + 1)
    rows = max(1.0, total[-1, size - 1])
    model.coefficients = np.linalg.solve(total[:, :size] + RIDGE * rows / FEATURES * np.eye(size), total[:, size])
    second = spark.sparkContext.broadcast(model)
    edges = np.linspace(-0.25, 1.25, BINS - 1)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for b in batches:
            r = second.value.ridge(_matrix(b.column(0)))
            k = np.searchsorted(edges, r)
            total += [np.bincount(k, minlength=BINS), np.bincount(k, r, BINS), np.bincount(k, np.asarray(b.column(1), float), BINS)]
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    kept = labelled.filter("calibrate").select("stats", "label")
    count, raw, ones = sum_matrices(kept.mapInArrow(binned, "part binary"), "part", 3 * BINS).reshape(3, BINS)
    some = count > 0
    if some.any():
        model.raw = raw[some] / count[some]
        model.probability = isotonic(ones[some] / count[some], count[some])
    else:
        model.raw, model.probability = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def labelled_statistics(stats: DataFrame, labels: DataFrame, quality: str = "quality") -> DataFrame:
    """Rows for `fit` from `stats(doc_id, stats)` and labels; several labels of an id count as their rounded mean.

    NULL ids and labels are not used. Ids whose crc32 is 2 modulo 3 calibrate.
    """
    marked = labels.select("doc_id", F.col(quality).cast("double").alias("quality")).na.drop().groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    return stats.join(marked, "doc_id").select("stats", "label", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 2).alias("calibrate"))


def score(stats: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The `keep` columns of `stats` with score (0 to 1) and predicted (1 from a score of 0.5)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    rows = stats.select(*keep, "stats")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score(_matrix(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, f"{schema}, score double, predicted int")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats), written once to the checkpoint folder: a few numbers for each row of docs."""
    return materialise(docs.select(F.col(doc_id).alias("doc_id"), statistics_column(F.col(text)).alias("stats")))
