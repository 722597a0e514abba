"""Spectral vectors, fold-wise tangent means and lookups by joins, against NumPy and plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliaspan.operators import spectral
from reliaspan.operators.cluster import spectral_neighbour_labels
from reliaspan.operators.cohort import with_each
from reliaspan.operators.edges import shrunk_covariances, tangent_edges, tangent_fold_edges
from reliaspan.operators.graph import parse_networks
from reliaspan.operators.spectral import embedding, leading_vectors
from reliaspan.session import ensure_checkpoint_dir, materialise


def test_leading_vectors_equal_numpy(spark, rng):
    n, k = 60, 3
    w = np.triu((rng.random((n, n)) < 0.15) * rng.random((n, n)))
    w[np.arange(n - 1), np.arange(1, n)] += 0.2
    listed = [(f"n{a}", f"n{b}", float(w[a, b])) for a, b in zip(*np.nonzero(w), strict=True)]
    s = leading_vectors(spark.createDataFrame([*listed, ("n1", None, 1.0), ("n1", "n2", None), ("n1", "n2", -1.0)], "u string, v string, w double"), k)
    full = w + w.T - np.diag(np.diag(w))
    d = full.sum(1)
    values, vectors = np.linalg.eigh(full / np.sqrt(np.outer(d, d)))
    got = {r["node"]: r["x"] for r in s.vectors.collect()}
    x = np.array([got[f"n{i}"] for i in range(n)])
    assert np.allclose(s.values, values[::-1][:k], atol=1e-9) and s.residuals.max() <= 1e-8
    angles = np.linalg.svd(vectors[:, ::-1][:, :k].T @ np.linalg.qr(x)[0])[1]
    assert np.sqrt(max(0.0, 1 - angles.min() ** 2)) < 1e-6
    place = {r["subject_id"]: r["vec"] for r in embedding(s).collect()}
    assert np.allclose(place["n7"], x[7] / np.sqrt(d[7]))


def test_rounds_shuffle_nothing(spark, rng, monkeypatch):
    plans = []

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df)

    monkeypatch.setattr(spectral, "materialise", recorded)
    net = spark.createDataFrame([(i, int(j), 1.0) for i in range(100) for j in {(i + 1) % 100, *rng.integers(0, 100, 5)} - {i}], "u long, v long, w double")
    s = leading_vectors(net, 2, settled=1e-2)
    assert s.rounds > 1 and len(plans) > 2 * s.rounds and not any("Exchange" in p for p in plans[3:])
    monkeypatch.setattr(spectral, "NUMBERS", 600)  # several groups of blocks for a product
    again = leading_vectors(net, 2, settled=1e-2)
    # neither is exact: each value is within its residual of a true one
    assert np.all(np.abs(s.values - again.values) <= s.residuals + again.residuals + 1e-12) and again.vectors.count() == 100


def test_small_split_and_empty_networks(spark):
    two = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (8, 9, 1.0), (8, 9, 1.0)], "u long, v long, w double")
    s = leading_vectors(two, 2)  # one part each: the value 1 comes twice
    assert np.allclose(s.values, 1.0) and s.vectors.count() == 5
    assert len(leading_vectors(two.filter("u = 8"), 7).values) == 2
    with pytest.raises(ValueError):
        leading_vectors(two.limit(0), 2)


def test_spectral_clusters_of_two_rings(spark, rng):
    angle = np.arange(60) * 2 * np.pi / 60
    ring = np.column_stack([np.cos(angle), np.sin(angle)])
    points = np.vstack([ring, 3 * ring])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "subject_id long, vec array<double>")
    got = {r["subject_id"]: r["cluster"] for r in spectral_neighbour_labels(rows, 2, 4).collect()}
    assert len({got[i] for i in range(60)}) == 1 and len({got[i] for i in range(60, 120)}) == 1 and got[0] != got[60]


def test_fold_means_leave_the_held_out_subjects_out(spark, frames_of, rng):
    ensure_checkpoint_dir(spark)
    cov = shrunk_covariances(frames_of({s: rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4)) for s in range(7)})).checkpoint()
    folds = spark.createDataFrame([(s, "ab"[s % 2]) for s in range(6)] + [(6, None)], "subject_id long, fold string")
    key = lambda r: (r["subject_id"], r["i"], r["j"])
    rows = tangent_fold_edges(cov, folds, held_only=False).collect()
    assert len(rows) == 2 * 6 * 6 and all(r["held"] == (r["fold"] == "ab"[r["subject_id"] % 2]) for r in rows)
    for fold, side in (("a", 1), ("b", 0)):
        want = {key(r): r["r"] for r in tangent_edges(cov, cov.filter(f"subject_id % 2 = {side} AND subject_id < 6")).collect()}
        got = {key(r): r["r"] for r in rows if r["fold"] == fold}
        assert len(got) == 36 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
    held = {key(r): r["r"] for r in tangent_fold_edges(cov, folds).collect()}
    leaky = {key(r): r["r"] for r in tangent_edges(cov, cov).collect()}
    assert len(held) == 36 and max(abs(held[k] - leaky[k]) for k in held) > 0.01
    with pytest.raises(RuntimeError):
        tangent_fold_edges(cov, folds, max_iter=1)
    one = spark.createDataFrame([(s, "a") for s in range(3)], "subject_id long, fold string")
    assert tangent_fold_edges(cov, one).count() == 0 and tangent_fold_edges(cov, one.limit(0)).count() == 0


def test_every_subject_meets_every_value(spark, monkeypatch):
    monkeypatch.setattr("reliaspan.operators.cohort.CHUNK", 3)
    subjects = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "subject_id long, fold string")
    values = spark.createDataFrame([(f"v{i}",) for i in range(10)] + [(None,)], "fold string")
    got = with_each(subjects, values, "fold")
    assert got.count() == 3 * 11 and got.groupBy("subject_id").agg(F.count_distinct("fold").alias("n")).filter("n <> 10").count() == 0
    assert with_each(subjects, values.limit(0), "fold").count() == 0


def test_networks_by_join_equal_a_pattern(spark):
    names = ["Vis", "Som_Mot", "Som", "Default", "A.B"]
    labels = ["7N_LH_Vis_1", "LH_Som_Mot_2", "LH_Som_Mota_Vis", "x_Default", "Vis_1", "", "_Vis", "LH_AxB_1", "LH_A.B_1", "none", None, "a__Vis_Som"]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(labels)], "channel int, label string")
    known = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "network_name string, network long")
    got = {r["channel"]: (r["network_name"], r["network"]) for r in parse_networks(table, known).collect()}
    pattern = re.compile("_(" + "|".join(map(re.escape, names)) + ")(_|$)")
    for i, s in enumerate(labels):
        m = pattern.search(s or "")
        assert got[i] == ((m[1], names.index(m[1])) if m else (None, None)), s
