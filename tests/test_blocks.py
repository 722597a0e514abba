"""Rows meet block against block: exact for any dealing, and what a task returns does not grow with the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import reliaspan.operators.blocks as blocks
import reliaspan.operators.cluster as cluster
from reliaspan.operators.cluster import nearest_neighbours, silhouette
from reliaspan.operators.similarity import fingerprint_ranks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cluster, "PAIRS", 7)
    monkeypatch.setattr(cluster, "HELD_CLUSTERS", 2)
    monkeypatch.setattr(blocks, "GROUPS", 2)
    monkeypatch.setattr(blocks, "CELLS", 50)


@pytest.fixture
def points(spark, rng):
    x = rng.normal(size=(300, 4))
    x[100:140] = x[7]  # copies
    ids = [f"p{k:04d}" for k in rng.permutation(300)]
    return ids, x, spark.createDataFrame([(i, k % 5, [float(v) for v in x[k]]) for k, i in enumerate(ids)], "subject_id string, cluster int, vec array<double>")


def test_nearest_neighbours_with_copies_and_text_keys(points, small_blocks):
    ids, x, rows = points
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {}
    for r in nearest_neighbours(rows.drop("cluster"), 5).orderBy("subject_id", "distance", "neighbour").collect():
        got.setdefault(r["subject_id"], []).append((r["distance"], r["neighbour"]))
    for k, i in enumerate(ids):
        assert got[i] == sorted((d[k, m], ids[m]) for m in range(300) if m != k)[:5]


def test_silhouette_of_more_clusters_than_a_task_holds(points, small_blocks):
    _, x, rows = points
    d, c = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), np.arange(300) % 5
    a = np.array([d[k, c == c[k]].sum() / (np.sum(c == c[k]) - 1) for k in range(300)])
    b = np.array([min(d[k, c == g].mean() for g in range(5) if g != c[k]) for k in range(300)])
    assert silhouette(rows).first()["silhouette"] == pytest.approx(float(np.mean((b - a) / np.maximum(a, b))))


def test_vectors_are_not_shuffled_for_a_pair_of_blocks(points, small_blocks, monkeypatch):
    rows, returned = points[2], []
    whole = cluster.meet

    def meet(*args):
        returned.append(whole(*args))
        return returned[-1]

    monkeypatch.setattr(cluster, "meet", meet)
    for out in (nearest_neighbours(rows.drop("cluster"), 5), silhouette(rows)):
        assert "CartesianProduct" in plan(out) and "CoGroups" not in plan(out)
    assert returned[0].groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= 2 * 5  # groups x k, of 19 blocks


def test_fingerprints_of_copies_are_equal_and_not_shuffled(spark, rng, small_blocks):
    x = rng.normal(size=(60, 66))
    x[20:] = x[np.arange(40) % 20]  # three copies of each: their similarities are equal but for rounding
    mk = lambda m: spark.createDataFrame([(k, [float(v) for v in m[k]]) for k in range(len(m))], "subject_id long, vec array<double>")
    short = x + 0.3 * rng.normal(size=(20, 66))[np.arange(60) % 20]
    out = fingerprint_ranks(mk(short), mk(x), block_rows=7)
    assert {r["rank"] for r in out.collect()} == {1}
    assert "CartesianProduct" in plan(out) and "CoGroups" not in plan(out)
