"""Packed permutations against the relational ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliaspan.operators import permutations
from reliaspan.operators.permutations import permuted_codes, permuted_counts, permuted_sums
from reliaspan.operators.sampling import permuted_labels


@pytest.fixture
def subjects(spark):
    rows = [(i, [0, 1, 1, None, 2][i % 5], "ab"[i % 7 < 3], i % 3, None if i % 11 == 0 else float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "subject_id long, label int, site string, cluster int, score double").repartition(3)


@pytest.mark.parametrize("within", [[], ["site"]])
def test_packed_labels_equal_the_relational_ones(subjects, within, monkeypatch):
    monkeypatch.setattr(permutations, "BLOCK_ROWS", 7)
    packed, codes = permuted_codes(subjects, 19, 5, within=within, extra=["score", "cluster"])
    got = {}
    table = packed.toArrow()
    for key, numbers in zip(table["subject_id"].to_pylist(), codes.unpack(table["permuted"].combine_chunks()), strict=True):
        got |= {(p + 1, key): codes.classes[n] for p, n in enumerate(numbers)}
    assert got == {(r["perm"], r["subject_id"]): r["label"] for r in permuted_labels(subjects, 19, 5, within=within).collect()}
    assert (codes.unpack(table["permuted"].combine_chunks(), 8, 16) == codes.unpack(table["permuted"].combine_chunks())[:, 8:16]).all()


def test_sums_and_counts_equal_grouped_rows(subjects):
    packed, codes = permuted_codes(subjects, 9, 5, within=["site"], extra=["score", "cluster"])
    perms = permuted_labels(subjects, 9, 5, within=["site"]).select("perm", "subject_id", "label")
    both = perms.unionByName(subjects.select(F.lit(0).alias("perm"), "subject_id", "label")).join(subjects.drop("label", "site"), "subject_id")
    want = {(r["perm"], r["label"]): (r["n"], r["t"]) for r in both.groupBy("perm", "label").agg(F.count("score").alias("n"), F.sum("score").alias("t")).collect()}
    assert {(r["perm"], r["label"]): (r["n"], r["total"]) for r in permuted_sums(packed, codes, "score").collect()} == want
    want = {(r["perm"], r["label"], r["cluster"]): r["count"] for r in both.groupBy("perm", "label", "cluster").count().collect()}
    assert {(r["perm"], r["label"], r["cluster"]): r["n"] for r in permuted_counts(packed, codes, "cluster").collect()} == want


def test_equal_hashes_go_by_key():
    import pyarrow as pa

    h = np.array([5, 3, 5, 3, 5, 1], np.uint32)
    assert permutations._ordered(h, pa.array([9, 2, 7, 1, 8, 0])).tolist() == [5, 3, 1, 2, 4, 0]


def test_permutations_are_never_rows(subjects):
    packed, _ = permuted_codes(subjects, 9, 5, within=["site"])
    plan = packed._jdf.queryExecution().toString()
    assert "explode" not in plan and "Broadcast" not in plan
    assert packed.count() == 60


def test_permuted_scores_are_measured_in_the_tasks(spark, monkeypatch):

    from reliaspan.operators import grid
    from reliaspan.operators.evaluate import score_metrics

    monkeypatch.setattr(grid, "HELD_BYTES", 16 * 40 * 4)  # chunks of four permutations
    rng = np.random.default_rng(2)
    subjects = spark.createDataFrame([(i, i % 2) for i in range(40)], "subject_id long, label int")
    packed, codes = permuted_codes(subjects, 10, 5)
    z = {i: [float(v) for v in rng.integers(-2, 3, 2)] for i in range(40)}  # small numbers, so that scores tie
    tests = packed.join(spark.createDataFrame([(i, i % 3, z[i]) for i in range(40)], "subject_id long, split long, z array<double>"), "subject_id")
    fits = [(s, rng.integers(-2, 3, (2, 11)).astype(float), rng.integers(-1, 2, 11).astype(float)) for s in range(3)]
    fits[1][2][4] = np.nan
    fitted = spark.createDataFrame([(s, bytearray(w.tobytes()), bytearray(c.tobytes())) for s, w, c in fits], "split long, w binary, c binary")
    numbered = spark.createDataFrame([(s, "all", 0, "a" if s < 2 else "b") for s in range(3)], "split long, stratum string, repeat int, kind string")
    by = ["stratum", "repeat", "kind", "perm"]
    got = {tuple(r[c] for c in by): (r["balanced_acc"], r["roc_auc"], r["auprc"]) for r in grid.permuted_metrics(tests, fitted, numbered, codes).collect()}
    table = packed.toArrow()
    label = dict(zip(table["subject_id"].to_pylist(), codes.unpack(table["permuted"].combine_chunks())))
    rows = []
    for i in range(40):
        s, w, c = fits[i % 3]
        rows += [("all", 0, "a" if s < 2 else "b", p, int(label[i][p]), float(np.array(z[i]) @ w[:, p + 1] + c[p + 1])) for p in range(10)]
    each = spark.createDataFrame(rows, "stratum string, repeat int, kind string, perm int, label int, score double").filter("NOT isnan(score)")
    want = score_metrics(each.withColumn("prediction", (F.col("score") > 0).cast("int")), by).collect()
    assert len(got) == len(want) == 20
    for r in want:
        assert got[tuple(r[c] for c in by)] == pytest.approx((r["balanced_acc"], r["roc_auc"], r["auprc"]))
