import numpy as np
import pytest
from pyspark.sql import functions as F

from reliaspan.operators.connectivity import fc_edges, pair_moments
from reliaspan.operators.edges import partial_edges, shrunk_covariances, tangent_edges
from reliaspan.operators.prep import regress_confounds
from reliaspan.operators.resample import (
    block_lengths, bootstrap_estimate, bootstrap_indices, replicate_scores, replicate_scores_relational, split_half,
)
from reliaspan.operators.ridge import held_out_ridge
from reliaspan.config import EstimatorConfig
from reliaspan.session import ensure_checkpoint_dir
from reliaspan.sources.panels import frames_to_samples, samples_to_frames


def shrunk_cov(x):
    n, p = x.shape
    x = x - x.mean(0)
    c = x.T @ x / n
    mu = np.trace(c) / p
    d = ((c - mu * np.eye(p)) ** 2).sum() / p
    b = min(d, sum(((np.outer(r, r) - c) ** 2).sum() for r in x) / n**2 / p)
    return (1 - b / d) * c + b / d * mu * np.eye(p)


def corr(c):
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def recordings(rng, n=4, rows=30, p=5):
    mix = rng.normal(size=(p, p))
    return {s: rng.normal(size=(rows, p)) @ mix + 3 for s in range(n)}


def as_matrix(rows, p):
    m = np.zeros((p, p))
    for r in rows:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["r"]
    return m


def by_subject(df, s):
    return df.filter(F.col("subject_id") == s).collect()


@pytest.mark.parametrize("kind", ["pearson", "ledoit_wolf"])
def test_edges_match_numpy(frames_of, rng, kind):
    recs = recordings(rng)
    edges = fc_edges(frames_of(recs), kind=kind)
    for s, x in recs.items():
        want = np.corrcoef(x.T) if kind == "pearson" else corr(shrunk_cov(x))
        got = as_matrix(by_subject(edges, s), 5)
        assert np.allclose(got[np.triu_indices(5, 1)], want[np.triu_indices(5, 1)], atol=1e-9)


def test_partial_sums_do_not_depend_on_batches(spark, frames_of, rng):
    frames = frames_of(recordings(rng, rows=50)).repartition(7)
    want = {(r["subject_id"], r["i"], r["j"]): r["r"] for r in fc_edges(frames, kind="ledoit_wolf").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r["subject_id"], r["i"], r["j"]): r["r"] for r in fc_edges(frames, kind="ledoit_wolf").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_constant_channel_and_short_recording(frames_of):
    x = np.column_stack([np.arange(6.0), np.full(6, 0.1), np.arange(6.0) ** 2])
    rows = {(r["i"], r["j"]): r["r"] for r in fc_edges(frames_of({1: x})).collect()}
    assert rows[(0, 1)] is None and rows[(0, 2)] is not None
    assert all(r["r"] == 0 for r in fc_edges(frames_of({1: x[:2]})).collect())


def test_long_to_wide_round_trip(frames_of, rng):
    frames = frames_of(recordings(rng, 2))
    again = samples_to_frames(frames_to_samples(frames), rows_per_chunk=8)
    key = lambda r: (r["subject_id"], r["t"])
    assert sorted(map(tuple, [(*key(r), tuple(r["x"])) for r in frames.collect()])) == sorted(
        map(tuple, [(*key(r), tuple(r["x"])) for r in again.collect()])
    )


def test_partial_correlation(frames_of, rng):
    recs = recordings(rng, 2)
    got = as_matrix(by_subject(partial_edges(frames_of(recs)), 1), 5)
    theta = np.linalg.inv(shrunk_cov(recs[1]))
    assert np.allclose(got[np.triu_indices(5, 1)], -corr(theta)[np.triu_indices(5, 1)], atol=1e-8)


def test_tangent_of_identical_subjects_is_zero(spark, frames_of, rng):
    ensure_checkpoint_dir(spark)
    x = recordings(rng, 1)[0]
    cov = shrunk_covariances(frames_of({1: x, 2: x, 3: x})).checkpoint()
    assert max(abs(r["r"]) for r in tangent_edges(cov, cov, max_iter=3).collect()) < 1e-8


def test_resampling_indices(frames_of, rng):
    short = frames_of(recordings(rng, 3, rows=40))
    lengths = block_lengths(short)
    for r in lengths.collect():
        assert 5 <= r["block_len"] <= 10
    ix = bootstrap_indices(lengths, 4, (1, 2))
    per = ix.groupBy("subject_id", "seed", "b").agg(F.count("*").alias("n"), F.min("src_t").alias("lo"), F.max("src_t").alias("hi")).collect()
    size = {r["subject_id"]: 40 // r["block_len"] * r["block_len"] for r in lengths.collect()}
    assert len(per) == 3 * 4 * 2
    assert all(r["n"] == size[r["subject_id"]] and r["lo"] >= 0 and r["hi"] < 40 for r in per)


def test_kernel_and_relational_replicates_agree(frames_of, rng):
    recs = recordings(rng, 3, rows=24)
    short = frames_of(recs)
    ref = fc_edges(frames_of(recordings(rng, 3, rows=60)), kind="ledoit_wolf")
    key = lambda r: (r["subject_id"], r["seed"], r["b"])
    a = {key(r): (r["r_obs"], r["r_split"]) for r in replicate_scores(short, ref, 4, (1, 2)).collect()}
    b = {key(r): (r["r_obs"], r["r_split"]) for r in replicate_scores_relational(short, ref, 4, (1, 2)).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-8) for k in a)


def test_estimate_shape(frames_of, rng):
    short = frames_of(recordings(rng, 2, rows=24))
    ref = fc_edges(frames_of(recordings(rng, 2, rows=60)), kind="ledoit_wolf")
    cfg = EstimatorConfig(n_channels=5, n_bootstraps=6)
    for r in bootstrap_estimate(short, ref, cfg, method="fisher_z", with_scores=True).collect():
        assert -1 <= r["ci_lower"] <= r["rho_hat_t"] <= r["ci_upper"] <= 1 and len(r["z_scores"]) == 6


def test_repeated_halves_are_reliable(frames_of, rng):
    x = rng.normal(size=(60, 10)) @ rng.normal(size=(10, 10))
    r = split_half(frames_of({1: np.vstack([x, x])}), 120).first()["r_split"]
    assert 0.5 < r <= 0.999


@pytest.mark.parametrize(("n", "block"), [(5, 256), (9, 256), (9, 5), (5, 3)])  # fewer and more subjects than edges, one block and several
def test_held_out_ridge_matches_refitting(spark, rng, n, block):
    x, y, alpha = rng.normal(size=(n, 6)), rng.normal(size=(n, 6)), 0.7
    ij = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    rows = [(s, i, j, float(x[s, e]), float(y[s, e])) for s in range(n) for e, (i, j) in enumerate(ij)]
    pairs = spark.createDataFrame(rows, "subject_id long, i int, j int, short double, long double")
    got = {(r["subject_id"], r["i"], r["j"]): r["predicted"] for r in held_out_ridge(pairs, alpha, block=block).collect()}
    for s in range(n):
        keep = np.arange(n) != s
        mx, my = x[keep].mean(0), y[keep].mean(0)
        xc, yc = x[keep] - mx, y[keep] - my
        beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(6), xc.T @ yc)
        want = (x[s] - mx) @ beta + my
        assert [got[(s, i, j)] for i, j in ij] == pytest.approx(list(want), abs=1e-9)


def test_held_out_ridge_solves_the_smaller_side(spark, rng, monkeypatch):
    import reliaspan.operators.ridge as ridge

    solved, inverse = [], ridge._inverse_columns

    def counted(x, places, *rest):
        solved.append(places.count())
        return inverse(x, places, *rest)

    monkeypatch.setattr(ridge, "_inverse_columns", counted)
    x, y = rng.normal(size=(9, 6)), rng.normal(size=(9, 6))
    rows = [(s, 0, e, float(x[s, e]), float(y[s, e])) for s in range(9) for e in range(6)]
    got = held_out_ridge(spark.createDataFrame(rows, "subject_id long, i int, j int, short double, long double"), 0.7, block=4)
    got = {(r["subject_id"], r["j"]): r["predicted"] for r in got.collect()}
    assert solved == [6]
    for s in range(9):
        rest = np.arange(9) != s
        xc, yc = x[rest] - x[rest].mean(0), y[rest] - y[rest].mean(0)
        want = (x[s] - x[rest].mean(0)) @ np.linalg.solve(xc.T @ xc + 0.7 * np.eye(6), xc.T @ yc) + y[rest].mean(0)
        assert [got[(s, e)] for e in range(6)] == pytest.approx(list(want), abs=1e-9)


def test_confound_regression(spark, frames_of, rng):
    x = rng.normal(size=(40, 3))
    samples = frames_to_samples(frames_of({1: x}))
    conf = rng.normal(size=(40, 2))
    cdf = spark.createDataFrame([(1, t, float(conf[t, 0]), float(conf[t, 1])) for t in range(40)], "subject_id long, t int, a double, b double")
    out = {(r["channel"], r["t"]): r["value"] for r in regress_confounds(samples, cdf, ["a", "b"]).collect()}
    d = np.column_stack([np.ones(40), conf])
    want = x - d @ np.linalg.lstsq(d, x, rcond=None)[0]
    assert np.allclose([[out[(c, t)] for c in range(3)] for t in range(40)], want, atol=1e-9)


def test_moments_weights_equal_repetition(spark, frames_of, rng):
    frames = frames_of(recordings(rng, 1, rows=6)).withColumn("w", F.col("t") % 3)
    a = pair_moments(frames, ["subject_id"], weight="w")
    b = pair_moments(frames.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(1)))).filter(F.col("_k") < F.col("w")), ["subject_id"])
    left = {(r["i"], r["j"]): r["sij"] for r in a.collect()}
    assert all(left[(r["i"], r["j"])] == pytest.approx(r["sij"]) for r in b.collect())


@pytest.mark.parametrize("n", [4, 9])
def test_held_out_ridge_leaves_out_incomplete_edges(spark, rng, n):
    ij = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    rows = [(s, i, j, float(rng.normal()), float(rng.normal())) for s in range(n) for i, j in ij]
    spoiled = [r for r in rows if r[:3] != (1, 0, 1)]  # one absent, one NULL and one NaN cell; a subject without values
    spoiled = [(*r[:3], None, r[4]) if r[:3] == (2, 0, 2) else (*r[:4], float("nan")) if r[:3] == (0, 0, 3) else r for r in spoiled]
    spoiled += [(n, i, j, None, None) for i, j in ij]
    schema = "subject_id long, i int, j int, short double, long double"
    whole = [r for r in rows if r[1] > 0]
    value = lambda got: {(r["subject_id"], r["i"], r["j"]): r["predicted"] for r in got.collect()}
    assert value(held_out_ridge(spark.createDataFrame(spoiled, schema))) == pytest.approx(value(held_out_ridge(spark.createDataFrame(whole, schema))), abs=1e-9)
    assert held_out_ridge(spark.createDataFrame(spoiled[:0], schema)).count() == 0


def test_tangent_mean_that_has_not_settled_is_an_error(spark, frames_of, rng):
    cov = shrunk_covariances(frames_of({s: rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4)) for s in range(5)})).checkpoint()
    with pytest.raises(RuntimeError, match="not settled"):
        tangent_edges(cov, cov, max_iter=1)
    assert tangent_edges(cov, cov).count() == 5 * 6
