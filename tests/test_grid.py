"""The classification grid against fits written out with NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliaspan.operators.grid import SHRINK, assign, clustering_p, members, run_grid, splits
from reliaspan.operators.sampling import permuted_labels

SCHEMA = "subject_id long, label int, site string, rho double, age double, sex string"


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(3)
    n = 48
    x = rng.normal(size=(n, 5))
    rows = [(i, int(x[i, 0] + rng.normal() > 0), "abc"[i % 3], float(rng.uniform(0.2, 0.9)), None if i % 7 == 0 else 20.0 + i % 11, "MF"[i % 2]) for i in range(n)]
    subjects = members(spark.createDataFrame(rows, SCHEMA), {"all": F.lit(True), "young": F.col("subject_id") < 32}).checkpoint()
    features = spark.createDataFrame([(i, "plain", [float(v) for v in x[i]]) for i in range(n)], "subject_id long, kind string, vec array<double>")
    return subjects, features, {r[0]: r for r in rows}, x


def metrics(score, y):
    hit = ((score > 0) == (y == 1)).astype(float)
    diff = score[y == 1][:, None] - score[y == 0][None]
    return (hit[y == 1].mean() + hit[y == 0].mean()) / 2, float(((diff > 0) + 0.5 * (diff == 0)).mean())


def discriminant(x, y, test):
    s = np.cov(x.T, bias=True)
    up, down = x[y == 1].mean(0), x[y == 0].mean(0)
    w = np.linalg.solve(s + SHRINK * np.trace(s) / len(s) * np.eye(len(s)), up - down)
    return (test - (up + down) / 2) @ w


def logistic(x, y, test):
    x1, b = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge = np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x1 @ b))
        b -= np.linalg.solve((x1 * (w * mu * (1 - mu))[:, None]).T @ x1 + np.diag(ridge), x1.T @ (w * (mu - y)) + ridge * b)
    return np.hstack([test, np.ones((len(test), 1))]) @ b


def test_grid_equals_refitting_every_split(cohort):
    subjects, features, rows, x = cohort
    cells, report = run_grid(subjects, features, repeats=1, k=3, variance=1.0, n_perm=6)
    got = {(r["stratum"], r["model"]): r for r in cells.collect()}
    assert set(got) == {(s, m) for s in ("all", "young") for m in ("discriminant", "logistic_l2")}
    own = {(r["stratum"], r["subject_id"]): r["own"] for r in assign(subjects, 1, 42, k=3).collect()}
    for stratum in ("all", "young"):
        ids = sorted(i for s, i in own if s == stratum)
        fold = np.array([own[stratum, i] for i in ids])
        y = np.array([rows[i][1] for i in ids])
        chosen = subjects.filter(F.col("stratum") == stratum).select("subject_id", "label", "stratum", F.lit(0).alias("repeat"))
        perms = permuted_labels(chosen, 6, 42, within=["stratum", "repeat"]).collect()
        columns = [y] + [np.array([{r["subject_id"]: r["label"] for r in perms if r["perm"] == p}[i] for i in ids]) for p in range(1, 7)]
        for model, fit, labels in (("discriminant", discriminant, columns), ("logistic_l2", logistic, columns[:1])):
            values = []
            for column in labels:
                score = np.zeros(len(ids))
                for f in set(fold):
                    train = fold != f
                    v = x[ids]
                    z = (v - v[train].mean(0)) / v[train].std(0)
                    score[~train] = fit(z[train], column[train], z[~train])
                values.append(metrics(score, column))
            r = got[stratum, model]
            assert (r["balanced_acc"], r["roc_auc"]) == pytest.approx(values[0], abs=1e-9)
            assert (r["splits_used"], r["coverage"], r["feature_dim"], r["n_eval"]) == (3, 1.0, 5.0, len(ids))
            if model == "discriminant":
                for at, name in enumerate(("balanced_acc_p", "roc_auc_p")):
                    assert r[name] == pytest.approx((1 + sum(v[at] >= values[0][at] - 1e-12 for v in values[1:])) / 7)
            else:
                assert r["balanced_acc_p"] is None
    assert report.filter("skipped IS NOT NULL").count() == 0


def test_grid_over_sites_with_gate_covariates_and_skipped_splits(cohort):
    subjects, features, _, _ = cohort
    cells, report = run_grid(subjects, features, scheme="loso", balance=True, gate=0.3, gamma=1.0, covariates=True, min_test=4, variance=0.9, models=["logistic_l2"])
    for r in report.collect():
        few = min(r["train0"], r["train1"]) < 1
        assert (r["skipped"] is None) == (not few and min(r["test0"], r["test1"]) >= 4)
    used = {r["stratum"]: r["n"] for r in report.filter("skipped IS NULL").groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    rows = cells.collect()
    assert len(rows) == 2
    for r in rows:
        assert r["splits_used"] == used.get(r["stratum"], 0) and r["splits"] == r["splits_skipped"] + r["splits_used"]
        assert 0 <= r["coverage"] < 1 and r["n_cases"] * 2 == r["n_subjects"]
        assert (r["roc_auc"] is None) == (r["splits_used"] == 0)


def test_splits_of_one_class_are_reported(spark, cohort):
    subjects, features, _, _ = cohort
    cells, report = run_grid(subjects.filter("label = 1"), features, k=3)
    assert {r["skipped"] for r in report.collect()} == {"one class in training"}
    assert all(r["splits_used"] == 0 and r["coverage"] == 0 and r["roc_auc"] is None for r in cells.collect())


def test_clustering_nulls(spark):
    rows = spark.createDataFrame([(i, i % 2, "ab"[i % 4 // 2], i % 2) for i in range(24)], "subject_id long, label int, site string, cluster int")
    got = {r["metric"]: r for r in clustering_p(rows, 20, 5, ["site"]).collect()}
    assert got["ari"]["observed"] == 1.0 and got["balanced_acc"]["observed"] == 1.0
    assert all(r["p"] == pytest.approx(1 / 21) for r in got.values())


def test_diagonal_mixture_equals_numpy(spark):
    from reliaspan.operators.mixture import FLOOR, _parts, densities, fit_mixture, mixture_labels

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 6)), rng.normal(size=(40, 6)) * 0.7 + 1.5])
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(100)], "subject_id long, vec array<double>").repartition(3)
    m = fit_mixture(rows, n_init=3, settled=1e-5)
    assert (np.diff(m.history, axis=0) > -1e-9).all() and m.history.shape[1] == 3
    first = fit_mixture(rows, n_init=1, settled=1e-5)
    w, mu, var = np.full(2, 0.5), None, None
    from reliaspan.functions.hashing import seeded_hash

    chosen = rows.orderBy(seeded_hash(F.col("subject_id"), 42, 0, "mixture"), "subject_id").limit(2).collect()
    mu, var = np.array([r["vec"] for r in chosen]), np.tile(x.var(0) + FLOOR, (2, 1))
    for _ in range(len(first.history) - 1):
        r, logs = _parts(densities(x, w, mu, var))
        n = r.sum(0)
        w, mu = n / 100, r.T @ x / n[:, None]
        var = np.array([(r[:, [c]] * (x - mu[c]) ** 2).sum(0) / n[c] for c in (0, 1)]) + FLOOR
    assert np.allclose(first.weights[0], w) and np.allclose(first.means[0], mu) and np.allclose(first.variances[0], var)
    labels = {r["subject_id"]: r["cluster"] for r in mixture_labels(rows, n_init=3).collect()}
    found = np.array([labels[i] for i in range(100)])
    truth = (np.arange(100) >= 60).astype(int)
    assert max((found == truth).mean(), (found != truth).mean()) > 0.9


def test_range_finder_equals_the_full_decomposition(spark):
    from reliaspan.operators.components import components_for, leading_components, project

    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 40)) @ np.diag(0.85 ** np.arange(40)) @ np.linalg.qr(rng.normal(size=(40, 40)))[0] + 3.0
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(70)], "subject_id long, vec array<double>").repartition(3).checkpoint()
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    c = leading_components(rows, 5)
    assert c.variances == pytest.approx(values[:5], rel=1e-6) and c.total == pytest.approx(values.sum())
    assert np.abs((c.directions * vectors[:, :5]).sum(0)) == pytest.approx(np.ones(5), abs=1e-4)
    few = components_for(rows, 0.9, start=4)
    assert len(few.variances) == int(np.searchsorted(np.cumsum(values) / values.sum(), 0.9)) + 1
    got = {r["subject_id"]: r["projected"] for r in project(rows, c).collect()}
    want = (x - x.mean(0)) @ c.directions
    assert all(np.allclose(got[i], want[i]) for i in range(70))
