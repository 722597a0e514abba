"""Evaluation and clustering queries on the embedding features (one row per subject)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliaspan.catalog.registry import q6, query, r6
from reliaspan.catalog.sqlparts import hash_sql
from reliaspan.operators.cluster import (
    agreement, best_flip_accuracy, kmeans_labels, nearest_neighbours, neighbour_spectrum, silhouette, spectral_neighbour_labels,
)
from reliaspan.operators.evaluate import class_weights, cross_validate, fold_covariates, gated_coverage, reduce_dimensions, reliability_weight, score_metrics, standardise, to_vectors
from reliaspan.operators.grid import assign, clustering_p, members, run_grid, splits
from reliaspan.operators.mixture import mixture_labels
from reliaspan.operators.sampling import stratified_folds
from reliaspan.operators.stats import cohens_d
from reliaspan.sources.panels import embedding_edges, read_table
from pyspark.ml.functions import vector_to_array

FOLDS_SQL = f"""B AS (SELECT vec_id AS subject_id, CAST(label % 2 AS INTEGER) AS label, CAST(embedding[1] AS DOUBLE) AS rho, CAST(embedding[2] AS DOUBLE) AS score,
  CASE WHEN vec_id % 9 = 0 THEN NULL ELSE 18.0 + vec_id % 40 END AS age, CASE WHEN vec_id % 3 = 0 THEN 'M' ELSE 'F' END AS sex, CAST(label % 5 AS INTEGER) AS site FROM embeddings),
FO AS (SELECT B.*, CAST((row_number() OVER (PARTITION BY label ORDER BY {hash_sql('subject_id', '42', '0', "'fold'")}, subject_id) - 1) % 5 AS INTEGER) AS own FROM B),
FT AS (SELECT FO.*, CAST(f.f AS INTEGER) AS fold, own <> f.f AS is_train FROM FO CROSS JOIN range(5) f(f))"""


def subjects(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("subject_id"), (F.col("label") % 2).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec"),
        F.col("embedding")[0].cast("double").alias("rho"), F.col("embedding")[1].cast("double").alias("score"),
        F.when(F.col("vec_id") % 9 == 0, None).otherwise(18.0 + F.col("vec_id") % 40).alias("age"),
        F.when(F.col("vec_id") % 3 == 0, "M").otherwise("F").alias("sex"), (F.col("label") % 5).cast("int").alias("site"),
    )


@query(
    "gated_coverage",
    "WITH " + FOLDS_SQL
    + f""", C AS (SELECT fold, quantile_cont(rho, 0.5) AS cut FROM FT WHERE is_train GROUP BY 1),
      K AS (SELECT FT.* FROM FT JOIN C USING (fold) WHERE rho >= cut),
      P AS (SELECT fold, label, count(*) FILTER (WHERE is_train) AS tr, count(*) FILTER (WHERE NOT is_train) AS te FROM K GROUP BY 1, 2),
      A AS (SELECT fold, count(*) FILTER (WHERE NOT is_train) AS n_all FROM FT GROUP BY 1)
      SELECT CAST(0 AS INTEGER) AS repeat, fold, CAST(sum(tr) AS BIGINT) AS n_train, CAST(sum(te) AS BIGINT) AS n_test,
      count(*) FILTER (WHERE tr > 0) >= 2 AND count(*) FILTER (WHERE te > 0) >= 2 AND min(tr) >= 20 AND min(te) >= 5 AS valid, {q6('sum(te) / any_value(n_all)', 'coverage')} FROM P JOIN A USING (fold) GROUP BY fold""",
)
def gated_coverage_query(spark, sf_dir):
    folded = stratified_folds(subjects(spark, sf_dir).select("subject_id", "label", "rho"), 5, 42)
    out = gated_coverage(folded, 0.5, 20, 5, 5)
    return out.select("repeat", "fold", "n_train", "n_test", "valid", r6("coverage"))


@query(
    "fold_covariates",
    "WITH " + FOLDS_SQL
    + f""", M AS (SELECT fold, avg(age) FILTER (WHERE is_train) AS m, stddev_pop(age) FILTER (WHERE is_train) AS s FROM FT GROUP BY 1)
      SELECT fold, subject_id, is_train, {q6('(coalesce(age, m) - m) / s', 'age_z')}, CASE WHEN sex = 'M' THEN 1.0 ELSE 0.0 END AS sex_m,
      CASE WHEN EXISTS (SELECT 1 FROM FT t WHERE t.fold = FT.fold AND t.is_train AND t.site = FT.site) THEN 1.0 ELSE 0.0 END AS known_site FROM FT JOIN M USING (fold)""",
)
def fold_covariates_query(spark, sf_dir):
    folded = stratified_folds(subjects(spark, sf_dir).drop("vec"), 5, 42).withColumnRenamed("fold", "own")
    rows = folded.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(5)]))).withColumn("is_train", F.col("own") != F.col("fold"))
    out = fold_covariates(rows, ["fold"])
    known = F.aggregate("site_onehot", F.lit(0.0), lambda a, b: a + b)
    return out.select("fold", "subject_id", "is_train", r6("age_z"), "sex_m", known.alias("known_site"))


@query(
    "auc_ap_balanced_accuracy",
    "WITH " + FOLDS_SQL
    + f""", U AS (SELECT site AS run, label, score, CASE WHEN score > 0 THEN 1 ELSE 0 END AS pred FROM (SELECT * REPLACE (CAST(subject_id % 3 AS INTEGER) AS site, round(score, 1) AS score) FROM B)),
      R AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2.0 AS rk FROM U),
      N AS (SELECT run, sum(label) AS p, sum(1 - label) AS q, count(*) AS n, (avg(pred) FILTER (WHERE label = 1) + avg(1 - pred) FILTER (WHERE label = 0)) / 2 AS bal,
        (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc FROM R GROUP BY 1),
      G AS (SELECT run, score, sum(label) AS pos, count(*) AS c FROM U GROUP BY 1, 2),
      H AS (SELECT *, sum(pos) OVER w AS tp, sum(c) OVER w AS seen FROM G WINDOW w AS (PARTITION BY run ORDER BY score DESC)),
      A AS (SELECT run, sum(pos * tp / seen) AS ap FROM H GROUP BY 1)
      SELECT run, CAST(n AS BIGINT) AS n, {q6('bal', 'balanced_acc')}, {q6('auc', 'roc_auc')}, {q6('ap / p', 'auprc')} FROM N JOIN A USING (run)""",
)
def auc_ap_balanced_accuracy(spark, sf_dir):
    rows = subjects(spark, sf_dir).select(
        (F.col("subject_id") % 3).cast("int").alias("run"), "label", F.round("score", 1).alias("score"), 
    ).withColumn("prediction", F.when(F.col("score") > 0, 1).otherwise(0))
    out = score_metrics(rows, ["run"])
    return out.select("run", "n", r6("balanced_acc"), r6("roc_auc"), r6("auprc"))


@query(
    "standardised_features",
    f"""WITH X AS (SELECT vec_id AS subject_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
      Z AS (SELECT subject_id, pos, (CAST(v AS DOUBLE) - avg(CAST(v AS DOUBLE)) OVER (PARTITION BY pos)) / stddev_pop(CAST(v AS DOUBLE)) OVER (PARTITION BY pos) AS z FROM X)
      SELECT subject_id, {q6('sum(z)', 'total')}, {q6('sum(z * z)', 'squares')} FROM Z GROUP BY 1""",
)
def standardised_features(spark, sf_dir):
    rows = to_vectors(subjects(spark, sf_dir))
    z = standardise(rows, [])[0].select("subject_id", vector_to_array("features").alias("z"))
    add = lambda a, b: a + b
    return z.select(
        "subject_id", r6(F.aggregate("z", F.lit(0.0), add), "total"),
        r6(F.aggregate(F.transform("z", lambda v: v * v), F.lit(0.0), add), "squares"),
    )


@query("pca_features")
def pca_features(spark, sf_dir):
    rows = standardise(to_vectors(subjects(spark, sf_dir)), [])[0]
    out = reduce_dimensions(rows, [], 0.9)[0].select("subject_id", vector_to_array("features").alias("v"))
    return out.select("subject_id", F.size("v").alias("n_components"), r6(F.abs(F.col("v")[0]), "first"))


@query(
    "class_weights",
    "WITH " + FOLDS_SQL + f" SELECT subject_id, {q6('pow(greatest(rho, 1e-6), 2) * (SELECT count(*) FROM B) / (2.0 * count(*) OVER (PARTITION BY label))', 'w')} FROM B",
)
def class_weights_query(spark, sf_dir):
    return class_weights(subjects(spark, sf_dir), sample_weight=reliability_weight("rho", 2)).select("subject_id", r6("w"))


@query("classify_cv")
def classify_cv(spark, sf_dir):
    """Out-of-fold metrics of both models, one repeat of three folds."""
    pred = cross_validate(subjects(spark, sf_dir).select("subject_id", "label", "vec"), 3, 42)
    out = score_metrics(pred, ["repeat", "model"])
    return out.select("repeat", "model", "n", r6("balanced_acc"), r6("roc_auc"), r6("auprc"))


@query("classify_gated")
def classify_gated(spark, sf_dir):
    rows = subjects(spark, sf_dir).select("subject_id", "label", "vec", "rho")
    pred = cross_validate(rows, 3, 42, ["logistic_l2"], gate="hard", quantile=0.5, rho="rho")
    out = score_metrics(pred, ["repeat", "model"])
    return out.select("repeat", "model", "n", r6("balanced_acc"), r6("roc_auc"), r6("auprc"))


@query("cluster_kmeans")
def cluster_kmeans(spark, sf_dir):
    rows = subjects(spark, sf_dir)
    lab = kmeans_labels(rows).join(rows.select("subject_id", "label"), "subject_id")
    a, b = agreement(lab, "label", "cluster"), best_flip_accuracy(lab, "label", "cluster")
    one = F.lit(1).alias("one")
    return a.select(one, "ari", "nmi").join(b.select(F.lit(1).alias("one"), "balanced_acc"), "one").select(r6("ari"), r6("nmi"), r6("balanced_acc"))


@query("cluster_mixture")
def cluster_mixture(spark, sf_dir):
    return mixture_labels(subjects(spark, sf_dir))


@query("cluster_spectral")
def cluster_spectral(spark, sf_dir):
    return spectral_neighbour_labels(subjects(spark, sf_dir).select("subject_id", "vec"))


@query("spectral_residuals")
def spectral_residuals(spark, sf_dir):
    """(component, eigenvalue, residual, rounds) of the neighbour graph that cluster_spectral divides."""
    s = neighbour_spectrum(subjects(spark, sf_dir).select("subject_id", "vec"))
    rows = [(i, float(v), float(r), s.rounds) for i, (v, r) in enumerate(zip(s.values, s.residuals, strict=True))]
    return spark.createDataFrame(rows, "component int, eigenvalue double, residual double, rounds int")


DIST = """X AS (SELECT vec_id AS subject_id, CAST(label % 2 AS INTEGER) AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
D AS (SELECT a.subject_id, b.subject_id AS other, a.c, b.c AS oc, list_distance(a.v, b.v) AS d FROM X a JOIN X b ON a.subject_id <> b.subject_id)"""


@query(
    "silhouette",
    f"WITH {DIST}, M AS (SELECT subject_id, c, oc, avg(d) AS m FROM D GROUP BY 1, 2, 3), P AS (SELECT subject_id, max(CASE WHEN c = oc THEN m END) AS a, min(CASE WHEN c <> oc THEN m END) AS b FROM M GROUP BY 1) SELECT {q6('avg((b - a) / greatest(a, b))', 'silhouette')} FROM P",
)
def silhouette_query(spark, sf_dir):
    rows = subjects(spark, sf_dir).select("subject_id", "vec", F.col("label").alias("cluster"))
    return silhouette(rows).select(r6("silhouette"))


@query(
    "nearest_neighbours",
    f"WITH {DIST}, R AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY d, other) AS rn FROM D) SELECT subject_id, other AS neighbour, {q6('d', 'distance')} FROM R WHERE rn <= 10",
)
def nearest_neighbours_query(spark, sf_dir):
    out = nearest_neighbours(subjects(spark, sf_dir).select("subject_id", "vec"))
    return out.select("subject_id", "neighbour", r6("distance"))


@query(
    "feature_effect_sizes",
    f"""WITH X AS (SELECT CAST(label % 2 AS INTEGER) AS g, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings)
      SELECT pos, {q6('(avg(v) FILTER (WHERE g = 1) - avg(v) FILTER (WHERE g = 0)) / sqrt(((count(*) FILTER (WHERE g = 1) - 1) * var_samp(v) FILTER (WHERE g = 1) + (count(*) FILTER (WHERE g = 0) - 1) * var_samp(v) FILTER (WHERE g = 0)) / (count(*) - 2))', 'd')} FROM X GROUP BY 1""",
)
def feature_effect_sizes(spark, sf_dir):
    rows = embedding_edges(spark, sf_dir).withColumn("g", F.col("label") % 2)
    return cohens_d(rows, "g", 1, 0, "value", ["pos"]).select("pos", r6("d"))


#: Repeats, permutations and gate of the classification grid.
REPEATS, NULLS, GATE = 2, 1000, 0.25


def _members(spark, sf_dir):
    return members(subjects(spark, sf_dir).drop("vec", "score"), {"all": F.lit(True), "positive": F.col("rho") > 0})


def _kinds(spark, sf_dir):
    e = F.col("vec")
    kinds = F.array(F.struct(F.lit("plain").alias("kind"), e.alias("vec")), F.struct(F.lit("squares").alias("kind"), F.transform(e, lambda v: v * v).alias("vec")))
    return subjects(spark, sf_dir).select("subject_id", F.explode(kinds).alias("e")).select("subject_id", "e.kind", "e.vec")


@query("classification_grid")
def classification_grid(spark, sf_dir):
    """Two strata, two feature kinds, two models, repeated five-fold splits, with permutation p values of the discriminant."""
    cells, _ = run_grid(_members(spark, sf_dir), _kinds(spark, sf_dir), REPEATS, 42, n_perm=NULLS)
    values = [r6(c) for c in ("coverage", "feature_dim", "rho_mean", "balanced_acc", "roc_auc", "auprc", "balanced_acc_p", "roc_auc_p", "auprc_p")]
    return cells.select("stratum", "repeat", "kind", "model", "n_subjects", "n_cases", "n_sites", "splits", "splits_skipped", "splits_used", "n_eval", *values)


@query("classification_grid_sites")
def classification_grid_sites(spark, sf_dir):
    """The grid over left-out sites with balanced classes, covariates, reliability weights and a hard gate."""
    cells, _ = run_grid(_members(spark, sf_dir), _kinds(spark, sf_dir), 1, 42, "loso", balance=True, gate=GATE, gamma=1.0, covariates=True, min_train=20, min_test=5)
    values = [r6(c) for c in ("coverage", "feature_dim", "rho_mean", "balanced_acc", "roc_auc", "auprc")]
    return cells.select("stratum", "repeat", "kind", "model", "n_subjects", "n_cases", "n_sites", "splits", "splits_skipped", "splits_used", "n_eval", *values)


@query(
    "classification_splits",
    "WITH " + FOLDS_SQL.split("FO AS")[0]
    + f"""M AS (SELECT 'all' AS stratum, * FROM B UNION ALL SELECT 'positive', * FROM B WHERE rho > 0),
      R AS (SELECT M.*, CAST(r.r AS INTEGER) AS repeat FROM M CROSS JOIN range({REPEATS}) r(r)),
      O AS (SELECT *, CAST((row_number() OVER (PARTITION BY stratum, repeat, label ORDER BY {hash_sql('subject_id', '42', 'repeat', "'fold'")}, subject_id) - 1) % 5 AS INTEGER) AS own FROM R),
      T AS (SELECT O.*, CAST(f.f AS INTEGER) AS fold, own <> f.f AS is_train FROM O CROSS JOIN range(5) f(f)),
      C AS (SELECT stratum, repeat, fold, quantile_cont(rho, {GATE}) AS cut FROM T WHERE is_train GROUP BY ALL)
      SELECT stratum, repeat, CAST(fold AS VARCHAR) AS fold, count(*) FILTER (WHERE NOT is_train) AS n_test_all,
      count(*) FILTER (WHERE is_train AND label = 0 AND rho >= cut) AS train0, count(*) FILTER (WHERE is_train AND label = 1 AND rho >= cut) AS train1,
      count(*) FILTER (WHERE NOT is_train AND label = 0 AND rho >= cut) AS test0, count(*) FILTER (WHERE NOT is_train AND label = 1 AND rho >= cut) AS test1,
      CASE WHEN least(train0, train1) < 1 THEN 'one class in training' WHEN least(train0, train1) < 85 THEN 'few training rows of a class' WHEN least(test0, test1) < 20 THEN 'few test rows of a class' END AS skipped
      FROM T JOIN C USING (stratum, repeat, fold) GROUP BY stratum, repeat, fold""",
)
def classification_splits(spark, sf_dir):
    """The gated splits of the grid with their class counts and why some are skipped."""
    _, report = splits(assign(_members(spark, sf_dir), REPEATS, 42), GATE, 85, 20)
    return report.select("stratum", "repeat", "fold", "n_test_all", "train0", "train1", "test0", "test1", "skipped")


def _clustering_sql(within):
    part = "perm" + (", site" if within else "")
    pairs = lambda n: f"sum({n} * ({n} - 1) / 2)"
    return "WITH " + FOLDS_SQL.split("FO AS")[0] + f"""G AS (SELECT subject_id, label, site, CASE WHEN score > 0 THEN 1 ELSE 0 END AS cluster FROM B),
      R AS (SELECT G.*, CAST(p.p AS INTEGER) AS perm FROM G CROSS JOIN range(0, {NULLS + 1}) p(p)),
      A AS (SELECT perm, site, cluster, row_number() OVER (PARTITION BY {part} ORDER BY {hash_sql('subject_id', '7', "'anchor'")}, subject_id) AS rn FROM R WHERE perm > 0),
      Z AS (SELECT perm, site, label, row_number() OVER (PARTITION BY {part} ORDER BY {hash_sql('subject_id', '7', 'perm', "'perm'")}, subject_id) AS rn FROM R WHERE perm > 0),
      U AS (SELECT A.perm, label, cluster FROM A JOIN Z ON A.perm = Z.perm AND A.rn = Z.rn {'AND A.site = Z.site' if within else ''} UNION ALL SELECT perm, label, cluster FROM R WHERE perm = 0),
      N AS (SELECT perm, label, cluster, CAST(count(*) AS DOUBLE) AS n FROM U GROUP BY ALL),
      W AS (SELECT perm, label, sum(n) AS n FROM N GROUP BY ALL), V AS (SELECT perm, cluster, sum(n) AS n FROM N GROUP BY ALL),
      C2 AS (SELECT perm, {pairs('n')} AS c2, sum(n) AS n, sum(n * ln(n)) AS cl FROM N GROUP BY 1), A2 AS (SELECT perm, {pairs('n')} AS a2, sum(n * ln(n)) AS al FROM W GROUP BY 1), B2 AS (SELECT perm, {pairs('n')} AS b2, sum(n * ln(n)) AS bl FROM V GROUP BY 1),
      H AS (SELECT perm, avg(coalesce(k.n, 0) / W.n) AS acc FROM W LEFT JOIN (SELECT perm, label, n FROM N WHERE label = cluster) k USING (perm, label) GROUP BY 1),
      E AS (SELECT perm, (c2 - a2 * b2 / (n * (n - 1) / 2)) / ((a2 + b2) / 2 - a2 * b2 / (n * (n - 1) / 2)) AS ari,
        greatest(cl / n - al / n - bl / n + ln(n), 0) / ((2 * ln(n) - al / n - bl / n) / 2) AS nmi, greatest(acc, 1 - acc) AS balanced_acc FROM C2 JOIN A2 USING (perm) JOIN B2 USING (perm) JOIN H USING (perm)),
      L AS (UNPIVOT E ON ari, nmi, balanced_acc INTO NAME metric VALUE v)
      SELECT o.metric, {q6('o.v', 'observed')}, {q6(f'(1 + (SELECT count(*) FROM L WHERE L.metric = o.metric AND perm > 0 AND round(L.v, 9) >= round(o.v, 9))) / {NULLS + 1}.0', 'p')} FROM L o WHERE perm = 0"""


def _clustering_p(spark, sf_dir, within):
    rows = subjects(spark, sf_dir).select("subject_id", "label", "site", F.when(F.col("score") > 0, 1).otherwise(0).alias("cluster"))
    return clustering_p(rows, NULLS, 7, ["site"] if within else []).select("metric", r6("observed"), r6("p"))


@query("clustering_permutation_p", _clustering_sql(False))
def clustering_permutation_p(spark, sf_dir):
    return _clustering_p(spark, sf_dir, False)


@query("clustering_permutation_p_within_site", _clustering_sql(True))
def clustering_permutation_p_within_site(spark, sf_dir):
    return _clustering_p(spark, sf_dir, True)
