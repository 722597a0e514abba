import numpy as np
import pytest
from pyspark.sql import functions as F

from reliaspan.functions.hashing import seeded_hash
from reliaspan.operators.cluster import agreement, block_count, nearest_neighbours, silhouette, spectral_neighbour_labels
from reliaspan.operators.cohort import balanced_allocation, lookup_strict, positional_join, site_interval
from reliaspan.operators.evaluate import score_metrics
from reliaspan.operators.graph import (
    best_jaccard, block_assignment, communities, connected_components, degree_variance, mark_density, modularity, small_worldness, to_adjacency,
)
from reliaspan.operators.ranking import exact_quantiles, number_by_hash, number_rows, with_value_bucket
from reliaspan.operators.sampling import permuted_labels, stratified_folds
from reliaspan.operators.similarity import fingerprint_ranks
from reliaspan.operators.stats import adjust_p, median_subject
from reliaspan.sources.phenotype import healthy_adults
from reliaspan.sources.recordings import concatenate_subjects, read_manifest, write_manifest, write_missing, write_records
from reliaspan.sources.text import format_matrix, parse_matrix, read_lines


def complete(spark, n, kept):
    rows = [(1, i, j, 1.0 if (i, j) in kept else 0.0, (i, j) in kept) for i in range(n) for j in range(i + 1, n)]
    return spark.createDataFrame(rows, "subject_id long, i int, j int, r double, kept boolean")


def all_pairs(nodes):
    return {(a, b) for a in nodes for b in nodes if a < b}


def test_degree_variance(spark):
    star = {(0, j) for j in range(1, 6)}
    value = lambda n, kept: degree_variance(complete(spark, n, kept)).first()["degree_variance"]
    assert value(5, all_pairs(range(5))) == 0 and value(5, set()) == 0
    assert value(6, star) > 0


def test_density_threshold(spark, rng):
    rows = [(1, i, j, float(rng.normal())) for i in range(20) for j in range(i + 1, 20)]
    m = mark_density(spark.createDataFrame(rows, "subject_id long, i int, j int, r double"), 0.15)
    assert m.agg(F.avg(F.col("kept").cast("double"))).first()[0] == pytest.approx(0.15, abs=0.1)


def test_cliques_are_communities(spark):
    kept = all_pairs(range(10)) | all_pairs(range(10, 20)) | all_pairs(range(20, 30)) | {(9, 10), (19, 20)}
    labels = {r["node"]: r["community"] for r in communities(complete(spark, 30, kept)).collect()}
    assert len(labels) == 30 and len(set(labels.values())) == 3
    assert all(len({labels[n] for n in range(k, k + 10)}) == 1 for k in (0, 10, 20))


def sequential_communities(adj):
    """Louvain of one small graph, node after node: the yardstick for the modularity of the moves on tables."""
    labels, graph, total = np.arange(len(adj)), adj.astype(float), adj.sum()
    while True:
        own, strength, changed, again = np.arange(len(graph)), graph.sum(1), False, total > 0
        while again:
            again = False
            for v in range(len(graph)):
                links = np.array([graph[v, (own == c) & (np.arange(len(graph)) != v)].sum() for c in range(len(graph))])
                load = np.array([strength[own == c].sum() for c in range(len(graph))])
                load[own[v]] -= strength[v]
                gain = np.round(np.where((links > 0) | (np.arange(len(graph)) == own[v]), links - strength[v] * load / total, -np.inf), 9)
                if gain.max() > gain[own[v]]:
                    own[v], again, changed = int(gain.argmax()), True, True
        if not changed:
            return labels
        own = np.unique(own, return_inverse=True)[1]
        labels, side = own[labels], np.eye(own.max() + 1)[own]
        graph = side.T @ graph @ side


def q_of(adj, labels):
    k = adj.sum(1)
    return float(((adj - np.outer(k, k) / adj.sum()) * (labels[:, None] == labels)).sum() / adj.sum())


def test_communities_reach_the_modularity_of_sequential_moves(spark):
    rng = np.random.default_rng(8)
    rows, graphs = [], {}
    for g in range(5):
        n = 14 + 2 * g
        block = np.arange(n) * 3 // n
        a = np.triu(rng.random((n, n)) < np.where(block[:, None] == block, 0.6, 0.08 + 0.02 * g), 1)
        graphs[g] = (a | a.T).astype(float)
        rows += [(g, i, j, bool(a[i, j])) for i in range(n) for j in range(i + 1, n)]
    marked = spark.createDataFrame(rows, "subject_id long, i int, j int, kept boolean")
    got = communities(marked).collect()
    ours, theirs = [], []
    for g, adj in graphs.items():
        labels = np.zeros(len(adj), int)
        for r in got:
            if r["subject_id"] == g:
                labels[r["node"]] = r["community"]
        assert len([r for r in got if r["subject_id"] == g]) == len(adj) and labels[0] == 0
        ours.append(q_of(adj, labels))
        theirs.append(q_of(adj, sequential_communities(adj)))
    assert np.mean(ours) >= np.mean(theirs) - 1e-9 and all(a >= b - 0.03 for a, b in zip(ours, theirs, strict=True))
    again = modularity(marked.filter("kept"), communities(marked)).collect()
    assert {r["subject_id"]: r["modularity"] for r in again} == pytest.approx(dict(enumerate(ours)))


def test_components_and_small_world(spark):
    edges = complete(spark, 7, {(0, 1), (1, 2), (0, 2), (4, 5)})
    nodes = spark.createDataFrame([(1, n) for n in range(7)], "subject_id long, node int")
    comp = {r["node"]: r["component"] for r in connected_components(to_adjacency(edges.filter("kept")), nodes).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    r = small_worldness(edges).first()
    assert (r["n_nodes"], r["clustering"], r["path_length"]) == (3, 1.0, 1.0)
    assert small_worldness(complete(spark, 4, set())).first()["sigma"] is None


def test_jaccard_and_blocks(spark):
    df = spark.createDataFrame([(1, n, n // 5) for n in range(10)], "subject_id long, node int, community int")
    assert all(r["jaccard"] == 1.0 for r in best_jaccard(df, df).collect())
    for n, k in ((70, 7), (100, 7), (49, 7), (50, 7)):
        sizes = spark.range(n).select(block_assignment("id", n, k).alias("b")).groupBy("b").count().collect()
        assert len(sizes) == k and sum(r["count"] for r in sizes) == n


def test_exact_quantiles_with_a_dominant_group(spark, rng):
    x = np.round(rng.normal(size=3000), 2)
    g = np.where(np.arange(3000) % 3 == 0, 1, 0)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, v double")
    for r in exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"]).collect():
        assert [r["q0"], r["q1"], r["q2"]] == pytest.approx(list(np.quantile(x[g == r["g"]], [0.1, 0.5, 0.9])))


def test_numbering_is_a_permutation(spark):
    df = with_value_bucket(spark.range(500).withColumn("v", (F.col("id") * 7919 % 101).cast("double")), "v")
    got = [r["rn"] for r in number_rows(df, [], ["v", "id"], F.col("_vb")).orderBy("v", "id").collect()]
    assert got == list(range(1, 501))


def test_bucket_counts_of_many_groups_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "subjects")
    spark.range(40).write.parquet(path)  # a small file, but groups times buckets of it are many
    rows = spark.read.parquet(path).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(50))))
    numbered = number_by_hash(rows, ["perm"], seeded_hash(F.col("id"), 7, F.col("perm")), ["id"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert numbered.groupBy("perm").agg(F.sum("rn").alias("s")).select("s").distinct().collect()[0]["s"] == 820


def test_folds_and_permutations(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3) for i in range(60)], "subject_id long, label int, site int")
    per = stratified_folds(df, 5, 1).groupBy("fold", "label").count().collect()
    assert len(per) == 10 and all(r["count"] == 6 for r in per)
    perms = permuted_labels(df, 3, 1, within=["site"])
    base = {(r["site"], r["label"]): r["count"] for r in df.groupBy("site", "label").count().collect()}
    for r in perms.groupBy("perm", "site", "label").count().collect():
        assert r["count"] == base[(r["site"], r["label"])]


def test_holm_and_bh(spark):
    df = spark.createDataFrame([(k, 0, p) for k, p in enumerate([0.01, 0.04, 0.03, 0.005])], "t int, f int, p double")
    rows = {r["t"]: (r["holm"], r["bh"]) for r in adjust_p(df, "p", ["f"]).collect()}
    assert [rows[k][0] for k in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [rows[k][1] for k in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_adjusted_p_with_ties_and_missing_values(spark, rng):
    ps = np.where(rng.random(400) < 0.8, 1.0, np.round(rng.random(400) * 0.05, 3))
    rows = [(k, None if k % 2 else "a", float(p)) for k, p in enumerate(ps)] + [(400, "a", None), (401, "a", float("nan"))]
    got = {r["t"]: (r["holm"], r["bh"]) for r in adjust_p(spark.createDataFrame(rows, "t int, f string, p double"), "p", ["f"]).collect()}
    assert len(got) == len(rows) and got[400] == got[401] == (None, None)
    for part in (0, 1):
        at = np.arange(part, 400, 2)
        order = at[np.argsort(ps[at], kind="stable")]
        m = len(order)
        holm = np.maximum.accumulate(np.minimum(1, ps[order] * (m - np.arange(m))))
        bh = np.minimum(1, np.minimum.accumulate((ps[order] * m / np.arange(1, m + 1))[::-1])[::-1])
        assert [got[int(k)][0] for k in order] == pytest.approx(list(holm))
        assert [got[int(k)][1] for k in order] == pytest.approx(list(bh))
    empty = spark.createDataFrame([], "t int, f string, p double")
    assert adjust_p(empty, "p", []).count() == 0


def test_median_subject_with_ties(spark):
    rows = [(f"s{k:03d}", 1.0 if k % 5 else float(k % 7) - 3) for k in range(301)]
    want = sorted(rows, key=lambda r: (r[1], r[0]))[301 // 2]
    df = spark.createDataFrame([*rows, ("none", None)], "subject_id string, v double").repartition(7)
    assert [tuple(r) for r in median_subject(df, "v").collect()] == [want]
    assert median_subject(df.filter("v IS NULL"), "v").count() == 0


def test_first_present_diagnosis_column_counts(spark):
    df = spark.createDataFrame([("a", "", "control"), ("b", "control", "patient"), ("c", "patient", "control")], "participant_id string, diagnosis string, condition string")
    assert [r["participant_id"] for r in healthy_adults(df, "d").collect()] == ["b"]
    assert [r["participant_id"] for r in healthy_adults(df.drop("diagnosis"), "d").orderBy("participant_id").collect()] == ["a", "c"]


def test_score_metrics_against_pairs(spark, rng):
    y, s = rng.integers(0, 2, 200), np.round(rng.normal(size=200), 1)
    df = spark.createDataFrame([(0, int(a), float(b), int(b > 0)) for a, b in zip(y, s)], "run int, label int, score double, prediction int")
    pos, neg = s[y == 1], s[y == 0]
    auc = (np.sum(pos[:, None] > neg[None]) + 0.5 * np.sum(pos[:, None] == neg[None])) / (len(pos) * len(neg))
    assert score_metrics(df, ["run"]).first()["roc_auc"] == pytest.approx(auc)


def test_agreement_extremes(spark):
    df = spark.createDataFrame([(n, n // 5, 1 - n // 5, 0) for n in range(10)], "n int, a int, b int, c int")
    same, flat = agreement(df, "a", "b").first(), agreement(df, "a", "c").first()
    assert same["ari"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)
    assert flat["ari"] == pytest.approx(0) and flat["nmi"] == pytest.approx(0, abs=1e-12)


def test_blocked_distances_match_brute_force(spark, rng, monkeypatch):
    import reliaspan.operators.cluster as cluster

    monkeypatch.setattr(cluster, "BLOCK_ROWS", 16)
    x = np.vstack([rng.normal(size=(80, 3)), rng.normal(size=(80, 3)) + 9])
    rows = spark.createDataFrame([(k, k // 80, [float(v) for v in x[k]]) for k in range(160)], "subject_id long, cluster int, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    c = np.arange(160) // 80
    a = np.array([d[k, c == c[k]].sum() / 79 for k in range(160)])
    b = np.array([d[k, c != c[k]].mean() for k in range(160)])
    assert silhouette(rows).first()["silhouette"] == pytest.approx(float(np.mean((b - a) / np.maximum(a, b))))
    np.fill_diagonal(d, np.inf)
    got = nearest_neighbours(rows.drop("cluster"), 4).groupBy("subject_id").agg(F.sum("distance").alias("s")).collect()
    assert all(r["s"] == pytest.approx(np.sort(d[r["subject_id"]])[:4].sum()) for r in got)
    assert spectral_neighbour_labels(rows.drop("cluster")).select("cluster").distinct().count() == 2


def test_block_count_bounds_rows_and_occupies_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert block_count(spark.range(10)) ** 2 >= cores
    assert 5000 / block_count(spark.range(5000), 100) <= 100


def test_equal_distances_go_to_the_smaller_neighbour(spark):
    rows = spark.createDataFrame([(k, [float(k % 2), 0.0]) for k in range(40)], "subject_id long, vec array<double>")
    got = nearest_neighbours(rows, 3).filter("subject_id = 9").orderBy("neighbour").collect()
    assert [r["neighbour"] for r in got] == [1, 3, 5]


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 24 partitions that are not merged, as on larger tables."""
    set_to = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_every_block_pair_meets_in_many_partitions(spark, rng, many_partitions, monkeypatch):
    import reliaspan.operators.cluster as cluster

    monkeypatch.setattr(cluster, "BLOCK_ROWS", 16)
    x = rng.normal(size=(90, 3))
    x[30:60] = x[:30]  # copies: distance 0, and all others at equal distance to both
    rows = spark.createDataFrame([(k, k % 2, [float(v) for v in x[k]]) for k in range(90)], "subject_id long, cluster int, vec array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = nearest_neighbours(rows.drop("cluster"), 4).orderBy("subject_id", "distance", "neighbour").collect()
    assert [(r["subject_id"], r["neighbour"]) for r in got] == [(k, int(n)) for k in range(90) for n in np.argsort(d[k], kind="stable")[:4]]
    assert all(r["distance"] == 0.0 for r in got if {r["subject_id"] % 30, r["neighbour"] % 30} == {r["subject_id"] % 30} and max(r["subject_id"], r["neighbour"]) < 60)
    vectors = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=8)]) for k in range(90)], "subject_id long, vec array<double>")
    assert {r["rank"] for r in fingerprint_ranks(vectors, vectors.selectExpr("subject_id", "transform(vec, v -> -v) AS vec"), block_rows=16).collect()} == {90}


def test_subjects_with_text_ids_are_laid_end_to_end(spark):
    ids = [f"sub-{k:02d}" for k in range(20)]
    subjects = spark.createDataFrame([(s, 1 + k % 3) for k, s in enumerate(ids)], "subject_id string, n_rows long")
    samples = spark.createDataFrame([(s, 0, t, float(t)) for k, s in enumerate(ids) for t in range(1 + k % 3)], "subject_id string, channel int, t int, value double")
    got = concatenate_subjects(samples, subjects).orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(len(got))) and [r["subject_id"] for r in got] == sorted(r["subject_id"] for r in got)


def test_fingerprints_identify_copies(spark, rng):
    x = rng.normal(size=(130, 8))
    mk = lambda m: spark.createDataFrame([(k, [float(v) for v in m[k]]) for k in range(len(m))], "subject_id long, vec array<double>")
    assert {r["rank"] for r in fingerprint_ranks(mk(x + 1e-3 * rng.normal(size=x.shape)), mk(x)).collect()} == {1}


def test_lookups(spark):
    sites = spark.createDataFrame([("UM_1",), ("nyu",), ("Elsewhere",)], "s string")
    assert [r[0] for r in sites.select(site_interval("s")).collect()] == [2.0, 2.0, 2.0]
    assert spark.range(1).select(site_interval(F.lit("x_olin_2"))).first()[0] == 1.5
    with pytest.raises(KeyError):
        lookup_strict(spark.range(3), spark.range(2), "id")
    with pytest.raises(ValueError):
        positional_join(spark.range(3).withColumnRenamed("id", "pos"), spark.range(2).withColumnRenamed("id", "pos"))


def test_allocation_adds_up(spark):
    pools = spark.createDataFrame([("a", 50), ("b", 30), ("c", 1)], "dataset string, pool long")
    got = {r["dataset"]: r["n_alloc"] for r in balanced_allocation(pools, 20).collect()}
    assert sum(got.values()) == 20 and got["c"] == 1 and got["a"] > got["b"]


def test_text_files(spark, tmp_path, frames_of, rng):
    x = rng.integers(0, 99, size=(40, 4)).astype(float)
    lines = format_matrix(frames_of({7: x})).orderBy("line_no").collect()
    (tmp_path / "sub7.1D").write_text("# header\n" + "\n".join(r["line"] for r in lines) + "\n")
    (tmp_path / "tiny.1D").write_text("1 2\n3 4\n")
    got = parse_matrix(read_lines(spark, str(tmp_path)))
    assert {r[0] for r in got.select("subject_id").distinct().collect()} == {"sub7"}
    assert {(r["t"], r["channel"]): r["value"] for r in got.collect()} == {(t, c): x[t, c] for t in range(40) for c in range(4)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.12345678), (1, 0.5)], "subject_id long, v double")
    write_records(rows, str(tmp_path / "csv"), ["subject_id"])
    back = spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True)
    assert sorted((r["subject_id"], r["v"]) for r in back.collect()) == [(1, 0.5), (2, 0.123457)]
    write_manifest(rows.withColumn("n_trs", F.lit(100)).withColumn("tr", F.lit(2.0)), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    (tmp_path / "one.json").write_text('[{"subject_id": 1, "n_trs": 100, "tr": 2.0}]')
    assert read_manifest(spark, str(tmp_path / "one.json"), 40).first()["k"] == 2.5
    store = str(tmp_path / "store")
    write_missing(rows.filter("subject_id = 1"), None, store)
    write_missing(rows, spark.read.parquet(store), store)
    assert spark.read.parquet(store).count() == 2


def test_catalog_contract(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 3
