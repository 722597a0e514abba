"""Small-world measures of networks in one row equal those of networks in tables."""

import pytest
from pyspark.sql import functions as F

import reliaspan.operators.graph as graph


@pytest.fixture
def networks(spark, rng):
    rows = []
    for s in range(40):  # from empty to complete, some in two parts of equal size, one of two nodes
        p, share = (2, 1.0) if s == 7 else (int(rng.integers(3, 13)), s / 39)
        for i in range(p):
            for j in range(i + 1, p):
                apart = s % 4 == 1 and (i < p // 2) != (j < p // 2)
                rows.append((s, 10 * i + 3, 10 * j + 3, bool(rng.random() < share and not apart)))
    return spark.createDataFrame(rows, "subject_id long, i int, j int, kept boolean").repartition(5)


def measures(df):
    return {r["subject_id"]: tuple(r)[1:] for r in df.collect()}


def test_rows_and_tables_agree(networks, monkeypatch):
    packed = measures(graph.small_worldness(networks))
    monkeypatch.setattr(graph, "PACKED_PAIRS", 20)
    mixed = measures(graph.small_worldness(networks))
    assert packed.keys() == mixed.keys() == set(range(40))
    for s, want in mixed.items():
        assert packed[s] == pytest.approx(want, nan_ok=True), s


def test_networks_of_bounded_size_need_few_jobs(spark, networks, monkeypatch):
    monkeypatch.setattr(graph, "connected_components", lambda *_: pytest.fail("rounds of joins over all networks"))
    assert graph.small_worldness(networks).filter(F.col("sigma").isNotNull()).count() > 20
