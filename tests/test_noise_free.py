"""Curves whose values are compared to the last digit, as the SQL of the curve queries does."""

from pyspark.sql import functions as F

from reliaspan.operators.stats import crossover, equivalent_duration

UP = 0.1 + 0.2  # 0.3 and one unit in the last place


def test_curves_cross_by_one_unit_in_the_last_place(spark):
    rows = [(0, 1, UP, 0.3), (0, 2, 0.3, UP), (0, 3, 0.4, 0.3)]
    got = crossover(spark.createDataFrame(rows, "subject_id int, d int, a double, b double"), "d", "a", "b", ["subject_id"], noise=0.0).collect()
    assert [(r["subject_id"], r["crossover"]) for r in got] == [(0, 1.5)]


def test_points_of_a_curve_go_by_the_last_digit(spark):
    rows = [(0, 1, UP), (0, 2, 0.3), (0, 3, 0.5)]
    got = equivalent_duration(spark.createDataFrame(rows, "subject_id int, d int, r double"), "d", "r", F.lit(0.3), ["subject_id"], noise=0.0).collect()
    assert got[0]["equivalent"] == 2.0  # the first point, not the second of a tie
    rows = [(0, 1, UP), (0, 2, 0.3 - 5.6e-17), (0, 3, 0.5)]
    got = equivalent_duration(spark.createDataFrame(rows, "subject_id int, d int, r double"), "d", "r", F.lit(0.3), ["subject_id"], noise=0.0).collect()
    assert 1.0 < got[0]["equivalent"] < 2.0


def test_curve_queries_equal_their_sql(spark, tmp_path):
    """Every value of a curve is 0.05 but for the order of its sum, which one file leaves no choice of."""
    import duckdb
    import numpy as np

    from __spark_entry__ import oracle_sql, queries

    rng = np.random.default_rng(1)
    data = [(s, float(q), float(d), float(t)) for s in range(40) for q in range(0, 50, 10) for d, t in zip(rng.permutation(np.arange(11)) / 100, rng.permutation(np.arange(11)) / 100)]
    schema = "l_suppkey long, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name, value in (("crossover_duration", "crossover"), ("equivalent_duration", "equivalent")):
        want = {r[0]: r[1] for r in con.execute(f"SELECT subject_id, {value} FROM ({oracle_sql()[name]})").fetchall()}
        got = {r["subject_id"]: r[value] for r in queries()[name](spark, str(tmp_path)).collect()}
        assert want and got == want
