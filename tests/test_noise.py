"""Results that rounding noise would decide: equal values that were summed in different orders."""

from pyspark.sql import functions as F

from reliaspan.operators.resample import edge_reliability
from reliaspan.operators.stats import crossover, equivalent_duration

UP = 0.1 + 0.2  # 0.3 and one unit in the last place


def test_replicates_alike_but_for_noise_are_reliable(spark):
    rows = [(0, j, b, 0.3 if b % 2 else UP if j == 1 else 0.3) for j in (1, 2) for b in range(4)]
    rows += [(1, j, b, 0.3 + 0.1 * j * (b % 2)) for j in (1, 2) for b in range(4)]
    got = edge_reliability(spark.createDataFrame(rows, "subject_id int, j int, b int, r double").withColumn("i", F.lit(0)))
    assert {(r["subject_id"], r["j"]): round(r["reliability"], 9) for r in got.collect()} == {(0, 1): 1.0, (0, 2): 1.0, (1, 1): 0.5, (1, 2): 0.0}


def test_equal_curves_do_not_cross(spark):
    rows = [(0, 1, UP, 0.3), (0, 2, 0.3, UP), (0, 3, 0.4, 0.3), (1, 1, 0.4, 0.3), (1, 2, 0.2, 0.3)]
    got = crossover(spark.createDataFrame(rows, "subject_id int, d int, a double, b double"), "d", "a", "b", ["subject_id"]).collect()
    assert [(r["subject_id"], round(r["crossover"], 9)) for r in got] == [(1, 1.5)]


def test_equal_points_of_a_curve_go_by_duration(spark):
    curves = {0: [(1, 0.3), (2, UP), (3, 0.5)], 1: [(1, UP), (2, 0.3), (3, 0.5)]}
    rows = [(s, d, r) for s, c in curves.items() for d, r in c]
    got = equivalent_duration(spark.createDataFrame(rows, "subject_id int, d int, r double"), "d", "r", F.lit(0.3), ["subject_id"]).collect()
    assert {r["subject_id"]: round(r["equivalent"], 9) for r in got} == {0: 2.0, 1: 2.0}
