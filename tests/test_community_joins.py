"""The steps of the community search send no table to the driver."""

from reliaspan.operators.graph import _beside


def test_small_tables_of_a_step_meet_in_the_tasks(spark):
    left = spark.createDataFrame([(s, n, 1.0) for s in range(3) for n in range(4)], "subject_id int, node int, k double")
    right = left.groupBy("subject_id").sum("k")
    out = _beside(left, right, ["subject_id"])
    assert out.count() == 12
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert _beside(left, right.limit(0), ["subject_id"], "left").count() == 12
