"""Dense panels are made in as many tasks as the session has."""

from pyspark.sql import functions as F

from reliaspan.operators.clean import densify


def test_grid_rows_are_spread_over_the_tasks(spark):
    samples = spark.range(400).select((F.col("id") % 100).alias("subject_id"), F.lit(0).alias("channel"), (F.col("id") % 3).cast("int").alias("t"), F.lit(1.0).alias("value"))
    out = densify(samples, 10, [0, 1])
    shares = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in shares) == 100 * 2 * 10
    assert max(r["count"] for r in shares) < 1000
    assert out.agg(F.sum("value")).first()[0] == 400.0
