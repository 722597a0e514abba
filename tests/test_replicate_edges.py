"""Connectivity of bootstrap replicates."""

from pyspark.sql import functions as F

from reliaspan.operators.resample import replicate_edges


def test_replicate_edges_do_not_shuffle_resampled_rows(spark, frames_of, rng):
    frames = frames_of({s: rng.normal(size=(16, 4)) for s in range(3)})
    lengths = frames.groupBy("subject_id").agg(F.count(F.lit(1)).cast("int").alias("n_rows")).withColumn("block_len", F.lit(6))
    edges = replicate_edges(frames, lengths, 3, (1, 2), kind="ledoit_wolf")
    assert edges.count() == 3 * 2 * 3 * 6
    assert "src_t" not in edges._jdf.queryExecution().toString()
