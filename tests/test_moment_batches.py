"""Pair moments of keys that never are NULL, in more batches than one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliaspan.operators import kernels
from reliaspan.operators.connectivity import pair_moments
from tests.test_moments import CASES, SCHEMA, rows_of
from tests.tests_support import brute_moments


@pytest.mark.parametrize("case", ["even", "uneven"])
def test_moments_of_labelled_segments_in_small_batches(spark, rng, case):
    rows = rows_of(rng, CASES[case])
    frames = spark.createDataFrame(rows, SCHEMA).withColumn("seg", F.concat(F.lit("s"), F.when(F.col("bin") < 1, "a").otherwise("b"))).repartition(5, "t")
    want = brute_moments([(s, "sa" if b < 1 else "sb", *rest) for s, b, *rest in rows], False)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert not frames.schema["seg"].nullable
        got = pair_moments(frames, ["subject_id", "seg"], norm=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(want)
    for r in got:
        assert np.allclose([r[c] for c in kernels.SUMS], want[r["subject_id"], r["seg"], r["i"], r["j"]], rtol=1e-9), r
