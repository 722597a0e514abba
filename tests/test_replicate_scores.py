"""Replicate scores from one packed row per recording."""

import numpy as np
from pyspark.sql import functions as F

from reliaspan.operators.kernels import ar1_kernel
from reliaspan.operators.resample import block_length, block_lengths, pack_recordings, replicate_scores
from reliaspan.operators.connectivity import fc_edges


def test_packed_block_lengths_equal_the_windowed_ones(spark, frames_of, rng):
    walk = rng.normal(size=(40, 3)).cumsum(axis=0)
    walk[:, 1] = 4.0  # a channel that does not vary
    frames = frames_of({0: walk, 1: rng.normal(size=(16, 3)), 2: np.ones((9, 2)), 3: rng.normal(size=(1, 2)), 4: rng.normal(size=(4, 5))})
    packed = pack_recordings(frames)
    got = packed.mapInArrow(ar1_kernel, "subject_id long, rec array<double>, p int, n_rows int, ar1 double").withColumn("block_len", block_length())
    want = {r["subject_id"]: r for r in block_lengths(frames).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 5
    for r in rows:
        w = want[r["subject_id"]]
        assert (r["n_rows"], r["block_len"]) == (w["n_rows"], w["block_len"]) and abs(r["ar1"] - w["ar1"]) < 1e-12


def test_replicate_scores_take_recordings_of_several_shapes_without_windows(spark, frames_of, rng):
    recs = {0: rng.normal(size=(16, 4)), 1: rng.normal(size=(24, 4)), 2: rng.normal(size=(16, 6)), 3: rng.normal(size=(16, 4))}
    frames = frames_of(recs)
    reference = fc_edges(frames)
    all_at_once = replicate_scores(frames, reference, 3, (1, 2), kind=["ledoit_wolf", "pearson"])
    got = {tuple(r[c] for c in ("subject_id", "seed", "kind", "b")): (r["r_obs"], r["r_split"]) for r in all_at_once.collect()}
    assert len(got) == 4 * 2 * 2 * 3
    for s in recs:
        alone = frames.filter(F.col("subject_id") == s)
        for r in replicate_scores(alone, reference.filter(F.col("subject_id") == s), 3, (1, 2), kind=["ledoit_wolf", "pearson"]).collect():
            x = got[r["subject_id"], r["seed"], r["kind"], r["b"]]
            assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(x, (r["r_obs"], r["r_split"])))
    assert "Window" not in replicate_scores(frames, reference, 3)._jdf.queryExecution().toString()
