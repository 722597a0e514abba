"""Packed pair moments against plain NumPy."""

import numpy as np
import pytest

from reliaspan.operators import kernels
from reliaspan.operators.connectivity import pair_moments
from tests.tests_support import brute_moments

SCHEMA = "subject_id long, bin int, t int, channels array<int>, x array<double>"


def rows_of(rng, ids_of, subjects=6, bins=(-1, 0, 1, 2)):
    out = []
    for s in [None, *range(subjects)]:
        for b in bins:
            for t in range(int(rng.integers(1, 9))):
                ids = ids_of(rng)
                out.append((s, b, t, ids, [float(v) for v in rng.normal(size=len(ids)) + 2]))
    return out


CASES = {
    "even": lambda rng: [0, 1, 2],
    "uneven": lambda rng: sorted(int(c) for c in rng.choice(5, size=rng.integers(1, 5), replace=False)),
    "parts": lambda rng: list(range(50)),  # 1,275 pairs in two rows
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("cumulate", [False, True])
def test_moments_equal_numpy(spark, rng, case, cumulate):
    rows = rows_of(rng, CASES[case], 3 if case == "parts" else 6)
    frames = spark.createDataFrame(rows, SCHEMA).repartition(5, "t")
    got = pair_moments(frames, ["subject_id", "bin"], norm=True, cumulate=cumulate).collect()
    want = brute_moments(rows, cumulate)
    assert len(got) == len(want)
    for r in got:
        assert np.allclose([r[c] for c in kernels.SUMS], want[r["subject_id"], r["bin"], r["i"], r["j"]], rtol=1e-9), r
    terms = {}
    for r in got:
        terms.setdefault((r["subject_id"], r["bin"]), set()).add(tuple(r[f"_{t}"] for t in kernels.TERMS))
    assert all(len(v) == 1 for v in terms.values())


def test_partial_rows_do_not_carry_pairs(spark, frames_of, rng):
    """One row of a key goes through the shuffle for a run of its rows, not one for each of its channel pairs."""
    frames = frames_of({s: rng.normal(size=(20, 30)) for s in range(3)}).coalesce(1)
    cols = ["subject_id", "channels", "x"]
    partial = frames.select(*cols).sortWithinPartitions("subject_id").mapInArrow(
        kernels.gram_kernel(["subject_id"], True, False), "subject_id long, part int, ids array<int>, n double, sums array<double>, gram array<double>")
    assert partial.count() == 3
    assert "Window" not in pair_moments(frames, norm=True)._jdf.queryExecution().toString()
