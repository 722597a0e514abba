"""Similarities of nearly constant connectivity."""

import numpy as np

from reliaspan.operators import kernels
from reliaspan.operators.connectivity import moment_corr


def test_nearly_constant_values_count_as_constant(spark):
    """As the SQL does: both variances have to be above 1e-14, whatever their product."""
    rng = np.random.default_rng(0)
    b = rng.normal(size=40)
    a = {0: 5e-8 * rng.normal(size=40), 1: 2e-7 * rng.normal(size=40)}
    assert a[0].var() < 1e-14 < a[1].var()
    rows = [(s, float(x), float(y)) for s, v in a.items() for x, y in zip(v, b)]
    got = {r["s"]: r["r"] for r in spark.createDataFrame(rows, "s int, a double, b double").groupBy("s").agg(moment_corr("a", "b", strict=True).alias("r")).collect()}
    assert got[0] is None and abs(got[1] - np.corrcoef(a[1], b)[0, 1]) < 1e-9
    kernel = kernels._corr(np.array([a[0], a[1]]), b)
    assert np.isnan(kernel[0]) and abs(kernel[1] - got[1]) < 1e-9
