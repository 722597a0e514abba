import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from reliaspan import EstimatorConfig
from reliaspan.functions.reliability import (
    CORRECTION_METHODS, bayes_shrink, correct_attenuation, correct_by_name, fisher_z, fisher_z_inv, spearman_brown,
)
from reliaspan.functions.special import beta_inc, t_two_sided


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_config_defaults_and_derived():
    c = EstimatorConfig()
    assert (c.short_samples, c.target_samples, c.k_factor) == (120, 900, 7.5)
    assert EstimatorConfig(tr=2.9, short_duration_sec=30).short_samples == 10
    with pytest.raises(dataclasses.FrozenInstanceError):
        c.tr = 2.0


@pytest.mark.parametrize("r", [0.0, 0.3, 0.5, 0.8, -0.5])
def test_z_round_trip(spark, r):
    assert value(spark, fisher_z_inv(fisher_z(F.lit(r)))) == pytest.approx(r, abs=1e-4)


def test_z_is_finite_outside_the_range(spark):
    assert math.isfinite(value(spark, fisher_z(F.lit(1.5))))
    assert value(spark, fisher_z(F.lit(None).cast("double"))) is None


def test_spearman_brown(spark):
    assert value(spark, spearman_brown(F.lit(0.5), 1)) == pytest.approx(0.5)
    grown = [value(spark, spearman_brown(F.lit(0.3), k)) for k in (1, 2, 4, 8, 16, 100)]
    assert grown == sorted(grown) and grown[-1] < 1


def test_prior_pulls_towards_its_mean(spark):
    assert value(spark, bayes_shrink(F.lit(0.9))) == pytest.approx(0.9)
    assert 0.25 < value(spark, bayes_shrink(F.lit(0.9), 0.25, 0.05)) < 0.9


@pytest.mark.parametrize("method", CORRECTION_METHODS)
def test_methods_stay_bounded_and_keep_missing(spark, method):
    for r_obs in (-0.99, 0.0, 0.4, 0.99):
        v = value(spark, correct_attenuation(F.lit(r_obs), 0.98, F.lit(0.01), 7.5, (0.25, 0.05), method))
        assert -1 <= v <= 1
    assert value(spark, correct_attenuation(F.lit(0.5), 0.98, F.lit(None).cast("double"), 7.5, None, method)) is None
    same = value(spark, correct_by_name(F.lit(method), F.lit(0.4), 0.98, F.lit(0.6), 4))
    assert same == pytest.approx(value(spark, correct_attenuation(F.lit(0.4), 0.98, F.lit(0.6), 4, None, method)))


def test_unknown_method_is_refused():
    with pytest.raises(ValueError):
        correct_attenuation(0.5, 0.98, 0.5, 2, method="other")


def test_t_tail(spark):
    p = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (-3.5, 49.0)], "t double, df double").select(t_two_sided("t", "df").alias("p"))
    got = [r["p"] for r in p.collect()]
    assert got == pytest.approx([0.073388, 1.0, 0.0010005], abs=2e-6)
    assert beta_inc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-10)
