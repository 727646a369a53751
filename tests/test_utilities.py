"""Acquisition utilities and the functions below them."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolscout.config import RunConfig, batch_rows, budget_rows, top_k_rows
from poolscout.functions import scaling
from poolscout.functions.gaussian import pdf, phi
from poolscout.functions.random import normal, uniform
from poolscout.functions.utility import UtilityOptions, check_supported, with_utility


def frame(spark, size=100, zero=False, seed=0):
    rng = np.random.default_rng(seed)
    var = np.zeros(size) if zero else rng.uniform(0, 0.1, size)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(size), "y_mean": size * rng.standard_normal(size), "y_var": var}))


def test_phi_matches_the_error_function(spark):
    z = np.arange(-9, 9, 0.01)
    rows = spark.createDataFrame(pd.DataFrame({"z": z})).select("z", phi(F.col("z")).alias("p"), pdf(F.col("z")).alias("d")).toPandas()
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in rows["z"]]
    assert np.abs(rows["p"] - want).max() < 1e-14
    assert np.allclose(rows["d"], np.exp(-rows["z"] ** 2 / 2) / math.sqrt(2 * math.pi))
    assert spark.range(1).select(phi(F.lit(None).cast("double")).alias("p")).first()["p"] is None


def test_uniform_is_uniform_and_stable(spark):
    ids = spark.range(20_000)
    once = ids.select("id", uniform(F.col("id"), 1).alias("u"), normal(F.col("id"), 5).alias("n")).toPandas()
    again = ids.repartition(13).select("id", uniform(F.col("id"), 1).alias("u")).toPandas().sort_values("id")
    assert (once["u"].to_numpy() == again["u"].to_numpy()).all()
    assert 0 <= once["u"].min() and once["u"].max() < 1
    assert abs(once["u"].mean() - 0.5) < 0.01 and abs(once["n"].mean()) < 0.03 and abs(once["n"].std() - 1) < 0.03


def test_greedy_is_the_mean(spark):
    rows = with_utility(frame(spark), "greedy").toPandas()
    assert (rows["utility"] == rows["y_mean"]).all()


def test_noisy_stays_near_the_mean(spark):
    data = frame(spark)
    rows = with_utility(data, "noisy", mean_sd=data.agg(F.stddev_pop("y_mean").alias("s")).scalar()).toPandas()
    assert (np.abs(rows["utility"] - rows["y_mean"]) <= 5 * rows["y_mean"].std(ddof=0)).all()
    assert (rows["utility"] != rows["y_mean"]).any()


@pytest.mark.parametrize("beta", [0, 1, 2, 4])
def test_bounds(spark, beta):
    options = UtilityOptions(beta=beta)
    up = with_utility(frame(spark), "ucb", options).toPandas()
    low = with_utility(frame(spark), "lcb", options).toPandas()
    assert np.allclose(up["utility"], up["y_mean"] + beta * np.sqrt(up["y_var"]))
    assert np.allclose(low["utility"], low["y_mean"] - beta * np.sqrt(low["y_var"]))


def test_thompson(spark):
    certain = with_utility(frame(spark, zero=True), "thompson").toPandas()
    assert np.allclose(certain["utility"], certain["y_mean"])
    drawn = with_utility(frame(spark), "ts", UtilityOptions(stochastic=True)).toPandas()
    assert (drawn["utility"] == drawn["y_mean"]).all()
    assert (with_utility(frame(spark), "ts").toPandas()["utility"] != drawn["y_mean"]).all()


@pytest.mark.parametrize("best", [-1.0, 0.0, 1000.0])
@pytest.mark.parametrize("xi", [0.0, 0.01, 0.1])
def test_improvement(spark, best, xi):
    options = UtilityOptions(xi=xi)
    for zero in (True, False):
        data = frame(spark, zero=zero)
        ei = with_utility(data, "ei", options, best=F.lit(best)).toPandas()
        pi = with_utility(data, "pi", options, best=F.lit(best)).toPandas()
        gain = ei["y_mean"] - best + xi
        if zero:
            assert np.allclose(ei["utility"], gain)
            assert (pi["utility"] == (gain > 0)).all()
        else:
            z = gain / np.sqrt(ei["y_var"])
            cdf = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
            dens = np.exp(-z**2 / 2) / math.sqrt(2 * math.pi)
            assert np.allclose(ei["utility"], gain * cdf + np.sqrt(ei["y_var"]) * dens, atol=1e-9)
            assert (ei["utility"] >= -1e-9).all() and np.allclose(pi["utility"], cdf)


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 5.0, 1000.0])
def test_threshold(spark, threshold):
    rows = with_utility(frame(spark), "threshold", UtilityOptions(threshold=threshold)).toPandas()
    below = rows["y_mean"] < threshold
    assert (rows.loc[below, "utility"] == -1).all()
    assert rows.loc[~below, "utility"].between(0, 1).all()


def test_unknown_metric_and_missing_variance():
    with pytest.raises(ValueError):
        check_supported("best", {"means"})
    with pytest.raises(ValueError):
        check_supported("lcb", {"means"})
    check_supported("ucb", {"means", "vars"})


def test_one_hot_and_softplus(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", 800.0), ("z", -800.0), (None, 1.0)], "v STRING, x DOUBLE")
    got = rows.select(scaling.one_hot_with_unknown(F.col("v"), ["a", "b"]).alias("h"), scaling.softplus(F.col("x")).alias("s")).collect()
    assert [r["h"] for r in got] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1]]
    assert [round(r["s"], 6) for r in got] == [0.693147, 800.0, 0.0, 1.313262]


def test_scaling_round_trip(spark):
    rows = spark.createDataFrame([(3.0,), (None,), (float("nan"),)], "x DOUBLE")
    z = scaling.standardise(F.col("x"), F.lit(1.0), F.lit(2.0), missing=0.0)
    got = rows.select(z.alias("z"), scaling.unstandardise(z, F.lit(1.0), F.lit(2.0)).alias("x")).collect()
    assert [(r["z"], r["x"]) for r in got] == [(1.0, 3.0), (0.0, 1.0), (0.0, 1.0)]


@given(st.floats(0, 1), st.integers(1, 10**6))
@settings(max_examples=50, deadline=None)
def test_sizes(fraction, rows):
    assert batch_rows(fraction, rows) == math.ceil(fraction * rows)
    assert 1 <= top_k_rows(fraction, rows) <= rows
    assert top_k_rows(rows + 5, rows) == rows and batch_rows(7, rows) == 7


def test_bad_options():
    for call in (lambda: batch_rows(1.5, 10), lambda: batch_rows(-1, 10), lambda: budget_rows(0, 10), lambda: top_k_rows(0, 5)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        RunConfig(epsilon=2.0)
    with pytest.raises(ValueError):
        RunConfig(prune_min_hit_prob=-0.1)
    assert [RunConfig(batch_sizes=(5, 7)).batch_size(i) for i in range(4)] == [5, 7, 7, 7]
