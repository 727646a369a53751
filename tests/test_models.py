"""Surrogates by their properties, and whole runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolscout.config import RunConfig
from poolscout.operators.clusters import cluster_pool
from poolscout.operators.objectives import lookup_objective
from poolscout.plans.explore import Exploration, gained_little, sweep
from poolscout.session import scratch_path
from poolscout.surrogate.base import training_rows
from poolscout.surrogate.ensembles import member_stats
from poolscout.surrogate.factory import make_surrogate
from poolscout.surrogate.linear import GaussianProcessSurrogate

N = 400


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((N, 6))
    y = x @ np.array([3.0, -2.0, 1.0, 0.0, 0.5, 0.0]) + 4.0 + 0.05 * rng.standard_normal(N)
    return pd.DataFrame({"id": np.arange(N), "features": list(x), "score": y})


@pytest.fixture(scope="module")
def pool(spark, data):
    return spark.createDataFrame([(int(i), f.tolist()) for i, f in zip(data["id"], data["features"])], "id long, features array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.createDataFrame(data[["id", "score"]]).cache()


MODELS = [
    ("rf", None, {"trees": 10, "max_depth": 6}), ("gp", None, {}), ("gp", None, {"kernel": "rbf", "scale": 3.0}),
    ("gp", None, {"kernel": "matern", "scale": 3.0}), ("nn", None, {}), ("nn", None, {"kind": "gbt"}), ("nn", "ensemble", {}),
    ("nn", "mve", {}), ("nn", "dropout", {}), ("random", None, {}),
]


@pytest.mark.parametrize("name,conf,options", MODELS)
def test_fit_predict_save_load(spark, pool, labels, name, conf, options):
    model = make_surrogate(name, conf, **options)
    model.fit(pool.join(labels, "id"))
    got = model.predict(pool, mean_only=False).join(labels, "id").toPandas().sort_values("id")
    assert len(got) == N and got["y_mean"].notna().all()
    if "vars" in model.provides:
        assert (got["y_var"] >= 0).all() and got["y_var"].max() > 0
        assert model.predict(pool).filter("y_var IS NOT NULL").count() == 0
    if name != "random":
        assert np.corrcoef(got["y_mean"], got["score"])[0, 1] > 0.8
    path = scratch_path(spark, "model")
    model.save(path)
    again = make_surrogate(name, conf, **options).load(path).predict(pool, mean_only=False).toPandas().sort_values("id")
    assert np.allclose(again["y_mean"], got["y_mean"])
    if "vars" in model.provides:
        assert np.allclose(again["y_var"], got["y_var"])


def test_forest_mean_is_the_mean_of_its_trees(pool, labels):
    model = make_surrogate("rf", trees=7, max_depth=4).fit(pool.join(labels, "id"))
    a = model.predict(pool, mean_only=True).toPandas().sort_values("id")["y_mean"].to_numpy()
    b = model.predict(pool, mean_only=False).toPandas().sort_values("id")["y_mean"].to_numpy()
    assert np.allclose(a, b)


def test_process_equals_bayesian_regression(pool, labels, data):
    model = GaussianProcessSurrogate("dotproduct").fit(pool.join(labels, "id"))
    x = np.hstack([np.ones((N, 1)), np.vstack(data["features"])])
    y = (data["score"].to_numpy() - data["score"].mean()) / data["score"].std(ddof=0)
    ridge = np.linalg.solve(x.T @ x + 1e-3 * np.eye(7), x.T @ y)
    noise = max(((y - x @ ridge) ** 2).sum() / (N - 7), 1e-6)
    cov = np.linalg.inv(x.T @ x / noise + np.eye(7))
    assert np.allclose(model.weights, cov @ x.T @ y / noise, atol=1e-8)
    got = model.predict(pool, mean_only=False).toPandas().sort_values("id")
    assert np.allclose(got["y_var"], np.einsum("ij,jk,ik->i", x, cov, x) * data["score"].std(ddof=0) ** 2)


def test_unknown_names():
    for call in (lambda: make_surrogate("svm"), lambda: make_surrogate("nn", "other"), lambda: GaussianProcessSurrogate("poly")):
        with pytest.raises(ValueError):
            call()


def test_member_stats(spark):
    mean, var = member_stats([F.lit(1.0), F.lit(2.0), F.lit(6.0)])
    row = spark.range(1).select(mean.alias("m"), var.alias("v")).first()
    assert np.isclose(row["m"], 3.0) and np.isclose(row["v"], np.var([1, 2, 6]))


def test_training_rows(spark, pool):
    done = spark.createDataFrame([(0, 1.0, 0), (1, None, 0), (2, 3.0, 1)], "id long, score double, iter int")
    assert sorted(r["id"] for r in training_rows(done, pool).collect()) == [0, 2]
    assert [r["id"] for r in training_rows(done, pool, retrain=False).collect()] == [2]


def test_clusters(pool):
    for method in ("minibatch", "bisecting"):
        got = cluster_pool(pool, 5, method)
        assert got.count() == N and got.select("cluster_id").distinct().count() == 5
    with pytest.raises(ValueError):
        cluster_pool(pool, 5, "optics")


def config(**changes):
    return RunConfig(**{"metric": "greedy", "init_size": 20, "batch_sizes": (20,), "k": 20, "max_iters": 3, "delta": -1.0, **changes})


def explore(spark, pool, labels, model, cfg, **more):
    return Exploration(spark, pool, lookup_objective(labels), model, cfg, scratch_path(spark, "run"), **more)


def found(run, data, k=20):
    best = set(data.nlargest(k, "score")["id"])
    return len(best & {r["id"] for r in run.explored().select("id").collect()})


def test_guided_search_beats_random(spark, pool, labels, data):
    guided = explore(spark, pool, labels, make_surrogate("gp"), config())
    rows = guided.run().orderBy("iter").collect()
    random = explore(spark, pool, labels, make_surrogate("random"), config(metric="random"))
    random.run()
    assert [r["n_scores"] for r in rows] == [20, 40, 60, 80]
    assert found(guided, data) > found(random, data) + 5
    ids = [r["id"] for r in guided.explored().select("id").collect()]
    assert len(ids) == len(set(ids))
    averages = guided.final_averages()
    assert np.isclose(averages[0.005], data.nlargest(2, "score")["score"].mean())


@pytest.mark.parametrize("metric", ["ucb", "lcb", "ei", "pi", "ts", "noisy", "threshold"])
def test_every_metric_runs(spark, pool, labels, metric):
    run = explore(spark, pool, labels, make_surrogate("gp"), config(metric=metric, max_iters=1, epsilon=0.1))
    assert run.run().count() == 2


def test_pruning_shrinks_the_pool(spark, pool, labels):
    run = explore(spark, pool, labels, make_surrogate("gp"), config(metric="ucb", prune=True, max_iters=2, batch_sizes=(3,)))
    run.run()
    sizes = [r["count"] for r in run.log.read("retained").groupBy("iter").count().orderBy("iter").collect()]
    assert N > sizes[0] >= sizes[1] >= 20
    assert run.pool.count() == sizes[-1] and run.log.read("lost").count() == 2
    observed = explore(spark, pool, labels, make_surrogate("gp"), config(metric="ucb", prune=True, max_iters=1, use_observed_threshold=True))
    assert observed.run().count() == 2


def test_pruning_needs_variances(spark, pool, labels):
    with pytest.raises(ValueError):
        explore(spark, pool, labels, make_surrogate("nn"), config(prune=True))
    with pytest.raises(ValueError):
        explore(spark, pool, labels, make_surrogate("nn"), config(metric="ucb"))


def test_stopping_rules(spark, pool, labels):
    budget = explore(spark, pool, labels, make_surrogate("random"), config(metric="random", budget=40, max_iters=50))
    assert budget.run().count() == 2
    small = explore(spark, pool.filter("id < 50"), labels, make_surrogate("random"), config(metric="random", max_iters=50))
    assert small.run().agg(F.max("n_scores")).first()[0] == 50 and small.exhausted
    assert not gained_little([1.0, 2.0], 3, 0.01)
    assert gained_little([1.0, 1.0, 1.0], 3, 0.01) and not gained_little([1.0, 1.0, 2.0], 3, 0.01)
    assert not gained_little([-2.0, -2.0, -1.0], 3, 0.01) and gained_little([0.0, 0.0, 0.0], 3, 0.1)


def test_failures_are_labelled_once(spark, pool, labels):
    run = explore(spark, pool, labels.filter("id % 4 <> 0"), make_surrogate("gp"), config(max_iters=2))
    run.run()
    rows = run.explored().collect()
    assert any(r["score"] is None for r in rows) and all((r["score"] is None) == (r["id"] % 4 == 0) for r in rows)


def test_warm_start_keeps_the_budget(spark, pool, labels):
    run = explore(spark, pool, labels, make_surrogate("gp"), config(max_iters=1), previous=labels.filter("id < 30"))
    assert run.labels_used == 0 and run.iter == 1
    run.run()
    assert run.labels_used == 20 and run.n_scores == 50


def test_resumed_run_equals_an_uninterrupted_one(spark, pool, labels):
    whole = explore(spark, pool, labels, make_surrogate("gp"), config(metric="ucb", prune=True))
    whole.run()
    path = scratch_path(spark, "run")
    part = Exploration(spark, pool, lookup_objective(labels), make_surrogate("gp"), config(metric="ucb", prune=True), path)
    part.explore_initial()
    part.explore_batch()
    again = Exploration(spark, pool, lookup_objective(labels), make_surrogate("gp"), config(metric="ucb", prune=True), path, resume=True)
    assert again.iter == 2 and again.n_scores == part.n_scores
    again.run()
    key = lambda run: sorted((r["iter"], r["id"]) for r in run.explored().select("iter", "id").collect())
    assert key(again) == key(whole)


def test_clustered_run(spark, pool, labels):
    run = explore(spark, cluster_pool(pool, 4).select("id", "features", "cluster_id"), labels, make_surrogate("gp"), config(max_iters=1, temp_i=1.0))
    assert run.run().count() == 2


def test_sweep(spark):
    table, best = sweep(spark, [{"x": 1}, {"x": 5}, {"x": 3}], lambda p, i: -abs(p["x"] - 4) + i * 0.01)
    assert best == {"x": 3} and table.count() == 3
