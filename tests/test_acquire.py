"""Batches: sizes, exclusions, order, repeatability."""

import math
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolscout.operators import acquire, prune

SIZE = 100


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(1)
    ids = [f"{c}{i}" for i in range(1) for c in string.printable[:SIZE]]
    rows = pd.DataFrame({"id": ids, "utility": rng.standard_normal(len(ids)), "cluster_id": np.where(np.arange(len(ids)) < 70, 0, np.arange(len(ids)) % 5)})
    rows["y_mean"] = rows["utility"]
    return spark.createDataFrame(rows).cache()


def explored(spark, pool, n):
    rows = pool.limit(n).select("id", F.lit(0.5).alias("score"))
    return rows if n else spark.createDataFrame([], rows.schema)


def ids(frame):
    return [r["id"] for r in frame.collect()]


@pytest.mark.parametrize("n", [0, 10, 250])
def test_initial_size_and_seed(pool, n):
    first = ids(acquire.initial_batch(pool, n, 42))
    assert len(first) == len(set(first)) == min(n, SIZE)
    assert first == ids(acquire.initial_batch(pool.repartition(7), n, 42))
    if n == 10:
        assert set(first) != set(ids(acquire.initial_batch(pool, n, 43)))


@pytest.mark.parametrize("known", [0, 1, 8])
@pytest.mark.parametrize("epsilon", [0.0, 0.1, 0.5, 1.0])
def test_batch_size_and_exclusion(spark, pool, known, epsilon):
    done = explored(spark, pool, known)
    batch = ids(acquire.acquire_batch(pool, done, 10, epsilon, seed=3))
    assert len(batch) == 10 and not set(batch) & set(ids(done))


def test_best_first_with_larger_id_on_ties(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", 0.0)], "id STRING, utility DOUBLE")
    nothing = spark.createDataFrame([], "id STRING, score DOUBLE")
    assert ids(acquire.acquire_batch(rows, nothing, 3)) == ["c", "b", "a"]


def test_top_m_equals_sorting(spark, pool):
    want = pool.toPandas().sort_values(["utility", "id"], ascending=False)["id"].head(10).tolist()
    assert ids(acquire.acquire_batch(pool, explored(spark, pool, 0), 10)) == want


def test_random_rows_differ_by_seed(spark, pool):
    done = explored(spark, pool, 0)
    draws = {tuple(ids(acquire.acquire_batch(pool, done, 10, 0.5, seed=s))) for s in range(3)}
    assert len(draws) == 3
    best = ids(acquire.acquire_batch(pool, done, 5))
    mixed = ids(acquire.acquire_batch(pool, done, 10, 0.5, seed=1))
    drawn = set(ids(acquire.explore_some_at_random(pool, 5, 1).filter("utility = double('inf')")))
    assert len(drawn) == 5 and drawn <= set(mixed)
    assert set(mixed) - drawn <= set(pool.toPandas().sort_values("utility", ascending=False)["id"].head(10))
    assert set(best) & set(mixed)


def test_batch_larger_than_the_pool(spark, pool):
    done = explored(spark, pool, 8)
    assert len(ids(acquire.acquire_batch(pool, done, 1000))) == SIZE - 8


def test_clustered_quotas(spark, pool):
    got = acquire.initial_batch_by_cluster(pool, 10, 1).groupBy("cluster_id").count().collect()
    sizes = {r["cluster_id"]: r["count"] for r in pool.groupBy("cluster_id").count().collect()}
    assert {r["cluster_id"]: r["count"] for r in got} == {c: math.ceil(10 * n / SIZE) for c, n in sizes.items()}


def test_single_cluster_is_the_plain_sample(pool):
    one = pool.withColumn("cluster_id", F.lit(1))
    assert set(ids(acquire.initial_batch_by_cluster(one, 10, 5))) == set(ids(acquire.initial_batch(pool, 10, 5)))


def test_annealing_shrinks_poor_clusters(spark, pool):
    done = explored(spark, pool, 0)
    hot = acquire.acquire_batch_by_cluster(pool, done, 40, 0, None, 1.0).count()
    cold = acquire.acquire_batch_by_cluster(pool, done, 40, 5, 0.5, 0.05).count()
    assert cold < hot


def test_kth_best(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0), (4, 3.0)], "id INT, score DOUBLE")
    assert [acquire.kth_best(rows, k).first()["best"] for k in (1, 2, 3, 4, 9)] == [5.0, 3.0, 1.0, float("-inf"), 5.0]


def test_top_explored_failures_last(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, None), (3, -1.0)], "id INT, score DOUBLE")
    assert ids(acquire.top_explored(rows, 3)) == [1, 3, 2]


def test_draw_with_replacement(spark):
    pool = spark.range(50).select(F.col("id").alias("row_idx"), (F.col("id") * 2).alias("id"))
    rows = acquire.draw_with_replacement(pool, 50, 40, 3, 9).collect()
    assert len(rows) == 120 and {r["replicate"] for r in rows} == {0, 1, 2}
    assert all(r["id"] == 2 * r["row_idx"] for r in rows)
    assert len({r["id"] for r in rows if r["replicate"] == 0}) < 40


@pytest.mark.parametrize("p_min", [0.025, 0.01, 0.001])
def test_pruning(spark, p_min):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"id": np.arange(1000), "y_mean": rng.normal(8, 1.5, 1000), "y_var": rng.uniform(0, 1, 1000)})
    rows.loc[::50, "y_var"] = 0.0
    preds = spark.createDataFrame(rows)
    threshold = float(np.sort(rows["y_mean"])[-10])
    chance = prune.with_hit_probability(preds, threshold).toPandas().set_index("id")["p_hit"]
    assert (chance[(rows["y_var"] == 0).to_numpy()].isin([0.0, 1.0])).all()
    kept = prune.retain(preds, threshold, p_min)
    assert set(ids(kept)) == set(chance.index[chance >= p_min])
    lost = prune.expected_positives_pruned(preds, kept, threshold).first()["expected_lost"]
    assert np.isclose(lost, chance[chance < p_min].sum())
    above_max = prune.with_hit_probability(preds.filter("y_var > 0"), float(rows["y_mean"].max())).agg(F.max("p_hit")).first()[0]
    assert above_max <= 0.5 + 1e-12


def test_nothing_lost_when_nothing_is_pruned(spark):
    preds = spark.createDataFrame([(1, 1.0, 0.5), (2, 3.0, 0.0)], "id INT, y_mean DOUBLE, y_var DOUBLE")
    assert prune.expected_positives_pruned(preds, preds, 2.0).first()["expected_lost"] == 0.0
    none = preds.limit(0)
    assert prune.expected_positives_pruned(preds, none, 2.0, with_variance=False).first()["expected_lost"] == 1.0
