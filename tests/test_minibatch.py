"""Mini-batch k-means against full k-means and against itself under other partitionings."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans

from poolscout.operators.clusters import cluster_pool
from poolscout.operators.minibatch import MiniBatch, assign_clusters, fit_minibatch, nearest
from poolscout.surrogate.base import vectors

SCHEMA = "id long, features array<double>"


@pytest.fixture(scope="module")
def pool(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS features")


def inertia(pool, centres):
    x = np.array([r["features"] for r in pool.collect()])
    return sum(((row - centres[c]) ** 2).sum() for row, c in zip(x, nearest(x, centres)))


def test_inertia_is_near_that_of_full_k_means(pool):
    centres = fit_minibatch(pool, 10, MiniBatch(100, 25))
    full = KMeans(k=10, seed=1, featuresCol="v").fit(pool.withColumn("v", vectors(pool["features"])))
    assert inertia(pool, centres) <= 1.05 * inertia(pool, np.array(full.clusterCenters()))


def test_partitions_do_not_matter(spark, pool):
    # whole numbers, so that sums do not depend on their order either
    whole = pool.selectExpr("id", "transform(features, x -> floor(100 * x) * 1.0D) AS features")
    options = MiniBatch(64, 6)
    assert (fit_minibatch(whole.repartition(3), 5, options) == fit_minibatch(whole.repartition(7, "id"), 5, options)).all()


def test_few_rows_and_nulls(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, None)], SCHEMA)
    placed = {r["id"]: r["cluster_id"] for r in assign_clusters(rows, fit_minibatch(rows, 10, MiniBatch(2, 3))).collect()}
    assert placed[3] is None and placed[1] != placed[2]
    with pytest.raises(ValueError):
        fit_minibatch(rows.where("id > 9"), 2)


def test_ties_go_to_the_lower_centre():
    assert nearest(np.array([[0.0], [1.0], [2.0]]), np.array([[0.0], [2.0], [2.0]])).tolist() == [0, 0, 1]


def test_it_is_a_method_of_the_pool(spark):
    rows = spark.createDataFrame([(i, [float(i // 50), 0.0]) for i in range(100)], SCHEMA)
    groups = cluster_pool(rows, 2, "minibatch").groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in groups) == [50, 50]
