"""Clusters of a feature table."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..surrogate.base import vectors
from .minibatch import assign_clusters, fit_minibatch

METHODS = {"kmeans": KMeans, "bisecting": BisectingKMeans}


def cluster_pool(pool: DataFrame, n_clusters: int = 100, method: str = "minibatch", seed: int = 42) -> DataFrame:
    """Add ``cluster_id`` from the array column ``features``. ``kmeans`` and ``bisecting`` read all rows in every round, ``minibatch`` small draws of them."""
    if method == "minibatch":
        return assign_clusters(pool, fit_minibatch(pool, n_clusters, seed=seed))
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    rows = pool.withColumn("_vector", vectors(F.col("features")))
    model = METHODS[method](featuresCol="_vector", predictionCol="cluster_id", k=n_clusters, seed=seed).fit(rows)
    return model.transform(rows).drop("_vector")


def cluster_sizes(pool: DataFrame) -> DataFrame:
    return pool.groupBy("cluster_id").count()


def size_histogram(sizes: DataFrame) -> DataFrame:
    """How many clusters there are of each size."""
    return sizes.groupBy(F.col("count").alias("size")).agg(F.count(F.lit(1)).alias("clusters"))
