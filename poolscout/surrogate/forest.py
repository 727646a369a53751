"""Random forest whose spread over trees is the predicted variance."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SMALL_ROWS, scratch_path
from .base import Surrogate, no_variance, vectors

SPARK_MAX_DEPTH = 30
#: Training rows for one task, while they are few.
TASK_ROWS = 250
#: Bins of a feature. A level costs a histogram of every feature for each open node of all trees, however few rows a node has, so the time goes with the bins.
BINS = 16


class ForestSurrogate(Surrogate):
    """Spark's forest. ``max_depth=None`` means as deep as Spark allows, which is 30; a greater depth is an error."""

    provides = frozenset({"means", "vars"})

    def __init__(self, trees: int = 100, max_depth: int | None = 8, min_leaf: int = 1, seed: int = 42, bootstrap: bool = True, max_bins: int = BINS):
        self.max_bins = max_bins
        self.trees, self.min_leaf, self.seed, self.bootstrap = trees, min_leaf, seed, bootstrap
        if max_depth is not None and max_depth > SPARK_MAX_DEPTH:
            raise ValueError(f"Spark's trees end at depth {SPARK_MAX_DEPTH}, got {max_depth}")
        self.max_depth = SPARK_MAX_DEPTH if max_depth is None else max_depth
        self.model: RandomForestRegressionModel | None = None

    def fit(self, rows: DataFrame) -> "ForestSurrogate":
        n = rows.count()
        if n <= SMALL_ROWS:  # a bootstrap goes by place, so places follow the ids
            tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
            rows = rows.repartition(tasks, "id").sortWithinPartitions("id")
        data = rows.select(vectors(F.col("features")).alias("vector"), F.col("score").alias("label"))
        forest = RandomForestRegressor(
            featuresCol="vector", labelCol="label", numTrees=self.trees, maxDepth=self.max_depth,
            minInstancesPerNode=self.min_leaf, featureSubsetStrategy="all", seed=self.seed, leafCol="leaves", bootstrap=self.bootstrap, maxBins=self.max_bins,
        )
        self.model = forest.fit(data)
        return self

    def _leaf_values(self, pool: DataFrame) -> list[list[float]]:
        """Prediction of every leaf by tree; leaves are numbered in node order. Its size is fixed by trees and depth."""
        spark = pool.sparkSession
        path = scratch_path(spark, "forest")
        self.model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data")
        leaves = nodes.filter("nodeData.leftChild < 0").select(
            F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.prediction").alias("value")
        )
        values: list[list[float]] = [[] for _ in range(self.trees)]
        for row in leaves.orderBy("tree", "node").collect():
            values[row["tree"]].append(row["value"])
        return values

    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        scored = self.model.transform(pool.withColumn("vector", vectors(F.col("features"))))
        if mean_only:
            return scored.select(*pool.columns, F.col("prediction").alias("y_mean"), no_variance())
        # a constant of the plan: its size is fixed by trees and depth
        table = F.from_json(F.lit(json.dumps(self._leaf_values(pool))), "array<array<double>>")
        members = F.zip_with(vector_to_array("leaves"), table, lambda leaf, values: values[leaf.cast("int")])
        scored = scored.withColumn("_members", members)
        total = F.aggregate("_members", F.lit(0.0), lambda acc, x: acc + x)
        scored = scored.withColumn("_mean", total / float(self.trees))
        # deviations, as the difference of large squares would be noise
        var = F.aggregate("_members", F.lit(0.0), lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean"))) / float(self.trees)
        return scored.select(*pool.columns, F.col("_mean").alias("y_mean"), var.alias("y_var"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "ForestSurrogate":
        self.model = RandomForestRegressionModel.load(path)
        self.trees = self.model.getNumTrees
        return self
