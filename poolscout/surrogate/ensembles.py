"""Means and variances from several predictions of ordinary Spark ML regressors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform, uniform_value
from .base import Surrogate, no_variance, vectors

MAKERS = {
    "linear": lambda seed, reg=1e-3: LinearRegression(featuresCol="vector", labelCol="label", weightCol="weight", regParam=reg),
    "gbt": lambda seed, reg=None: GBTRegressor(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=20, seed=seed),
}
LOADERS = {"linear": LinearRegressionModel, "gbt": GBTRegressionModel}


def member_stats(members: Sequence[Column]) -> tuple[Column, Column]:
    """Mean and population variance over members."""
    n = float(len(members))
    every = F.array(*members)
    mean = F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / n
    # deviations, as the difference of large squares would be noise
    return mean, F.aggregate(every, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n


def _labelled(rows: DataFrame, weight: Column, label: Column | None = None) -> DataFrame:
    target = F.col("score") if label is None else label
    return rows.select("id", vectors(F.col("features")).alias("vector"), target.alias("label"), weight.alias("weight"))


def _poisson_weight(seed: int) -> Column:
    """Bootstrap weight: how often a row would be drawn, from its hash. Counts above 8, of probability 1e-6, are 8."""
    u = uniform(F.col("id"), seed)
    mass, total, weight = np.exp(-1.0), 0.0, F.lit(8.0)
    bounds = []
    for k in range(8):
        total += mass
        bounds.append(total)
        mass /= k + 1
    for k in range(7, -1, -1):
        weight = F.when(u < bounds[k], F.lit(float(k))).otherwise(weight)
    return weight


class RegressorSurrogate(Surrogate):
    """One Spark ML regressor; means only."""

    def __init__(self, kind: str = "linear", seed: int = 42, reg: float = 1e-3):
        self.kind, self.seed, self.reg, self.model = kind, seed, reg, None

    def fit(self, rows: DataFrame) -> "RegressorSurrogate":
        self.model = MAKERS[self.kind](self.seed, self.reg).fit(_labelled(rows, F.lit(1.0)))
        return self

    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        scored = self.model.transform(pool.withColumn("vector", vectors(F.col("features"))))
        return scored.select(*pool.columns, F.col("prediction").alias("y_mean"), no_variance())

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "RegressorSurrogate":
        self.model = LOADERS[self.kind].load(path)
        return self


class EnsembleSurrogate(Surrogate):
    """Members fitted with their own seeds and bootstrap weights; mean and variance over members."""

    provides = frozenset({"means", "vars"})

    def __init__(self, members: int = 5, kind: str = "linear", bootstrap: bool = True, seed: int = 42, reg: float = 1e-3):
        if kind == "linear" and not bootstrap:
            raise ValueError("linear members are all equal without bootstrap weights")
        self.reg = reg
        self.members, self.kind, self.bootstrap, self.seed = members, kind, bootstrap, seed
        self.models: list = []

    def fit(self, rows: DataFrame) -> "EnsembleSurrogate":
        weight: Callable[[int], Column] = _poisson_weight if self.bootstrap else lambda s: F.lit(1.0)
        spark = rows.sparkSession
        kept = rows.select("id", "features", "score").persist()

        def fit_member(i: int):
            return MAKERS[self.kind](self.seed + i, self.reg).fit(_labelled(kept, weight(self.seed + i)).filter("weight > 0"))

        with ThreadPoolExecutor(self.members) as threads:
            self.models = list(threads.map(inheritable_thread_target(spark)(fit_member), range(self.members)))
        kept.unpersist()
        return self

    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        scored = pool.withColumn("vector", vectors(F.col("features")))
        names = [f"_m{i}" for i in range(self.members)]
        for name, model in zip(names, self.models):
            scored = model.setPredictionCol(name).transform(scored)
        mean, var = member_stats([F.col(n) for n in names])
        return scored.select(*pool.columns, mean.alias("y_mean"), no_variance() if mean_only else var.alias("y_var"))

    def save(self, path: str) -> None:
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/member_{i}")

    def load(self, path: str) -> "EnsembleSurrogate":
        self.models = [LOADERS[self.kind].load(f"{path}/member_{i}") for i in range(self.members)]
        return self


#: Mean of the logarithm of a squared standard normal: what the log squared residual falls short of the log variance.
LOG_CHI_MEAN = -1.2703628454614782


class MeanVarianceSurrogate(Surrogate):
    """A model of the mean and a second one of the log squared residual, from which follows the variance of normal residuals."""

    provides = frozenset({"means", "vars"})

    def __init__(self, kind: str = "linear", seed: int = 42, reg: float = 1e-3):
        self.kind, self.seed, self.reg, self.mean_model, self.spread_model = kind, seed, reg, None, None

    def fit(self, rows: DataFrame) -> "MeanVarianceSurrogate":
        data = _labelled(rows, F.lit(1.0))
        self.mean_model = MAKERS[self.kind](self.seed, self.reg).fit(data)
        residual = F.col("label") - F.col("prediction")
        spread = self.mean_model.transform(data).select(
            "vector", "weight", F.log(F.greatest(residual * residual, F.lit(1e-5))).alias("label")
        )
        self.spread_model = MAKERS[self.kind](self.seed + 1, self.reg).fit(spread)
        return self

    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        scored = self.mean_model.setPredictionCol("_mean").transform(pool.withColumn("vector", vectors(F.col("features"))))
        if mean_only:
            return scored.select(*pool.columns, F.col("_mean").alias("y_mean"), no_variance())
        scored = self.spread_model.setPredictionCol("_log_var").transform(scored)
        return scored.select(*pool.columns, F.col("_mean").alias("y_mean"), F.exp(F.col("_log_var") - LOG_CHI_MEAN).alias("y_var"))

    def save(self, path: str) -> None:
        self.mean_model.write().overwrite().save(f"{path}/mean")
        self.spread_model.write().overwrite().save(f"{path}/spread")

    def load(self, path: str) -> "MeanVarianceSurrogate":
        self.mean_model = LOADERS[self.kind].load(f"{path}/mean")
        self.spread_model = LOADERS[self.kind].load(f"{path}/spread")
        return self


class DropoutSurrogate(Surrogate):
    """Linear model evaluated several times with random features left out.

    A pass leaves the same features out for all rows, so all passes of a batch are one matrix product. When a prediction is to
    be a draw (``start_round``), there is one pass, with other features left out in every round.
    """

    def __init__(self, passes: int = 10, dropout: float = 0.2, seed: int = 42, reg: float = 1e-3):
        self.passes, self.dropout, self.seed, self.reg, self.model = passes, dropout, seed, reg, None
        self.provides = frozenset({"means", "vars", "stochastic"})
        self.draw, self.round = False, 0

    def start_round(self, iteration: int, draw: bool) -> None:
        self.draw, self.round = draw, iteration if draw else 0

    def fit(self, rows: DataFrame) -> "DropoutSurrogate":
        self.model = MAKERS["linear"](self.seed, self.reg).fit(_labelled(rows, F.lit(1.0)))
        return self

    def masks(self, features: int) -> np.ndarray:
        """Which features each pass keeps, from the hash of pass, feature and round."""
        passes = 1 if self.draw else self.passes
        base = self.round * self.passes
        return np.array([[uniform_value((base + p) * features + f, self.seed) >= self.dropout for f in range(features)] for p in range(passes)])

    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        w, b = np.asarray(self.model.coefficients.toArray()), float(self.model.intercept)
        passes = (self.masks(len(w)) * w / (1.0 - self.dropout)).T

        @F.pandas_udf("y_mean double, y_var double")
        def score(features: pd.Series) -> pd.DataFrame:
            if not len(features):
                return pd.DataFrame({"y_mean": [], "y_var": []}, dtype="float64")
            out = np.vstack(features.to_numpy()).astype(float) @ passes + b
            return pd.DataFrame({"y_mean": out.mean(axis=1), "y_var": out.var(axis=1)})

        scored = pool.withColumn("_p", score(F.col("features")))
        var = no_variance() if mean_only else F.col("_p.y_var").alias("y_var")
        return scored.select(*pool.columns, F.col("_p.y_mean").alias("y_mean"), var)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "DropoutSurrogate":
        self.model = LinearRegressionModel.load(path)
        return self
