"""What every surrogate offers."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform


class Surrogate(ABC):
    """Fit on ``(id, features, score)``, predict ``(y_mean, y_var)`` for rows with ``features``."""

    #: "means", "vars" and, when a mean is itself a draw, "stochastic".
    provides: frozenset[str] = frozenset({"means"})

    @abstractmethod
    def fit(self, rows: DataFrame) -> "Surrogate":
        """Train; rows without a score have been dropped already."""

    @abstractmethod
    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        """Add ``y_mean`` and ``y_var`` (NULL when skipped or not provided)."""

    def start_round(self, iteration: int, draw: bool) -> None:
        """Told before the predictions of a round; ``draw`` when a stochastic model's mean is to be one draw."""

    @abstractmethod
    def save(self, path: str) -> None: ...

    @abstractmethod
    def load(self, path: str) -> "Surrogate": ...


def no_variance() -> Column:
    return F.lit(None).cast("double").alias("y_var")


def vectors(features: Column) -> Column:
    """ML vector from an array of numbers."""
    return array_to_vector(features.cast("array<double>"))


def training_rows(explored: DataFrame, features: DataFrame, retrain: bool = True) -> DataFrame:
    """Labelled candidates with their features: all of them, or those of the last batch. Failures are left out, and so are
    labels of candidates whose features nobody knows."""
    if "features" in features.columns:
        features = features.filter(F.col("features").isNotNull())
    known = explored.filter(F.col("score").isNotNull())
    if not retrain:
        known = known.filter(F.col("iter") == explored.agg(F.max("iter").alias("i")).scalar())
    return features.join(known.select("id", "score"), "id")


class RandomSurrogate(Surrogate):
    """Predictions that do not look at the features."""

    provides = frozenset({"means", "vars"})

    def __init__(self, seed: int = 42):
        self.seed = seed

    def fit(self, rows: DataFrame) -> "RandomSurrogate":
        return self

    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        var = no_variance() if mean_only else uniform(F.col("id"), self.seed + 1).alias("y_var")
        return pool.select("*", uniform(F.col("id"), self.seed).alias("y_mean"), var)

    def save(self, path: str) -> None:
        pass

    def load(self, path: str) -> "RandomSurrogate":
        return self
