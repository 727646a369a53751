"""Acquisition utilities: the score by which candidates compete for the next batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gaussian import pdf, phi, standard_score
from .random import normal, uniform

#: What each metric reads from the surrogate.
NEEDS: dict[str, frozenset[str]] = {
    "random": frozenset(),
    "threshold": frozenset({"means"}),
    "greedy": frozenset({"means"}),
    "noisy": frozenset({"means"}),
    "ucb": frozenset({"means", "vars"}),
    "lcb": frozenset({"means", "vars"}),
    "thompson": frozenset({"means", "vars"}),
    "ts": frozenset({"means", "vars"}),
    "ei": frozenset({"means", "vars"}),
    "pi": frozenset({"means", "vars"}),
}


@dataclass(frozen=True)
class UtilityOptions:
    """Parameters shared by the metrics; each metric reads the ones it knows."""

    beta: float = 2.0
    xi: float = 0.01
    threshold: float = float("-inf")
    seed: int = 42
    stochastic: bool = False


def greedy(mean: Column) -> Column:
    return mean


def above_threshold(id_col: Column, mean: Column, threshold: float, seed: int) -> Column:
    """Random utility for candidates predicted at or above the threshold, -1 for the others."""
    return F.when(mean >= F.lit(float(threshold)), uniform(id_col, seed)).otherwise(F.lit(-1.0))


def noisy(id_col: Column, mean: Column, mean_sd: Column, seed: int) -> Column:
    """Mean plus noise as wide as the spread of all means."""
    return mean + mean_sd * normal(id_col, seed)


def ucb(mean: Column, var: Column, beta: float = 2.0) -> Column:
    return mean + F.lit(float(beta)) * F.sqrt(var)


def lcb(mean: Column, var: Column, beta: float = 2.0) -> Column:
    return mean - F.lit(float(beta)) * F.sqrt(var)


def thompson(id_col: Column, mean: Column, var: Column, seed: int, stochastic: bool = False) -> Column:
    """One draw from each prediction; a stochastic model's mean is already a draw."""
    return mean if stochastic else mean + F.sqrt(var) * normal(id_col, seed)


def improvement(mean: Column, best: Column, xi: float = 0.01) -> Column:
    return mean - best + F.lit(float(xi))


def expected_improvement(gain: Column, var: Column, z: Column) -> Column:
    return F.when(var == 0, gain).otherwise(gain * phi(z) + F.sqrt(var) * pdf(z))


def probability_of_improvement(gain: Column, var: Column, z: Column) -> Column:
    return F.when(var == 0, (gain > 0).cast("double")).otherwise(phi(z))


def needs(metric: str) -> frozenset[str]:
    if metric not in NEEDS:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(NEEDS)}")
    return NEEDS[metric]


def check_supported(metric: str, provides: frozenset[str] | set[str]) -> None:
    """Raise when the surrogate does not provide what the metric reads."""
    missing = needs(metric) - frozenset(provides)
    if missing:
        raise ValueError(f"metric {metric!r} needs {sorted(missing)}, which the model does not provide")


def with_utility(
    preds: DataFrame,
    metric: str,
    options: UtilityOptions = UtilityOptions(),
    best: Column | None = None,
    mean_sd: Column | None = None,
) -> DataFrame:
    """Add ``utility`` to ``(id, y_mean, y_var)``. ``best`` is read by ei and pi, ``mean_sd`` by noisy.

    The gain and its standard score are columns of their own, because the distribution function mentions its argument
    many times and an inlined argument would be generated as often.
    """
    needs(metric)
    if metric == "noisy" and mean_sd is None:
        raise ValueError("noisy needs the spread of all means")
    id_col, mean, var = F.col("id"), F.col("y_mean"), F.col("y_var")
    gain, z = F.col("_gain"), F.col("_z")
    value = {
        "random": lambda: uniform(id_col, options.seed),
        "threshold": lambda: above_threshold(id_col, mean, options.threshold, options.seed),
        "greedy": lambda: greedy(mean),
        "noisy": lambda: noisy(id_col, mean, mean_sd, options.seed),
        "ucb": lambda: ucb(mean, var, options.beta),
        "lcb": lambda: lcb(mean, var, options.beta),
        "thompson": lambda: thompson(id_col, mean, var, options.seed, options.stochastic),
        "ts": lambda: thompson(id_col, mean, var, options.seed, options.stochastic),
        "ei": lambda: expected_improvement(gain, var, z),
        "pi": lambda: probability_of_improvement(gain, var, z),
    }[metric]()
    if metric not in ("ei", "pi"):
        return preds.withColumn("utility", value)
    best = F.lit(float("-inf")) if best is None else best
    staged = preds.withColumn("_gain", improvement(mean, best, options.xi)).withColumn("_z", standard_score(gain, var))
    return staged.withColumn("utility", value).drop("_gain", "_z")
