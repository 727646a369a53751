"""Dropping candidates that are unlikely to be hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gaussian import phi, standard_score


def with_hit_probability(preds: DataFrame, threshold: Column | float) -> DataFrame:
    """Add ``p_hit``, the probability that a prediction reaches the threshold; a certain prediction gives 0 or 1."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    mean, var = F.col("y_mean"), F.col("y_var")
    staged = preds.withColumn("_above", mean - t).withColumn("_z", standard_score(F.col("_above"), var))
    chance = F.when(var == 0, (F.col("_above") >= 0).cast("double")).otherwise(phi(F.col("_z")))
    return staged.withColumn("p_hit", chance).drop("_above", "_z")


def retain(preds: DataFrame, threshold: Column | float, p_min: float = 0.025) -> DataFrame:
    """Candidates whose chance to reach the threshold is at least ``p_min``."""
    return with_hit_probability(preds, threshold).filter(F.col("p_hit") >= p_min).drop("p_hit")


def expected_positives_pruned(
    preds: DataFrame, retained: DataFrame, threshold: Column | float, with_variance: bool = True
) -> DataFrame:
    """One row: the number of hits expected among the dropped candidates."""
    dropped = preds.join(retained.select("id"), "id", "left_anti")
    if with_variance:
        dropped, chance = with_hit_probability(dropped, threshold), F.col("p_hit")
    else:
        t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        chance = (F.col("y_mean") >= t).cast("double")
    return dropped.agg(F.coalesce(F.sum(chance), F.lit(0.0)).alias("expected_lost"))


def inference_calls(retained_sizes: DataFrame, pool_rows: int, rounds: int) -> DataFrame:
    """Rows predicted per run: the full pool once, then what the earlier rounds left; also relative to no pruning.

    ``retained_sizes`` has one row per (run_id, iter) with ``n_retained``, iterations counted from 1.
    """
    later = F.sum(F.when(F.col("iter") <= rounds - 1, F.col("n_retained")).otherwise(F.lit(0)))
    calls = (F.lit(pool_rows) + later).cast("long")
    return retained_sizes.groupBy("run_id").agg(
        calls.alias("calls"), (calls / F.lit(float(pool_rows * rounds))).alias("relative_calls")
    )
