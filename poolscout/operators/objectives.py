"""Objectives: a DataFrame of candidates in, ``(id, score)`` out; NULL marks a failed label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scores import signed

Objective = Callable[[DataFrame], DataFrame]


def lookup_objective(labels: DataFrame, minimize: bool = False) -> Objective:
    """Scores from a label table; a candidate that is not listed has failed."""
    table = labels.select("id", signed(F.col("score"), not minimize).alias("score"))
    return lambda batch: batch.select("id").join(table, "id", "left")


def computed_objective(score: Callable[[DataFrame], Column], minimize: bool = False, tasks: int | None = None) -> Objective:
    """Scores from a Column, such as a pandas UDF, evaluated on the batch only. NaN marks a failure."""

    def run(batch: DataFrame) -> DataFrame:
        rows = batch if tasks is None else batch.repartition(tasks, "id")
        value = score(rows)
        return rows.select("id", signed(F.when(~F.isnan(value), value), not minimize).alias("score"))

    return run
