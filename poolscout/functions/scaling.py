"""Scaling, schedules and other one-row arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cloud list prices in dollars per hour and the measured cost rates of the published study.
CPU_HOUR = 0.0475
GPU_HOUR = 2.48
TRAINING_DOLLARS_PER_LABEL = 6.16 / 400e3
PREDICTION_DOLLARS_PER_ROW = 20.52 / 98.2e6


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def standardise(x: Column, mean: Column, sd: Column, missing: float | None = None) -> Column:
    """(x - mean) / sd; NULL or NaN becomes ``missing``."""
    scaled = (x - mean) / sd
    return F.when(x.isNull() | F.isnan(x), F.lit(missing).cast("double")).otherwise(scaled)


def unstandardise(x: Column, mean: Column, sd: Column, missing: float | None = None) -> Column:
    """x * sd + mean; NULL or NaN becomes ``missing``."""
    return F.when(x.isNull() | F.isnan(x), F.lit(missing).cast("double")).otherwise(x * sd + mean)


def unstandardise_variance(var: Column, sd: Column) -> Column:
    return var * sd * sd


def temperature(iteration: int, start: float, end: float) -> float:
    """Annealing temperature of an iteration."""
    return (start - end) * math.exp(-iteration) + end


def cluster_decay(global_max: Column, local_max: Column, temp: float) -> Column:
    """Share of its quota that a cluster keeps, by how far its best falls short of the overall best."""
    return F.exp(-(global_max - local_max) / F.lit(float(temp)))


def cloud_dollars_per_second(cpus: Column, gpus: Column) -> Column:
    return cpus * F.lit(CPU_HOUR) / F.lit(3600.0) + gpus * F.lit(GPU_HOUR) / F.lit(3600.0)


def one_hot_with_unknown(value: Column, choices: list) -> Column:
    """0/1 array over ``choices`` with one more place for any other value."""
    hits = [F.coalesce((value == F.lit(c)).cast("int"), F.lit(0)) for c in choices]
    other = F.when(value.isin(*choices), F.lit(0)).otherwise(F.lit(1))
    return F.array(*hits, other)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
