"""Normal density and distribution function as Columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail in the double-precision form given by West (2005).
TAIL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SPLIT = 7.07106781186547
TAIL_END = 37.0
SQRT_2PI = 2.506628274631


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def pdf(z: Column) -> Column:
    """Standard normal density."""
    return F.exp(z * z * F.lit(-0.5)) / F.lit(math.sqrt(2.0 * math.pi))


def phi(z: Column) -> Column:
    """Standard normal distribution function; NULL in, NULL out."""
    x = F.abs(z)
    decay = F.exp(x * x * F.lit(-0.5))
    near = decay * _horner(TAIL_NUMERATOR, x) / _horner(TAIL_DENOMINATOR, x)
    far = decay / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + F.lit(0.65)))))) / F.lit(SQRT_2PI)
    tail = F.when(x > TAIL_END, F.lit(0.0)).when(x < TAIL_SPLIT, near).when(x.isNotNull(), far)
    return F.abs(F.when(z > 0, F.lit(1.0)).otherwise(F.lit(0.0)) - tail)


def standard_score(difference: Column, var: Column) -> Column:
    """Difference in standard deviations; NULL for a certain prediction."""
    return difference / F.sqrt(F.when(var != 0, var))
