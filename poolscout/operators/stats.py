"""Averages, quantiles, histograms and tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gaussian import phi
from .ordered import rank_within, top_n


def top_k_average(explored: DataFrame, k: int) -> DataFrame:
    """One row: average of the ``k`` best labels (of all when there are fewer); a failed label counts as 0."""
    best = top_n(explored, k, [F.col("score").desc_nulls_last(), F.col("id").desc()])
    return best.agg((F.sum(F.coalesce("score", F.lit(0.0))) / F.count(F.lit(1))).alias("top_k_avg"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, tie: str, at: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key as columns ``q<percent>``.

    Ranks come from a range sort, so a heavy key needs neither one task nor a buffer of its distinct values.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value, tie)
    ranked = rank_within(known, keys, [F.col(value).asc(), F.col(tie).asc()], "_rank", total="_n")
    outputs = []
    for q in at:
        position = F.lit(float(q)) * (F.col("_n") - 1)
        low = F.floor(position)
        share = position - low
        here = F.when(F.col("_rank") - 1 == low, F.col(value) * (F.lit(1.0) - share))
        above = F.when(F.col("_rank") - 2 == low, F.col(value) * share)
        both = F.sum(F.coalesce(here, F.lit(0.0)) + F.coalesce(above, F.lit(0.0)))
        outputs.append(both.alias(f"q{round(q * 100)}"))
    return ranked.groupBy(*keys).agg(*outputs)


def bin_index(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin of equal width in [low, high]; the upper edge belongs to the last bin, outside values to none."""
    raw = F.floor((x - F.lit(float(low))) / F.lit((high - low) / bins)).cast("int")
    return F.when((x >= low) & (x <= high), F.least(raw, F.lit(bins - 1)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin and the density over the counted rows."""
    width = (high - low) / bins
    counted = df.select(bin_index(F.col(value), low, high, bins).alias("bin")).filter("bin IS NOT NULL")
    per_bin = counted.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = per_bin.agg(F.sum("n").alias("total")).scalar()
    return per_bin.withColumn("density", F.col("n") / total / F.lit(width))


def histogram_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int) -> DataFrame:
    bx = bin_index(F.col(x), *x_range, bins).alias("bin_x")
    by = bin_index(F.col(y), *y_range, bins).alias("bin_y")
    both = df.select(bx, by).filter("bin_x IS NOT NULL AND bin_y IS NOT NULL")
    return both.groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"))


def boltzmann_mean(x: Column) -> Column:
    """Mean weighted by e^-x."""
    return F.sum(x * F.exp(-x)) / F.sum(F.exp(-x))


def scaler(df: DataFrame, column: str) -> DataFrame:
    """One row ``(mean, sd)``: NULL-ignoring mean and population s.d.; an empty column gives 0 and 1, a constant 1."""
    x = F.when(~F.isnan(column), F.col(column))
    return df.agg(
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias("sd"),
    )


def replicate_stats(rewards: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population s.d. over replicates."""
    return rewards.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("reps")
    )


def t_statistic(
    mean_a: Column, sd_a: Column, n_a: Column, mean_b: Column, sd_b: Column, n_b: Column, population_sd: bool = False
) -> tuple[Column, Column]:
    """Pooled two-sample t and its degrees of freedom; with ``population_sd`` the inputs have divisor n."""
    squares_a = sd_a * sd_a * (n_a if population_sd else n_a - 1)
    squares_b = sd_b * sd_b * (n_b if population_sd else n_b - 1)
    freedom = n_a + n_b - 2
    pooled = (squares_a + squares_b) / freedom
    spread = F.sqrt(pooled * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    return (mean_a - mean_b) / F.nullif(spread, F.lit(0.0)), freedom


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its even continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_share(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    value = 1.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1.0 + odd / (1.0 + even / value)
    return front / (a * value)


def student_cdf(t: float, freedom: float) -> float:
    """P(T <= t) for one pair of numbers and any degrees of freedom, without Spark."""
    tail = 0.5 * _beta_share(freedom / 2.0, 0.5, freedom / (freedom + t * t))
    return tail if t < 0 else 1.0 - tail


#: Degrees of freedom up to which Student's distribution is its finite sum; beyond it an expansion is exact to a billionth.
MOST_TERMS = 200


def student_column(t: Column, freedom: Column) -> Column:
    """P(T <= t) for whole degrees of freedom, as a Column: with ``u = cos(atan(t / sqrt(n))) ** 2`` the finite sum of the powers of ``u`` up to half of ``n``, and for many
    degrees of freedom the normal distribution of a corrected deviate. NULL in, and degrees below 1, give NULL."""
    n = freedom.cast("double")
    tangent = t / F.sqrt(n)
    u = 1.0 / (1.0 + tangent * tangent)
    odd = n % 2 == 1
    terms = F.when(odd, (n - 3) / 2).otherwise((n - 2) / 2).cast("int")

    def add(acc: Column, j: Column) -> Column:
        j = j.cast("double")
        term = acc["term"] * u * F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when((n > 2) & (n <= MOST_TERMS) & (terms >= 1), F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.aggregate(steps, start, add, lambda acc: acc["total"])
    sine, angle = tangent * F.sqrt(u), F.atan(tangent)
    share = F.when(n == 1, angle * (2.0 / math.pi)).when(odd, (angle + sine * F.sqrt(u) * total) * (2.0 / math.pi)).otherwise(sine * total)
    # the corrected deviate of G. W. Hill for many degrees of freedom
    a = n - 0.5
    b = 48.0 * a * a
    y = a * F.log1p(tangent * tangent)
    z = F.sqrt(y) * (1.0 + (y + 3.0 + ((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b))) / b)
    far = phi(F.when(t < 0, -z).otherwise(z))
    exact = F.when(share.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.5 * share)))  # rounding may leave the bounds
    return F.when(n >= 1, F.when(n <= MOST_TERMS, exact).otherwise(far))


def one_sided_p(t: Column, freedom: Column) -> Column:
    """P(T <= t)."""
    return student_column(t, freedom)


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = 1000) -> DataFrame:
    """``(keys, sketch)``: a KLL sketch of the non-NULL values of each key, to be stored and merged later. Sketches are combined before they move, and each is of bounded size, so neither a
    heavy key nor its distinct values meet in one task. The rank of an estimate is off by about ``2.3 / k ** 0.9`` at most."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored sketches of finer keys as one for each of ``keys``."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, at: Sequence[float]) -> DataFrame:
    """One row per sketch and share: the estimate, and the number of values it stands for."""
    others = [c for c in sketches.columns if c != "sketch"]
    n = F.kll_sketch_get_n_double("sketch")
    each = [F.struct(F.lit(float(q)).alias("q"), n.alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("estimate")) for q in at]
    return sketches.select(*others, F.inline(F.array(*each)))
