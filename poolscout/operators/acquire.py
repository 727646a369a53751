"""Which candidates are labelled next."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..functions.scaling import cluster_decay, temperature
from ..session import SMALL_ROWS, broadcast_if_small, cut
from .ordered import rank_within, top_n, top_per_group


def best_utility() -> list[Column]:
    """Highest utility first, the larger id on ties."""
    return [F.col("utility").desc(), F.col("id").desc()]


def exclude_explored(pool: DataFrame, explored: DataFrame) -> DataFrame:
    """Candidates without a label. Spark broadcasts the labelled ids only while their measured size allows it."""
    return pool.join(explored.select("id"), "id", "left_anti")


def initial_batch(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """Uniform sample of exactly ``n`` candidates without replacement."""
    return top_n(pool.withColumn("utility", uniform(F.col("id"), seed)), n, best_utility(), "utility")


def cluster_quotas(sizes: DataFrame, batch: int, pool_rows: int) -> DataFrame:
    """Each cluster's share of a batch, rounded up: ``(cluster_id, quota)``."""
    share = F.ceil(F.lit(float(batch)) * F.col("count") / F.lit(float(pool_rows))).cast("long")
    return sizes.select("cluster_id", share.alias("quota"))


def _by_quota(rows: DataFrame, quotas: DataFrame, pool_rows: int, batch: int) -> DataFrame:
    """Each cluster's best rows; a large pool is narrowed down to likely winners first."""
    worthwhile = pool_rows > SMALL_ROWS and batch < pool_rows // 4
    return top_per_group(rows, "cluster_id", best_utility(), quotas, "utility" if worthwhile else None)


def initial_batch_by_cluster(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """Random sample with a share for every cluster; may exceed ``n`` by the rounding."""
    sizes = cut(pool.groupBy("cluster_id").count())
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    quotas = cluster_quotas(sizes, n, rows)
    return _by_quota(pool.withColumn("utility", uniform(F.col("id"), seed)), quotas, rows, n)


def explore_some_at_random(scored: DataFrame, n: int, seed: int) -> DataFrame:
    """Give ``n`` random candidates unbeatable utility."""
    if n == 0:
        return scored
    drawn = top_n(scored.select("id", uniform(F.col("id"), seed).alias("_u")), n, [F.col("_u").desc(), F.col("id").desc()], "_u")
    flagged = drawn.select("id", F.lit(True).alias("_random"))
    return (
        scored.join(broadcast_if_small(flagged, n), "id", "left")
        .withColumn("utility", F.when(F.col("_random"), F.lit(float("inf"))).otherwise(F.col("utility")))
        .drop("_random")
    )


def acquire_batch(scored: DataFrame, explored: DataFrame, n: int, epsilon: float = 0.0, seed: int = 42) -> DataFrame:
    """The ``n`` unlabelled candidates of highest (utility, id), best first."""
    open_rows = exclude_explored(scored, explored)
    return top_n(explore_some_at_random(open_rows, math.ceil(n * epsilon), seed), n, best_utility(), "utility")


def acquire_batch_by_cluster(
    scored: DataFrame, explored: DataFrame, n: int, iteration: int, temp_i: float | None, temp_f: float
) -> DataFrame:
    """Batch with annealed cluster shares: a cluster whose best falls short of the overall best gets fewer rows."""
    sizes = cut(scored.groupBy("cluster_id").count())
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    quotas = cluster_quotas(sizes, n, rows)
    open_rows = exclude_explored(scored, explored)
    if temp_i is not None:
        best = scored.agg(F.max("y_mean").alias("best")).scalar()
        finite = F.when(F.col("utility") < float("inf"), F.col("utility"))
        local = open_rows.groupBy("cluster_id").agg(F.max(finite).alias("_local"))
        keep = cluster_decay(best, F.col("_local"), temperature(iteration, temp_i, temp_f))
        quotas = quotas.join(local, "cluster_id").select(
            "cluster_id", F.ceil(keep * F.col("quota")).cast("long").alias("quota")
        )
    return _by_quota(open_rows, quotas, rows, n)


def _failures_last() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("id").desc()]


def top_explored(explored: DataFrame, n: int) -> DataFrame:
    """Best labels, failures last."""
    return top_n(explored, n, _failures_last())


def top_predicted(preds: DataFrame, n: int) -> DataFrame:
    """Highest predicted means."""
    return top_n(preds, n, [F.col("y_mean").desc(), F.col("id").desc()], "y_mean")


def first_with_score(log: DataFrame, n: int) -> DataFrame:
    """The rows with a score among the first ``n`` of a final log (the limit comes first)."""
    return log.filter(F.col("row_idx") < n).filter(F.col("score").isNotNull())


def kth_best(explored: DataFrame, k: int, column: str = "score") -> DataFrame:
    """One row: the k-th largest label, or the largest when there are fewer than ``k``. Failures count as -inf."""
    values = explored.select("id", F.coalesce(F.col(column), F.lit(float("-inf"))).alias("y"))
    best = top_n(values, k, [F.col("y").desc(), F.col("id").desc()], "y")
    return best.agg(F.when(F.count(F.lit(1)) >= k, F.min("y")).otherwise(F.max("y")).alias("best"))


def order_statistic(values: DataFrame, column: str, tie: str, position: int) -> DataFrame:
    """Row at a 0-based position in ascending order of ``column``."""
    ranked = rank_within(values, [], [F.col(column).asc(), F.col(tie).asc()], "_rank")
    return ranked.filter(F.col("_rank") == position + 1).drop("_rank")


def draw_with_replacement(pool: DataFrame, rows: int, k: int, replicates: int, seed: int) -> DataFrame:
    """``replicates`` samples of ``k`` rows each; a row may be drawn more than once. ``pool`` has ``row_idx`` from 0."""
    draws = pool.sparkSession.range(k * replicates).select(
        F.floor(F.col("id") / k).cast("int").alias("replicate"),
        (F.col("id") % k).alias("draw"),
        F.floor(uniform(F.col("id"), seed) * rows).cast("long").alias("row_idx"),
    )
    return draws.join(pool, "row_idx")
