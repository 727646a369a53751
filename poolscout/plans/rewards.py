"""What finished runs found, compared with the truth and with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.ordered import top_n_each
from ..operators.stats import replicate_stats, t_statistic


def found_top(runs: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Each run's ``n`` best labels, failures last."""
    order = [F.col("score").desc_nulls_last(), F.col("id").desc()]
    return top_n_each(runs, keys, n, order)


def rewards(runs: DataFrame, keys: Sequence[str], hits: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Per run: ratio of average scores, share of true ids found, share of true scores found (with repeats).

    ``by`` names the run keys that have their own true hits, such as the target.
    """
    by = list(by)
    found = found_top(runs, keys, n).select(*keys, "id", "score")
    marked = hits.select(*by, "id", F.lit(1).alias("_true"))
    truth = hits.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("_n_true"))
    true_mean = hits.groupBy(*by).agg(F.avg("score").alias("_true_avg"))
    by_id = found.join(marked, [*by, "id"], "left").groupBy(*keys).agg(
        F.avg("score").alias("_avg"), (F.count("_true") / F.lit(float(n))).alias("f_ids")
    )
    by_id = by_id.join(true_mean, by) if by else by_id.withColumn("_true_avg", true_mean.scalar())
    counts = found.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_n_found")).join(truth, [*by, "score"])
    by_score = counts.groupBy(*keys).agg((F.sum(F.least("_n_found", "_n_true")) / F.lit(float(n))).alias("f_scores"))
    return by_id.join(by_score, list(keys), "left").select(
        *keys, (F.col("_avg") / F.col("_true_avg")).alias("f_avg"), "f_ids", F.coalesce("f_scores", F.lit(0.0)).alias("f_scores")
    )


def score_recall_by_iteration(runs: DataFrame, keys: Sequence[str], hits: DataFrame, n: int) -> DataFrame:
    """Share of true scores found after every iteration.

    The labels above the lowest true score are all among a run's best ``n``, so counting them per iteration gives the
    same share as taking the best ``n`` anew after each iteration.
    """
    lowest = hits.agg(F.min("score").alias("t"))
    ties = hits.groupBy("score").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("n", "score").alias("n")).scalar()
    above = F.coalesce((F.col("score") > lowest.scalar()).cast("long"), F.lit(0).cast("long"))
    equal = F.coalesce((F.col("score") == lowest.scalar()).cast("long"), F.lit(0).cast("long"))
    per = runs.withColumns({"_gt": above, "_eq": equal}).groupBy(*keys, "iter").agg(
        F.sum("_gt").alias("_gt"), F.sum("_eq").alias("_eq"), F.count(F.lit(1)).alias("_n")
    )
    so_far = W.partitionBy(*keys).orderBy("iter").rowsBetween(W.unboundedPreceding, 0)
    rows = per.withColumns({"_c_gt": F.sum("_gt").over(so_far), "_c_eq": F.sum("_eq").over(so_far), "_ties": ties})
    share = (F.col("_c_gt") + F.least("_c_eq", "_ties")) / F.lit(float(n))
    return rows.select(*keys, "iter", F.sum("_n").over(so_far).alias("n_acquired"), share.alias("f_scores"))


def class_recall(runs: DataFrame, keys: Sequence[str], classes: DataFrame, n: int) -> DataFrame:
    """Share of each cluster class among a run's ``n`` best labels."""
    kinds = ("large", "mid", "singleton")
    sizes = {c: classes.filter(F.col("class") == c).agg(F.count(F.lit(1)).alias("n")).scalar() for c in kinds}
    found = found_top(runs, keys, n).join(classes, "id", "left")
    counts = found.groupBy(*keys).agg(*[F.count(F.when(F.col("class") == c, 1)).cast("double").alias(f"_{c}") for c in kinds])
    return counts.select(*keys, *[F.try_divide(F.col(f"_{c}"), sizes[c]).alias(f"f_{c}") for c in kinds])


def collate(rewards_by_arm: DataFrame, arms: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """One column per arm."""
    return rewards_by_arm.groupBy(*keys).pivot("arm", list(arms)).agg(F.first(value))


def compare_arms(rewards_by_run: DataFrame, calls: DataFrame, base: str, other: str) -> DataFrame:
    """Per target: mean and s.d. of both arms' rewards and of the other arm's relative inference calls."""
    stats = replicate_stats(rewards_by_run, ["target", "arm"])
    wide = stats.groupBy(F.upper("target").alias("target")).pivot("arm", [base, other]).agg(
        F.first("mean").alias("mean"), F.first("sd").alias("sd")
    )
    call_stats = calls.groupBy(F.upper("target").alias("target")).agg(
        F.avg("relative_calls").alias("calls_mean"), F.stddev_pop("relative_calls").alias("calls_sd")
    )
    return wide.join(call_stats, "target")


def arm_tests(rewards_by_run: DataFrame, base: str, other: str, population_sd: bool = False) -> DataFrame:
    """Per target: t and degrees of freedom of "other is lower than base"."""
    sd = F.stddev_pop("value") if population_sd else F.stddev_samp("value")
    stats = rewards_by_run.groupBy("target", "arm").agg(F.avg("value").alias("m"), sd.alias("s"), F.count("value").alias("n"))
    wide = stats.groupBy("target").pivot("arm", [base, other]).agg(
        F.first("m").alias("m"), F.first("s").alias("s"), F.first("n").alias("n")
    )
    c = {name: F.col(name) for name in wide.columns}
    t, freedom = t_statistic(
        c[f"{other}_m"], c[f"{other}_s"], c[f"{other}_n"], c[f"{base}_m"], c[f"{base}_s"], c[f"{base}_n"], population_sd
    )
    return wide.select("target", t.alias("t"), freedom.cast("long").alias("freedom"))
