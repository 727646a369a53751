"""How good predictions are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums

VARIANCE_FLOOR = 1e-5


def regression_metrics(target: Column, pred: Column) -> dict[str, Column]:
    """mse, rmse, mae and r2 as aggregates of one pass."""
    square = (target - pred) * (target - pred)
    return {
        "mse": F.avg(square),
        "rmse": F.sqrt(F.avg(square)),
        "mae": F.avg(F.abs(target - pred)),
        "r2": F.lit(1.0) - F.sum(square) / F.nullif(F.var_pop(target) * F.count(target), F.lit(0.0)),
    }


def classification_metrics(target: Column, prob: Column) -> dict[str, Column]:
    """Accuracy at 0.5 and binary cross entropy."""
    eps = F.lit(1e-15)
    p = F.least(F.greatest(prob, eps), F.lit(1.0) - eps)
    loss = -(target * F.log(p) + (F.lit(1) - target) * F.log(F.lit(1.0) - p))
    return {
        "accuracy": F.avg(((prob > 0.5).cast("int") == target).cast("double")),
        "binary_cross_entropy": F.avg(loss),
    }


def cross_entropy(target: Column, probs: Sequence[Column]) -> Column:
    """Mean negative log probability of the true class."""
    eps = F.lit(1e-15)
    chosen = F.element_at(F.array(*probs), target.cast("int") + 1)
    return F.avg(-F.log(F.least(F.greatest(chosen, eps), F.lit(1.0) - eps)))


def gaussian_nll(target: Column, mean: Column, var: Column) -> Column:
    """Negative log likelihood without its constant; the variance has a floor."""
    v = F.greatest(var, F.lit(VARIANCE_FLOOR))
    return F.avg((F.log(v) + (mean - target) * (mean - target) / v) / 2)


def _per_score(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, combined before any shuffle."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((F.lit(1) - F.col(label)).cast("long")).alias("neg")
    )


def roc_auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve per key; ties count half. NULL when a key has one class only."""
    scanned = running_sums(_per_score(df, keys, label, score), keys, [F.col("score").asc()], {"below": F.col("neg")})
    wins = F.col("pos") * (F.col("below") - F.col("neg") / F.lit(2.0))
    return scanned.groupBy(*keys).agg(
        (F.sum(wins) / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("auc")
    )


def pr_auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the precision-recall curve per key by trapezoids, starting at precision 1."""
    scanned = running_sums(
        _per_score(df, keys, label, score), keys, [F.col("score").desc()], {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")}
    )
    earlier_n = F.col("n") - F.col("pos") - F.col("neg")
    earlier = F.when(earlier_n == 0, F.lit(1.0)).otherwise((F.col("tp") - F.col("pos")) / F.nullif(earlier_n, F.lit(0)))
    area = F.col("pos") * (F.col("tp") / F.col("n") + earlier) / F.lit(2.0)
    return scanned.groupBy(*keys).agg((F.sum(area) / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))


def class_shares(long_tasks: DataFrame) -> DataFrame:
    """Share of each class per task; NULL targets ignored."""
    one = F.avg("target")
    return long_tasks.groupBy("task").agg((F.lit(1.0) - one).alias("share_0"), one.alias("share_1"))


def per_task(long_tasks: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Metrics per task over its non-NULL targets (columns task, target, pred)."""
    rows = long_tasks.filter(F.col("target").isNotNull())
    return rows.groupBy("task").agg(*[m.alias(name) for name, m in metrics.items()])
