"""Training splits and samplers that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform
from .ordered import rank_within

SPLITS = ("train", "val", "test")


def random_split(rows: DataFrame, n: int, sizes: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """Add ``split``: the first floor(size * n) rows in random order train, the next validate, the rest test."""
    if abs(sum(sizes) - 1.0) > 1e-9:
        raise ValueError("split sizes must add up to 1")
    train = int(sizes[0] * n)
    val = int((sizes[0] + sizes[1]) * n)
    ranked = rank_within(rows.withColumn("_u", uniform(F.col("id"), seed)), [], [F.col("_u").asc(), F.col("id").asc()], "_rank")
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_u", "_rank")


def fold_split(rows: DataFrame, folds: int, seed: int) -> DataFrame:
    """Cross-validation by random fold: fold seed % folds tests, the next one validates, the others train."""
    fold = F.floor(uniform(F.col("id"), 0) * folds).cast("int")
    test, val = seed % folds, (seed + 1) % folds
    split = F.when(F.col("fold") == test, "test").when(F.col("fold") == val, "val").otherwise("train")
    return rows.withColumn("fold", fold).withColumn("split", split)


def indexed_split(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Splits from an index table ``(row_idx, split)``; unlisted rows train."""
    return rows.join(index.select("row_idx", "split"), "row_idx", "left").withColumn(
        "split", F.coalesce("split", F.lit("train"))
    )


def balanced_sample(rows: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """Equally many positives and negatives, drawn at random: as many as the rarer class has."""
    known = rows.filter(F.col(label).isNotNull()).withColumn("_u", uniform(F.col("id"), seed))
    fewest = known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).scalar()
    ranked = rank_within(known, [label], [F.col("_u").asc(), F.col("id").asc()], "_rank")
    return ranked.filter(F.col("_rank") <= fewest).drop("_rank", "_u")
