"""Label tables and score files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import number_lines, read_columns


def to_score(text: Column) -> Column:
    """Number in a text; anything else, and NaN, is a failed label (NULL)."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def signed(score: Column, maximize: bool = True) -> Column:
    """Scores are always maximised inside; a minimised objective changes sign here."""
    return score if maximize else -score


def _read_pairs(spark: SparkSession, path: str, id_column: int, score_column: int, header: bool, sep: str) -> DataFrame:
    lines = read_columns(spark, path, {"id": id_column, "text": score_column}, header, sep)
    return number_lines(lines.withColumn("_lib", F.lit(0))).withColumn("score", to_score(F.col("text")))


def read_label_table(
    spark: SparkSession, path: str, id_column: int = 0, score_column: int = 1, header: bool = True, sep: str = ","
) -> DataFrame:
    """Label table ``(id, score)`` for lookups. Rows without a number are dropped; the last row of an id wins."""
    pairs = _read_pairs(spark, path, id_column, score_column, header, sep).filter(F.col("score").isNotNull())
    return pairs.groupBy("id").agg(F.max_by("score", "row_idx").alias("score"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Earlier scores ``(id, score)`` from a two-column file with header; no number means a failed label."""
    return _read_pairs(spark, path, 0, 1, True, ",").groupBy("id").agg(F.max_by("score", "row_idx").alias("score"))


def split_scores(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successes, failures)."""
    return scores.filter(F.col("score").isNotNull()), scores.filter(F.col("score").isNull())


def true_scores(
    spark: SparkSession, path: str, id_column: int = 0, score_column: int = 1, header: bool = True,
    maximize: bool = True, sep: str = ",",
) -> DataFrame:
    """True scores with the sign of a maximised objective."""
    table = read_label_table(spark, path, id_column, score_column, header, sep)
    return table.withColumn("score", signed(F.col("score"), maximize))
