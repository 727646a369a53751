"""Candidate libraries: delimited text files with one identifier per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import broadcast_if_small, cut

# Fixed value: the extended suffix starts at a blank followed by a text between two pipes.
EXTENDED_SUFFIX = r"\s\|.*\|"


def strip_suffix(id_col: Column) -> Column:
    """The part of an identifier before its extended suffix."""
    return F.split(id_col, EXTENDED_SUFFIX)[0]


def read_columns(
    spark: SparkSession, path: str, columns: dict[str, int], header: bool = True, sep: str = ","
) -> DataFrame:
    """Read text columns by position; a quoted field doubles its quotes. gzip is recognised by its file suffix."""
    raw = spark.read.csv(path, header=header, sep=sep, quote='"', escape='"')
    return raw.select(
        *[F.col(f"`{raw.columns[i]}`").alias(name) for name, i in columns.items()],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``row_idx``, the position over all files in file order, and drop the file columns.

    Lines of one file split are read in order by one task, so only one row per split has to be summed up. The split
    layout depends on the number of executors, so the lines are materialised before they are read twice.
    """
    fixed = cut(lines)
    split = ["_lib", "_file", "_block"]
    before = W.partitionBy(F.lit(0)).orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    starts = cut(
        fixed.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        fixed.join(broadcast_if_small(starts, starts.count()), split)
        .withColumn("row_idx", F.col("_pos") - F.col("_start") + F.col("_offset"))
        .drop(*split, "_pos", "_start", "_offset")
    )


def read_library(
    spark: SparkSession,
    paths: Sequence[str],
    id_column: int = 0,
    header: bool = True,
    sep: str = ",",
    suffix: bool = False,
) -> DataFrame:
    """Scan library files in the given order into ``(row_idx, id)``."""
    parts = [
        read_columns(spark, path, {"id": id_column}, header, sep).withColumn("_lib", F.lit(i))
        for i, path in enumerate(paths)
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    if suffix:
        lines = lines.withColumn("id", strip_suffix(F.col("id")))
    return number_lines(lines).select("row_idx", "id")


def skip_rows(pool: DataFrame, invalid: DataFrame) -> DataFrame:
    """Drop the rows whose ``row_idx`` is listed in ``invalid``."""
    return pool.join(invalid.select("row_idx"), "row_idx", "left_anti")


def deduplicate(pool: DataFrame) -> DataFrame:
    """One row per identifier: its first ``row_idx``."""
    return pool.groupBy("id").agg(F.min("row_idx").alias("row_idx")).select("row_idx", "id")
