"""Wide tables with several targets per row, and their validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scores import to_score


def target_scores(table: DataFrame, target: str) -> DataFrame:
    """One target column of a wide text table without its blanks."""
    return table.select(to_score(F.col(target)).alias("score")).filter(F.col("score").isNotNull())


def task_columns(
    columns: Sequence[str], id_columns: Sequence[str] | None, target_columns: Sequence[str] | None,
    ignore_columns: Sequence[str] | None,
) -> tuple[list[str], list[str]]:
    """Identifier and target columns: the first column and all others, unless named."""
    ids = list(id_columns or columns[:1])
    if target_columns is not None:
        return ids, list(target_columns)
    return ids, [c for c in columns if c not in {*ids, *(ignore_columns or ())}]


def read_multitask(
    table: DataFrame,
    id_columns: Sequence[str] | None = None,
    target_columns: Sequence[str] | None = None,
    ignore_columns: Sequence[str] | None = None,
    skip_all_missing: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Identifiers and numeric targets of a text table; blanks become NULL.

    ``max_rows`` takes the first rows of the file, so it needs their number in ``row_idx``, which is no target.
    """
    if max_rows is not None:
        if "row_idx" not in table.columns:
            raise ValueError("max_rows needs a column row_idx: a table has no first rows otherwise")
        table = table.filter(F.col("row_idx") < max_rows)
    ids, targets = task_columns([c for c in table.columns if c != "row_idx"], id_columns, target_columns, ignore_columns)
    tasks = table.select(*ids, *[F.nullif(F.trim(F.col(t).cast("string")), F.lit("")).cast("double").alias(t) for t in targets])
    if skip_all_missing:
        tasks = tasks.na.drop(how="all", subset=targets)
    return tasks


def unpivot_tasks(tasks: DataFrame, ids: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row per (row, task)."""
    return tasks.unpivot(list(ids), list(targets), "task", "target")


def table_errors(table: DataFrame, id_column: str, targets: Sequence[str], valid_id: str, header: Sequence[str]) -> DataFrame:
    """Messages on what is wrong with a text table, one per row; empty when nothing is.

    ``valid_id`` is a SQL predicate over the table. All data checks are one aggregation.
    """
    numbers = [F.col(t).try_cast("double") for t in targets]
    filled = [F.nullif(F.trim(F.col(t)), F.lit("")) for t in targets]
    any_not_numeric = F.lit(False)
    all_missing = F.lit(True)
    for number, text in zip(numbers, filled):
        any_not_numeric = any_not_numeric | (text.isNotNull() & number.isNull())
        all_missing = all_missing & text.isNull()
    n_missing_ends = F.col(targets[-1]).isNull() if targets else F.lit(False)
    checks = {
        "an identifier is not valid": F.bool_or(~F.coalesce(F.expr(valid_id), F.lit(False))),
        "a row has fewer fields than the header": F.bool_or(n_missing_ends),
        "a row has no target": F.bool_or(all_missing),
        "a target is not a number": F.bool_or(any_not_numeric),
        "the header is empty": F.lit(len(header) == 0),
        "there are no task columns": F.lit(len(targets) == 0),
        "the header looks like data": F.lit(any(_is_number(h) for h in header)),
    }
    names = {f"c{i}": message for i, message in enumerate(checks)}
    row = table.agg(*[F.coalesce(check, F.lit(False)).alias(f"c{i}") for i, check in enumerate(checks.values())])
    messages = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (
        row.unpivot([], list(names), "check", "failed")
        .filter("failed")
        .select(messages[F.col("check")].alias("message"))
    )


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def task_type_ok(tasks: DataFrame, targets: Sequence[str], classification: bool) -> DataFrame:
    """One row per task: whether its targets fit the kind of task. Classes are 0 and 1; a regression has others."""
    long = unpivot_tasks(tasks, [], targets)
    binary = F.coalesce(F.bool_and(F.col("target").isin(0.0, 1.0)), F.lit(True))
    return long.groupBy("task").agg((binary if classification else ~binary).alias("ok"))
