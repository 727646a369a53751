"""Registry of queries and the SQL fragments they share."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gaussian import SQRT_2PI, TAIL_DENOMINATOR, TAIL_END, TAIL_NUMERATOR, TAIL_SPLIT
from ..session import ship_package


class Tables:
    """The given tables of one scale, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, roles: tuple[str, ...] = ()):
    """Register a function ``Tables -> DataFrame`` under its own name. ``covers`` lists operator ids of the survey."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(name, covers, build, with_roles(roles, sql) if sql else None)
        return build

    return add


def r6(column: Column | str) -> Column:
    """Rounded for comparison between engines."""
    return F.round(column, 6)


# --- roles: derived inputs, written once for Spark and once as SQL ---------------------------------------------------


def preds(t: Tables) -> DataFrame:
    """Predictions: a mean and a variance (exact zeros included) per candidate, clustered by year."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 1000).alias("y_mean"),
        ((F.substring("o_orderpriority", 1, 1).cast("double") - 1) * 25.0).alias("y_var"),
        F.year("o_orderdate").alias("cluster_id"),
    )


def explored(t: Tables) -> DataFrame:
    """Labels of the finished orders; an unspecified priority is a failed label."""
    return t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice") / 1000).alias("score"),
        (F.year("o_orderdate") - 1995).alias("iter"),
    )


def run_rows(t: Tables) -> DataFrame:
    """Run log without its numbering: five runs over the events; an error event is a failed label."""
    return t.events.select(
        (F.col("user_id") % 5).alias("run_id"),
        "ts",
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("score"),
    )


def runs(t: Tables) -> DataFrame:
    """Run log ``(run_id, seq, iter, id, score)`` with twenty equal iterations per run."""
    from ..operators.ordered import rank_within

    rows = run_rows(t)
    numbered = rank_within(rows, ["run_id"], [F.col("ts").asc(), F.col("id").asc()], "seq", total="n")
    return numbered.select("run_id", "seq", F.expr("cast((seq - 1) * 20 div n as int)").alias("iter"), "id", "score")


def pool_scores(t: Tables) -> DataFrame:
    """True scores of the run log's pool."""
    return t.events.select(F.col("event_id").alias("id"), F.col("value").alias("score"))


def trials(t: Tables) -> DataFrame:
    """Labels of repeated runs of two arms on five targets."""
    return t.events.select(
        F.col("event_type").alias("target"),
        F.when(F.col("user_id") % 2 == 0, "full").otherwise("prune").alias("arm"),
        (F.col("user_id") % 3).alias("rep"),
        F.col("event_id").alias("id"),
        F.col("value").alias("score"),
    )


def retained_sizes(t: Tables) -> DataFrame:
    """Rows left per run and iteration: what a run labels from that iteration on stands for its retained pool."""
    from ..plans.curves import acquired_by_iteration

    per = acquired_by_iteration(runs(t))
    total = per.groupBy("run_id").agg(F.sum("n_new").alias("total"))
    return per.join(total, "run_id").select(
        "run_id", (F.col("iter") + 1).alias("iter"), "n_acquired", (F.col("total") - F.col("n_acquired")).alias("n_retained")
    )


ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "preds": (
        (),
        "SELECT o_orderkey AS id, o_totalprice / 1000 AS y_mean, "
        "(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) - 1) * 25.0 AS y_var, "
        "CAST(year(o_orderdate) AS INTEGER) AS cluster_id FROM orders",
    ),
    "explored": (
        (),
        "SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice / 1000 END AS score, "
        "CAST(year(o_orderdate) - 1995 AS INTEGER) AS iter FROM orders WHERE o_orderstatus = 'F'",
    ),
    "runs": (
        (),
        "SELECT run_id, seq, CAST((seq - 1) * 20 // n AS INTEGER) AS iter, id, score FROM ("
        "SELECT user_id % 5 AS run_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS seq, "
        "count(*) OVER (PARTITION BY user_id % 5) AS n, event_id AS id, "
        "CASE WHEN event_type <> 'error' THEN value END AS score FROM events)",
    ),
    "pool_scores": ((), "SELECT event_id AS id, value AS score FROM events"),
    "trials": (
        (),
        "SELECT event_type AS target, CASE WHEN user_id % 2 = 0 THEN 'full' ELSE 'prune' END AS arm, "
        "user_id % 3 AS rep, event_id AS id, value AS score FROM events",
    ),
    "acquired": (
        ("runs",),
        "SELECT run_id, iter, n_new, CAST(sum(n_new) OVER (PARTITION BY run_id ORDER BY iter) AS BIGINT) AS n_acquired, "
        "first_value(n_new) OVER (PARTITION BY run_id ORDER BY iter) AS init_size "
        "FROM (SELECT run_id, iter, count(*) AS n_new FROM runs GROUP BY ALL)",
    ),
    "retained_sizes": (
        ("runs", "acquired"),
        "SELECT run_id, iter + 1 AS iter, n_acquired, "
        "CAST(sum(n_new) OVER (PARTITION BY run_id) - n_acquired AS BIGINT) AS n_retained FROM acquired",
    ),
}


def with_roles(names: tuple[str, ...], sql: str) -> str:
    """Prefix a query with the roles it reads; a query that starts with WITH continues their list."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in ROLES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({ROLES[n][1]})" for n in ordered)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if body.upper().startswith("WITH "):
        body = ",\n" + body[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{body if body.startswith(',') else chr(10) + body}"


# --- SQL text of the scalar functions ---------------------------------------------------------------------------------


def uniform_sql(id_sql: str, seed: int) -> str:
    digits = f"substr(md5(concat(CAST({id_sql} AS VARCHAR), ':{seed}')), 1, 13)"
    return f"(CAST(CAST(concat('0x', {digits}) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


def normal_sql(id_sql: str, seed: int) -> str:
    return (
        f"(sqrt(-2.0 * ln(1.0 - {uniform_sql(id_sql, seed)})) * cos(2.0 * pi() * {uniform_sql(id_sql, seed + 1)}))"
    )


def pdf_sql(z: str) -> str:
    return f"(exp(-0.5 * ({z}) * ({z})) / {math.sqrt(2 * math.pi)!r})"


def _horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"(({text}) * {x} + {c!r})"
    return text


def phi_sql(z: str) -> str:
    """Normal distribution function of a column."""
    x = f"abs({z})"
    decay = f"exp(-0.5 * {x} * {x})"
    near = f"{decay} * {_horner_sql(TAIL_NUMERATOR, x)} / {_horner_sql(TAIL_DENOMINATOR, x)}"
    far = f"{decay} / ({x} + 1.0 / ({x} + 2.0 / ({x} + 3.0 / ({x} + 4.0 / ({x} + 0.65))))) / {SQRT_2PI!r}"
    tail = f"(CASE WHEN {x} > {TAIL_END!r} THEN 0.0 WHEN {x} < {TAIL_SPLIT!r} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN 1.0 - {tail} WHEN {z} <= 0 THEN {tail} END)"


def hit_probability_sql(source: str, threshold: str, columns: str = "*") -> str:
    """Query over ``source(y_mean, y_var)`` that adds ``p_hit``."""
    return (
        f"SELECT {columns}, CASE WHEN y_var = 0 THEN CAST(y_mean >= t AS DOUBLE) ELSE {phi_sql('z')} END AS p_hit FROM ("
        f"SELECT *, (y_mean - t) / sqrt(nullif(y_var, 0)) AS z FROM (SELECT *, {threshold} AS t FROM {source}))"
    )
