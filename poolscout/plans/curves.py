"""Curves over the acquisition order of finished runs.

A run log has ``(run_id, iter, seq, id, score)``; ``seq`` numbers a run's labels from 1 in the order they were acquired.
Running values go through chunks of ``seq``, so one huge run is as parallel as many small ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scaling import PREDICTION_DOLLARS_PER_ROW, TRAINING_DOLLARS_PER_LABEL
from ..operators.ordered import CHUNK_ROWS, last_known, number_range, running_sums_by_seq, top_n
from ..session import cut


def true_top(scores: DataFrame, k: int) -> DataFrame:
    """The true top-k ``(id, score)``."""
    known = scores.filter(F.col("score").isNotNull()).select("id", "score")
    return top_n(known, k, [F.col("score").desc(), F.col("id").desc()], "score")


def recall_by_score(runs: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Share of true top scores found so far. Scores equal to the lowest true one count only as often as it is true."""
    lowest = hits.agg(F.min("score").alias("t"))
    ties = hits.groupBy("score").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("n", "score").alias("n")).scalar()
    above = F.coalesce((F.col("score") > lowest.scalar()).cast("long"), F.lit(0).cast("long"))
    equal = F.coalesce((F.col("score") == lowest.scalar()).cast("long"), F.lit(0).cast("long"))
    marked = runs.withColumns({"_gt": above, "_eq": equal, "_ties": ties})
    scanned = running_sums_by_seq(marked, ["run_id"], "seq", {"_c_gt": F.col("_gt"), "_c_eq": F.col("_eq")})
    found = F.col("_c_gt") + F.least("_c_eq", "_ties")
    return scanned.withColumn("recall", found / F.lit(float(k))).drop("_gt", "_eq", "_ties", "_c_gt", "_c_eq")


def with_hits(runs: DataFrame, hits: DataFrame) -> DataFrame:
    """Mark rows whose id is among the true hits."""
    return runs.join(hits.select("id", F.lit(True).alias("_hit")), "id", "left").withColumn(
        "is_hit", F.col("_hit").isNotNull()
    ).drop("_hit")


def recall_by_identity(runs: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    marked = with_hits(runs, hits)
    scanned = running_sums_by_seq(marked, ["run_id"], "seq", {"_found": F.col("is_hit").cast("long")})
    return scanned.withColumn("recall", F.col("_found") / F.lit(float(k))).drop("_found", "is_hit")


def running_mean(runs: DataFrame) -> DataFrame:
    """Mean of all labels so far; a failed label counts as 0."""
    scanned = running_sums_by_seq(runs, ["run_id"], "seq", {"_total": F.coalesce("score", F.lit(0.0))})
    return scanned.withColumn("running_mean", F.col("_total") / F.col("seq")).drop("_total")


def running_top_k_average(runs: DataFrame, k: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Average of the ``k`` best labels so far; the first ``k`` positions all show the value at position ``k``.

    Each chunk of a run starts from the ``k`` best of all earlier chunks. These are merged by doubling: after r rounds
    a chunk knows the best of the 2^r chunks before it, so a run of any length needs a logarithmic number of small
    joins. Chunks hold at least 4k rows, which keeps the merged lists well below the size of the data.
    """
    size = max(chunk_rows, 4 * k)
    scores = runs.select("run_id", "seq", "score", F.floor((F.col("seq") - 1) / size).cast("long").alias("chunk"))
    best = (
        scores.filter(F.col("score").isNotNull())
        .withColumn("_rank", F.row_number().over(W.partitionBy("run_id", "chunk").orderBy(F.col("score").desc())))
        .filter(F.col("_rank") <= k)
        .groupBy("run_id", "chunk")
        .agg(F.collect_list("score").alias("best"))
    )
    spans = scores.select("run_id", "chunk").distinct()
    state = cut(spans.join(best, ["run_id", "chunk"], "left").withColumn("best", F.coalesce("best", F.array().cast("array<double>"))))
    chunks = state.agg(F.max("chunk")).first()[0]
    inclusive, reach = state, 1
    while chunks is not None and reach <= chunks:
        earlier = inclusive.select(F.col("run_id").alias("run_id"), (F.col("chunk") + reach).alias("chunk"), F.col("best").alias("_before"))
        joined = inclusive.join(earlier, ["run_id", "chunk"], "left")
        merged = F.slice(F.sort_array(F.concat("best", F.coalesce("_before", F.array().cast("array<double>"))), asc=False), 1, k)
        inclusive = cut(joined.select("run_id", "chunk", merged.alias("best")))
        reach *= 2
    starts = inclusive.select(F.col("run_id").alias("run_id"), (F.col("chunk") + 1).alias("chunk"), F.col("best").alias("best"))

    def walk(rows: pa.Table, start: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        heap = list(start.column("best")[0].as_py()) if start.num_rows else []
        heapq.heapify(heap)
        total = sum(heap)
        out = []
        for y in rows.column("score").to_pylist():
            if y is not None and y == y:
                if len(heap) < k:
                    heapq.heappush(heap, y)
                    total += y
                else:
                    total += y - heapq.heappushpop(heap, y)
            out.append(total / k)
        if out and rows.column("seq")[0].as_py() == 1:
            first = min(k, len(out))
            out[:first] = [out[first - 1]] * first
        return pa.table({"run_id": rows.column("run_id"), "seq": rows.column("seq"), "top_k_avg": pa.array(out, pa.float64())})

    schema = f"run_id {dict(runs.dtypes)['run_id']}, seq long, top_k_avg double"
    return (
        scores.groupBy("run_id", "chunk").cogroup(starts.groupBy("run_id", "chunk")).applyInArrow(walk, schema)
    )


def class_curve(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """Share of each cluster class found so far; position 0 is a zero row, an empty class has no share.
    ``classes`` is ``(id, class)``."""
    kinds = ("singleton", "mid", "large")
    marked = runs.join(classes, "id", "left").withColumns(
        {f"_{c}": F.coalesce((F.col("class") == c).cast("long"), F.lit(0).cast("long")) for c in kinds}
    )
    scanned = running_sums_by_seq(marked, ["run_id"], "seq", {c: F.col(f"_{c}") for c in kinds})
    zero = runs.select("run_id").distinct().select("run_id", F.lit(0).cast("long").alias("seq"), *[F.lit(0).cast("long").alias(c) for c in kinds])
    sizes = {c: classes.filter(F.col("class") == c).agg(F.count(F.lit(1)).alias("n")).scalar() for c in kinds}
    every = scanned.select("run_id", F.col("seq").cast("long").alias("seq"), *kinds).unionByName(zero)
    return every.select("run_id", "seq", *[F.try_divide(F.col(c).cast("double"), sizes[c]).alias(c) for c in kinds])


def moving_average(iterations: DataFrame, window: int, delta: float) -> DataFrame:
    """Moving average of the top-k averages and whether the latest gain is too small to go on.

    ``iterations`` has one row per finished round with enough labels.
    """
    trailing = W.partitionBy("run_id").orderBy("iter").rowsBetween(-(window - 1), 0)
    rows = iterations.withColumn("_n", F.count("top_k_avg").over(trailing)).withColumn(
        "sma", F.when(F.col("_n") == window, F.avg("top_k_avg").over(trailing))
    )
    gain = (F.col("top_k_avg") - F.col("sma")) / F.nullif(F.abs("sma"), F.lit(0.0))
    return rows.withColumn("stop", F.coalesce(gain <= delta, F.lit(False))).drop("_n")


def cost_curve(iterations: DataFrame, pool_rows: int, prune: bool) -> DataFrame:
    """Cumulative dollars per iteration: training on the labels so far plus predicting the remaining pool.

    ``iterations`` is ``(run_id, iter, n_acquired, n_retained)``: labels known before the round's model was fitted and
    rows left after the round's pruning.
    """
    by_run = W.partitionBy("run_id").orderBy("iter")
    predicted = F.coalesce(F.lag("n_retained").over(by_run), F.lit(pool_rows)) if prune else F.lit(pool_rows)
    rows = iterations.withColumn("_predicted", predicted).withColumn(
        "_cost", F.col("n_acquired") * TRAINING_DOLLARS_PER_LABEL + F.col("_predicted") * PREDICTION_DOLLARS_PER_ROW
    )
    total = F.sum("_cost").over(by_run.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("run_id", "iter", "n_acquired", total.alias("cost"))


def align_curves(curves: DataFrame, grid: DataFrame, x: str, y: str) -> DataFrame:
    """Value of each run's step curve at the grid points: the last known one at or before the point (as-of join)."""
    points = curves.select("run_id", F.col(x).alias("x"), F.lit(0).alias("_grid"), F.col(y).alias("y"))
    asked = grid.select("run_id", F.col("x"), F.lit(1).alias("_grid"), F.lit(None).cast("double").alias("y"))
    both = last_known(points.unionByName(asked), ["run_id"], [F.col("x").asc(), F.col("_grid").asc()], ["y"])
    return both.filter("_grid = 1").drop("_grid")


def pad_curves(curves: DataFrame, value: str, edge: bool) -> DataFrame:
    """Extend every run to the longest one, by NULL or by its last value. Only the missing tail is generated."""
    ends = curves.groupBy("run_id").agg(F.max("seq").alias("_end"), F.max_by(value, "seq").alias("_last"))
    longest = curves.agg(F.max("seq").alias("m")).scalar()
    fill = F.col("_last") if edge else F.lit(None).cast("double")
    tail = number_range(ends, F.col("_end") + 1, longest, "seq").select("run_id", "seq", fill.alias(value))
    return curves.select("run_id", "seq", value).unionByName(tail)


def curve_stats(curves: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population s.d. across replicates at each position, missing values ignored."""
    return curves.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def new_points(runs: DataFrame) -> DataFrame:
    """Each run's ids with the first iteration that acquired them."""
    return runs.groupBy("run_id", "id").agg(F.min("iter").alias("iter"))


def acquired_by_iteration(runs: DataFrame) -> DataFrame:
    """Labels known after each iteration, and the size of the initial batch."""
    per = runs.groupBy("run_id", "iter").agg(F.count(F.lit(1)).alias("n_new"))
    by_run = W.partitionBy("run_id").orderBy("iter").rowsBetween(W.unboundedPreceding, 0)
    return per.select(
        "run_id", "iter", "n_new", F.sum("n_new").over(by_run).alias("n_acquired"),
        F.first("n_new").over(by_run).alias("init_size"),
    )


def random_curve(runs: DataFrame, pool_rows: int) -> DataFrame:
    """Expected recall of random search at each position of the longest run."""
    positions = runs.select("seq").distinct()
    return positions.select("seq", (F.col("seq") / F.lit(float(pool_rows))).alias("recall"))
