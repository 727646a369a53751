"""Ranks, running values and top-n that do not put a key's rows into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a key's rows are cut into ordered
chunks, each chunk is scanned on its own, and one small row per (key, chunk) carries the totals of earlier chunks over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import SMALL_ROWS, broadcast_if_small, cut

CHUNK_ROWS = 1_000_000
#: Largest per-key limit for which Spark keeps only the best rows of every task before it shuffles.
GROUP_LIMIT = 1000
#: Upper shares of a column whose approximate cut-off is known when a large top-n is narrowed down.
TAIL_SHARES = (0.5, 0.25, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)


@dataclass(frozen=True)
class Chunks:
    """Ordered chunks: ``_chunk`` and, rising inside a chunk, ``_pos``. ``totals_rows`` bounds the (key, chunk) pairs."""

    rows: DataFrame
    totals_rows: int


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> Chunks:
    """Range-partition by (keys, order), so a heavy key spreads over many chunks.

    The sampled bounds may differ between two evaluations of one plan, so the result is checkpointed before it is
    read twice. The number of keys is counted on the way.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    seen = Observation()
    n_keys = F.approx_count_distinct(F.struct(*keys)) if keys else F.max(F.lit(1))
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).observe(seen, n_keys.alias("keys"))
    rows = cut(
        ranged.withColumn("_chunk", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    )
    return Chunks(rows, 2 * (seen.get["keys"] or 0) + rows.rdd.getNumPartitions())


def _by_keys(keys: Sequence[str]) -> list:
    return list(keys) or [F.lit(0)]


def _attach(rows: DataFrame, carried: DataFrame, keys: Sequence[str], carried_rows: int) -> DataFrame:
    """Add the carried columns to every row of their (key, chunk); a broadcast while the carried rows are few."""
    names = [*keys, "_chunk"]
    renamed = carried.select(
        *[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in carried.columns if c not in names]
    )
    on = reduce(lambda a, b: a & b, [rows[n].eqNullSafe(renamed[f"_r_{n}"]) for n in names])
    return rows.join(broadcast_if_small(renamed, carried_rows), on, "left").drop(*[f"_r_{n}" for n in names])


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank", total: str | None = None
) -> DataFrame:
    """Row number (from 1) within each key, and with ``total`` the key's row count. ``order`` should end in a unique
    column."""
    chunks = range_chunks(df, keys, order)
    per_chunk = chunks.rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    before = W.partitionBy(*_by_keys(keys)).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*_by_keys(keys))
    carried = per_chunk.select(
        *keys, "_chunk", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start") + 1).alias("_shift"),
        *([F.sum("_n").over(everything).alias(total)] if total else []),
    )
    return (
        _attach(chunks.rows, carried, keys, chunks.totals_rows)
        .withColumn(out, F.col("_pos") + F.col("_shift"))
        .drop("_chunk", "_pos", "_shift")
    )


def _scan(rows: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column], totals_rows: int) -> DataFrame:
    """Running sums over chunked rows: inside the chunk by a window, across chunks by the carried totals."""
    valued = rows.withColumns({f"_v_{n}": v for n, v in sums.items()})
    per_chunk = valued.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = W.partitionBy(*_by_keys(keys)).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = per_chunk.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = valued.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    return (
        _attach(local, carried, keys, totals_rows)
        .withColumns({n: F.col(f"_b_{n}") + F.col(f"_l_{n}") for n in sums})
        .drop(*[f"{p}{n}" for n in sums for p in ("_v_", "_l_", "_b_")])
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Running sums (current row included) within each key, for any order. Values must not be NULL."""
    chunks = range_chunks(df, keys, order)
    return _scan(chunks.rows, keys, "_pos", sums, chunks.totals_rows).drop("_chunk", "_pos")


def running_sums_by_seq(
    df: DataFrame, keys: Sequence[str], seq: str, sums: Mapping[str, Column], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Running sums where ``seq`` already numbers a key's rows from 1: the chunk is plain arithmetic, and the totals
    join reuses the shuffle of the window."""
    chunked = df.withColumn("_chunk", F.floor((F.col(seq) - 1) / chunk_rows).cast("long"))
    return _scan(chunked, keys, seq, sums, SMALL_ROWS + 1).drop("_chunk")


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]
) -> DataFrame:
    """Replace each value by the last non-NULL one up to and including the row, within each key."""
    chunks = range_chunks(df, keys, order)
    inside = W.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*_by_keys(keys)).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = chunks.rows.groupBy(*keys, "_chunk").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_pos"))).alias(f"_e_{v}") for v in values]
    )
    carried = ends.select(
        *keys, "_chunk", *[F.last(f"_e_{v}", ignorenulls=True).over(before).alias(f"_b_{v}") for v in values]
    )
    local = chunks.rows.withColumns({f"_l_{v}": F.last(v, ignorenulls=True).over(inside) for v in values})
    return (
        _attach(local, carried, keys, chunks.totals_rows)
        .withColumns({v: F.coalesce(F.col(f"_l_{v}"), F.col(f"_b_{v}")) for v in values})
        .drop("_chunk", "_pos", *[f"{p}{v}" for v in values for p in ("_l_", "_b_")])
    )


def _cut_offs(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Per key its row count and the column's approximate value at each upper share."""
    cuts = F.percentile_approx(column, [1.0 - s for s in TAIL_SHARES], 10_000)
    return df.groupBy(*keys).agg(F.count(column).alias("_n"), cuts.alias("_cuts"))


def _cut_off(wanted: Column) -> Column:
    """The highest cut-off that should still leave half as many rows again as wanted; NULL when none does."""
    choice = F.lit(None).cast("double")
    for i, share in enumerate(TAIL_SHARES):
        choice = F.when(F.col("_n") * F.lit(share) >= wanted * 1.5, F.col("_cuts")[i].cast("double")).otherwise(choice)
    return choice


def narrow_top(df: DataFrame, n: int, column: str) -> DataFrame:
    """Drop rows that cannot be among the ``n`` largest of ``column``. The cut-off is approximate, so it is used only
    when a count shows that at least ``n`` rows reach it."""
    cut_off = _cut_offs(df, [], column).select(_cut_off(F.lit(n)).alias("c")).first()["c"]
    if cut_off is None:
        return df
    reached = df.filter(F.col(column) >= cut_off)
    return reached if reached.count() >= n else df


def top_n(
    df: DataFrame, n: int, order: Sequence[Column], largest: str | None = None, gather_rows: int = SMALL_ROWS
) -> DataFrame:
    """The first ``n`` rows by ``order``, in that order.

    A small ``n`` is Spark's own top-k, which merges every task's best ``n`` in one place. A large ``n`` is ranked
    across the cluster instead, so nothing that grows with the pool meets in one task. ``largest`` names the number
    column by which ``order`` begins, largest first; it lets most rows be dropped before they are moved.
    """
    if n <= gather_rows:
        return df.orderBy(*order).limit(n)
    candidates = df if largest is None else narrow_top(df, n, largest)
    return rank_within(candidates, [], order, "_rank").filter(F.col("_rank") <= n).orderBy("_rank").drop("_rank")


def top_n_each(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of every key. A small literal limit is applied in every task before the shuffle."""
    if n <= GROUP_LIMIT:
        ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    else:
        ranked = rank_within(df, keys, order, "_rank")
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def top_per_group(
    df: DataFrame, key: str, order: Sequence[Column], quotas: DataFrame, largest: str | None = None, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Up to ``quotas.quota`` first rows of each key; ``quotas(key, quota)`` has one row per key.

    While the largest quota is small, Spark's group limit keeps that many rows of each key and task and only these move. Beyond
    it the rows are ranked across the cluster: with ``largest``, as in ``top_n``, the rows below a key's approximate cut-off are dropped before the rest is moved
    and ranked; a key whose cut-off turns out to leave too few rows keeps all of them.
    """
    wanted = cut(quotas.select(F.col(key).alias("_q_key"), F.col("quota").alias("_quota")))
    known = wanted.agg(F.count("_quota").alias("n"), F.max("_quota").alias("most")).first()
    n_keys, most = known["n"], known["most"] or 0
    if most <= group_limit:
        joined = df.join(broadcast_if_small(wanted, n_keys), df[key].eqNullSafe(wanted["_q_key"])).drop("_q_key")
        ranked = joined.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
        return ranked.filter((F.col("_rank") <= most) & (F.col("_rank") <= F.col("_quota"))).drop("_rank", "_quota")
    if largest is not None:
        wanted = cut(_with_cut_off(df, key, largest, wanted, n_keys))
    joined = df.join(broadcast_if_small(wanted, n_keys), df[key].eqNullSafe(wanted["_q_key"]))
    if largest is not None:
        joined = joined.filter(F.col("_cut").isNull() | (F.col(largest) >= F.col("_cut"))).drop("_cut")
    ranked = rank_within(joined.drop("_q_key"), [key], order, "_rank")
    return ranked.filter(F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")


def _with_cut_off(df: DataFrame, key: str, column: str, wanted: DataFrame, n_keys: int) -> DataFrame:
    cuts = _cut_offs(df.select(F.col(key).alias("_c_key"), column), ["_c_key"], column)
    first = wanted.join(cuts, wanted["_q_key"].eqNullSafe(cuts["_c_key"]), "left").select(
        "_q_key", "_quota", _cut_off(F.col("_quota")).alias("_cut")
    )
    limits = first.select(F.col("_q_key").alias("_c_key"), F.col("_cut").alias("_c_cut"))
    reached = (
        df.join(broadcast_if_small(limits, n_keys), df[key].eqNullSafe(limits["_c_key"]))
        .groupBy("_c_key")
        .agg(F.count(F.when(F.col(column) >= F.col("_c_cut"), 1)).alias("_reached"))
    )
    enough = F.when(F.col("_reached") >= F.col("_quota"), F.col("_cut"))
    return first.join(reached, first["_q_key"].eqNullSafe(reached["_c_key"]), "left").select(
        "_q_key", "_quota", enough.alias("_cut")
    )


def number_range(df: DataFrame, low: Column, high: Column, out: str, block: int = 100_000) -> DataFrame:
    """One row per integer from ``low`` to ``high``. Blocks are listed first, so a long range is never one array."""
    blocks = df.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).filter("_low <= _high")
    n_blocks = F.floor((F.col("_high") - F.col("_low")) / block).cast("long")
    spread = blocks.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks)))
    first = F.col("_low") + F.col("_b") * block
    return spread.withColumn(
        out, F.explode(F.sequence(first, F.least(first + (block - 1), F.col("_high"))))
    ).drop("_low", "_high", "_b")
