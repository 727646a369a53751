"""Row-level pool operators: validation, indexing, batching, set operations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import number_range

Index = int | slice


def mark_valid(pool: DataFrame, valid: Column) -> DataFrame:
    """Identifiers that fail the check become NULL."""
    return pool.withColumn("id", F.when(valid, F.col("id")))


def invalid_rows(pool: DataFrame, valid: Column) -> DataFrame:
    """Row numbers of identifiers that fail the check."""
    return pool.filter(~F.coalesce(valid, F.lit(False))).select("row_idx")


def drop_invalid(rows: DataFrame, ids: str, valid) -> DataFrame:
    """Keep rows with a non-empty identifier list whose identifiers are all non-empty and pass ``valid``."""
    return rows.filter(
        (F.size(ids) > 0) & F.forall(ids, lambda x: F.coalesce((F.length(x) > 0) & valid(x), F.lit(False)))
    )


def contains(pool: DataFrame, candidate) -> DataFrame:
    """One row: whether the pool holds the identifier. The filter reaches the scan and the first match ends it."""
    return pool.filter(F.col("id") == F.lit(candidate)).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def _ranges(wanted: Sequence[Index], rows: int) -> list[tuple[int, int, int, int]]:
    """(place, first, last, step) of every index in the order asked."""
    out = []
    for place, index in enumerate(wanted):
        if isinstance(index, slice):
            start, stop, step = index.indices(rows)
            if step < 1:
                raise IndexError("slices must go forward")
            if start < stop:
                out.append((place, start, stop - 1, step))
        elif not -rows <= index < rows:
            raise IndexError(f"row {index} is outside a pool of {rows}")
        else:
            at = index if index >= 0 else index + rows
            out.append((place, at, at, 1))
    return out


def fetch_rows(pool: DataFrame, index: Index | Sequence[Index], rows: int) -> DataFrame:
    """Rows by position, slice or several of either, in the order asked and as often as asked. ``place`` numbers the request.

    The positions are a small table of ranges, spread to rows by Spark and joined; Spark broadcasts it while it is small.
    """
    wanted = list(index) if isinstance(index, (list, tuple)) else [index]
    ranges = pool.sparkSession.createDataFrame(_ranges(wanted, rows), "place long, first long, last long, step long")
    spread = number_range(ranges, F.lit(0), F.floor((F.col("last") - F.col("first")) / F.col("step")), "_k")
    positions = spread.select("place", (F.col("first") + F.col("_k") * F.col("step")).alias("row_idx"))
    return pool.join(positions, "row_idx").select("place", *pool.columns).orderBy("place", "row_idx")


def number_batches(pool: DataFrame, sizes: int | Sequence[int]) -> DataFrame:
    """Add ``batch``: equal sizes, or a list of sizes whose last batch takes the rest."""
    at = F.col("row_idx")
    if isinstance(sizes, int):
        return pool.withColumn("batch", F.floor(at / sizes).cast("long"))
    bounds = list(accumulate(sizes))[:-1]
    passed = reduce(lambda a, b: a + b, [(at >= b).cast("long") for b in bounds], F.lit(0).cast("long"))
    return pool.withColumn("batch", passed)


def distribute(rows: DataFrame, many: str, one: str) -> DataFrame:
    """``(x, [y...])`` to ``(x, y)``."""
    return rows.withColumn(one, F.explode(many)).drop(many)


def merge_scores(scores: DataFrame, order: str = "iter") -> DataFrame:
    """One row per id: the latest score, NULL included."""
    latest = F.max_by(F.struct("score"), order)
    return scores.groupBy("id").agg(latest.alias("_s")).select("id", F.col("_s.score").alias("score"))


def append_variants(pool: DataFrame, variants: Column) -> DataFrame:
    """The pool followed by the variants of its identifiers (an array Column), without repeats."""
    return pool.select("id").union(pool.select(F.explode(variants).alias("id"))).distinct()


def generated_variants(pool: DataFrame, generate: Callable[[str], Iterable[str]], id_col: str = "id") -> DataFrame:
    """``(id, variant)`` for every variant that ``generate`` yields for an identifier; an identifier may have none, and a NULL one is not asked.

    The generator is a table function in a lateral join: its rows stream out as it yields them, so the variants of one identifier never are one array.
    """

    class Variants:
        def eval(self, name: str) -> Iterator[tuple[str]]:
            if name is not None:
                for variant in generate(name):
                    yield (variant,)

    variants = F.udtf(Variants, returnType="variant string")
    return pool.select(F.col(id_col).alias("id")).lateralJoin(variants(F.col("id").outer())).select("id", "variant")


def append_generated(pool: DataFrame, generate: Callable[[str], Iterable[str]]) -> DataFrame:
    """The pool followed by the generated variants of its identifiers, without repeats."""
    return pool.select("id").union(generated_variants(pool, generate).select(F.col("variant").alias("id"))).distinct()


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` minus rows of ``right``, counting repeats.

    Counts per distinct row stay counts; nothing is unrolled inside one task for a heavy value.
    """
    names = left.columns
    marked = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    return marked.groupBy(*names).agg(F.sum("_n").alias("n")).filter(F.col("n") > 0)
