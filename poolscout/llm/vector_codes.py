"""Product quantisation of vectors in integers, with adaptive bounds that spare most distance computations.

A vector is cut into equal parts, and each part position has a codebook that Lloyd rounds improve. Between rounds every part keeps its
entry, the ``b`` next closest entries with ordered lower bounds of their distances, and one outer bound for all entries beyond. When entries
move, the bounds shrink by their movements; each bound also holds for what stands behind it. A part whose exact distance lies below its first bound keeps its
entry. Otherwise only the entries whose bound it reaches are looked at, in integers, and all of them only if it reaches the outer bound. ``b`` is
lowered to what would have cost least in the round before.

A round is one pass over a written table with the rows' integers and bounds. Tasks add up what goes to each entry, Spark adds the tasks' sums, and the driver
holds nothing but the codebooks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import discard, free_shuffles, saved

#: Components at or beyond this are an error: squared distances of parts must fit 63 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Options:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    #: Entries with bounds of their own: at first, and at least.
    bounds: int = 4
    least_bounds: int = 1
    #: What it costs to keep a bound of a part for a round, in distances.
    kept_cost: float = 0.25


def _matrix(column, kind) -> np.ndarray:
    """A column of equally long binaries as rows of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)
    return data.view(kind).reshape(n, -1) if n else np.empty((0, 0), kind)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.shape[1] * rows.itemsize if len(rows) else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.py_buffer(rows.tobytes())])


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of all components, rows filled with zeros up to ``width``."""
    sizes = np.asarray(pc.list_value_length(column), dtype=np.int64)
    flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST / scale:g} or more")
    out = np.zeros((len(column), width), dtype=np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``rows`` (n, d) to the entries ``book`` (k, d)."""
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * max(1, rows.shape[1]) < 1 << 52:  # every term is a whole number that a double holds
        x, c = rows.astype(np.float64), book.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(rows), len(book)), dtype=np.int64)
    for k, entry in enumerate(book.astype(np.int64)):
        out[:, k] = ((rows - entry) ** 2).sum(1)
    return out


def _to_own(rows: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((rows.astype(np.int64) - book[code]) ** 2).sum(1)


def _down(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not above ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def ranked(squares: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry, the ``b`` next ones, and ``b + 1`` ordered lower bounds, the last for all entries beyond."""
    order = np.argsort(squares, axis=1, kind="stable")  # of equal distances the lower index is first
    near = order[:, 1 : b + 1]
    further = np.sqrt(np.take_along_axis(squares, order[:, 1 : b + 2], 1).astype(np.float64))
    if further.shape[1] < b + 1:
        further = np.concatenate((further, np.full((len(squares), b + 1 - further.shape[1]), np.inf)), axis=1)
    return order[:, 0].astype(np.uint8), near.astype(np.uint8), _down(further)


def moved_bounds(code: np.ndarray, near: np.ndarray, low: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """The bounds after the entries moved by at most ``moved``: ordered, each holds for its entry and all behind it. The outer bound shrinks by the
    largest movement among the entries beyond."""
    rest, open_rows = np.zeros(len(near)), np.ones(len(near), dtype=bool)
    for entry in np.argsort(-moved, kind="stable")[: near.shape[1] + 2]:
        beyond = open_rows & (code != entry) & (near != entry).all(axis=1)
        rest[beyond] = moved[entry]
        open_rows &= ~beyond
    shift = np.concatenate((moved[near], rest[:, None]), axis=1)
    return _down(np.minimum.accumulate((low.astype(np.float64) - shift)[:, ::-1], axis=1)[:, ::-1])


def reassign(rows: np.ndarray, book: np.ndarray, code: np.ndarray, near: np.ndarray, low: np.ndarray, needed: np.ndarray):
    """Nearest entries, from bounds that hold for ``book``. ``needed[m]`` counts the parts that reached ``m`` bounds; the last place is for those
    that reached the outer one and were compared with all entries. Returns code, near and low."""
    b = near.shape[1]
    own = _to_own(rows, book, code)
    reach = np.nextafter(np.sqrt(own.astype(np.float64)), np.inf)
    reached = (low <= reach[:, None]).sum(1)  # bounds are ordered
    needed += np.bincount(reached, minlength=b + 2)
    code, near, low = code.copy(), near.copy(), low.copy()
    if (everything := reached == b + 1).any():
        code[everything], near[everything], low[everything] = ranked(distances(rows[everything], book), b)
    for m in range(1, b + 1):
        at = np.flatnonzero(reached == m)
        if not len(at):
            continue
        names = np.concatenate((code[at, None], near[at, :m]), axis=1).astype(np.int64)
        squares = np.stack([own[at], *(_to_own(rows[at], book, names[:, j]) for j in range(1, m + 1))], axis=1)
        order = np.lexsort((names, squares), axis=1)
        names, squares = np.take_along_axis(names, order, 1), np.take_along_axis(squares, order, 1)
        code[at], near[at, :m] = names[:, 0], names[:, 1:]
        # a looked-at entry may now lie beyond the next bound, which holds for all behind it
        low[at, :m] = np.minimum(_down(np.sqrt(squares[:, 1:].astype(np.float64))), low[at, m][:, None])
    return code, near, low


def next_bounds(needed: np.ndarray, entries: int, options: Options) -> int:
    """The number of bounds that would have cost least: the distances to the entries looked at, all of them for a part that reached beyond the bounds,
    and the bounds kept."""
    b = len(needed) - 2
    looked = np.cumsum(np.arange(b + 2) * needed)
    costs = {n: looked[n] + entries * needed[n + 1 :].sum() + options.kept_cost * n * needed.sum() for n in range(min(options.least_bounds, b), b + 1)}
    return min(costs, key=costs.get)


@dataclass(frozen=True)
class Model:
    """``codes`` has ``(vec_id, label, code, error)``, with the entries' indexes as bytes; ``books`` is (parts, entries, components) or empty. ``work`` has per pass the number
    of bounds and how many parts reached how many of them."""

    codes: DataFrame
    books: np.ndarray
    work: list[tuple[int, np.ndarray]]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _kept(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of the rows whose vector is there and whose components are finite numbers."""
    v = F.col("v")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].cast("array<double>").alias("v"))
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return rows.where(v.isNotNull() & whole)


def fit(vectors: DataFrame, options: Options = Options()) -> Model:
    """Codebooks and codes of ``(vec_id, embedding, label)``.

    Rows whose vector is null or holds a null or a component that is not finite are dropped. Vectors that are shorter than the longest, or than the next multiple
    of the parts, count as filled up with zeros. The first codebooks are the parts of the vectors of the smallest ids, by their components where
    ids repeat, rows without an id last; with fewer rows they are shorter. Each row counts, also where ids or vectors repeat. Components of
    ``2 ** 27`` and more after scaling are an error.
    """
    spark, parts = vectors.sparkSession, options.parts
    rows = _kept(vectors)
    longest = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if longest is None:
        empty = spark.createDataFrame([], rows.select("vec_id", "label").schema).selectExpr("vec_id", "label", "CAST(NULL AS BINARY) AS code", "0L AS error")
        return Model(empty, np.empty((parts, 0, 0), np.int64), [])
    width = max(1, -(-longest // parts)) * parts
    each = width // parts
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(options.entries).select("v").collect()
    books = np.stack([integers(pa.array([r["v"]], pa.list_(pa.float64())), width, options.scale)[0] for r in seeds]).astype(np.int64)
    books = books.reshape(len(seeds), parts, each).transpose(1, 0, 2).copy()
    k = len(seeds)

    kind = rows.schema["label"].dataType.simpleString()
    state = f"vec_id long, label {kind}, x binary, code binary, near binary, low binary, error long, sums array<long>, needed array<long>"

    def one_pass(source: DataFrame, books: np.ndarray, b: int, before: int | None, moved: np.ndarray | None) -> DataFrame:
        """All rows with codes for ``books``, and a row for each task with what it adds up. ``before`` is the number of bounds in ``source``."""

        def run(batches):
            sums = np.zeros((parts, k, each), dtype=np.int64)
            counts = np.zeros((parts, k), dtype=np.int64)
            needed = np.zeros((before if before is not None else b) + 2, dtype=np.int64)
            names = None
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = integers(batch.column(2), width, options.scale) if moved is None else _matrix(batch.column(2), np.int32)
                code = np.empty((n, parts), np.uint8)
                near = np.empty((n, parts, b), np.uint8)
                low = np.empty((n, parts, b + 1), np.float32)
                error = np.zeros(n, dtype=np.int64)
                if moved is not None:
                    old_code = _matrix(batch.column(3), np.uint8)
                    old_near = _matrix(batch.column(4), np.uint8).reshape(n, parts, before)
                    old_low = _matrix(batch.column(5), np.float32).reshape(n, parts, before + 1)
                for p in range(parts):
                    own, book = x[:, p * each : (p + 1) * each], books[p]
                    if moved is None:
                        code[:, p], near[:, p], low[:, p] = ranked(distances(own, book), b)
                    else:
                        bounds = moved_bounds(old_code[:, p], old_near[:, p], old_low[:, p], moved[p])
                        code[:, p], now_near, now_low = reassign(own, book, old_code[:, p], old_near[:, p], bounds, needed)
                        near[:, p], low[:, p] = now_near[:, :b], now_low[:, : b + 1]
                    error += _to_own(own, book, code[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=k)
                    for i in range(each):  # whole numbers below 2 ** 53 in a batch
                        sums[p, :, i] += np.bincount(code[:, p], weights=own[:, i], minlength=k).astype(np.int64)
                nothing = [pa.nulls(n, pa.list_(pa.int64()))] * 2
                columns = [batch.column(0), batch.column(1), _binary(x), _binary(code), _binary(near.reshape(n, -1)), _binary(low.reshape(n, -1)), pa.array(error), *nothing]
                names = [f.name for f in fields]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, fields)], names=names)
            if names:
                added = np.concatenate((counts[:, :, None], sums), axis=2).ravel()
                last = [pa.nulls(1, f.type) for f in fields[:7]] + [pa.array([a.tolist()], pa.list_(pa.int64())) for a in (added, needed)]
                yield pa.record_batch(last, names=names)

        from pyspark.sql.pandas.types import to_arrow_schema

        fields = list(to_arrow_schema(spark.createDataFrame([], state).schema))
        return source.mapInArrow(run, state)

    # as many bounds as there are other entries at most; with one entry none
    b = min(max(options.least_bounds, options.bounds), 255, k - 1)
    table, path, moved, before, work = rows, None, None, None, []
    for turn in range(options.rounds + 1):
        fresh, fresh_path = saved(one_pass(table, books, b, before, moved), "vector-codes")
        if path:
            discard(spark, path)
        table, path = fresh.where("sums IS NULL").select("vec_id", "label", "x", "code", "near", "low", "error"), fresh_path
        added = {r["pos"]: int(r["s"]) for r in fresh.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()}
        needed = {r["pos"]: int(r["s"]) for r in fresh.select(F.posexplode("needed")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
        needed = np.array([needed[i] for i in range(len(needed))], dtype=np.int64)
        work.append((b if before is None else before, needed))
        if turn == options.rounds:
            break
        total = np.array([added[i] for i in range(len(added))], dtype=object).reshape(parts, k, each + 1)
        following = books.copy()
        for p, e in np.ndindex(parts, k):
            if total[p, e, 0]:
                following[p, e] = [s // total[p, e, 0] for s in total[p, e, 1:]]  # Python's division goes down
        if (following == books).all():
            break  # further rounds would give the same
        moved = np.nextafter(np.sqrt(((following - books).astype(np.float64) ** 2).sum(2)), np.inf)
        before, b = b, b if turn == 0 else min(b, next_bounds(needed, k, options))  # a bound that was dropped is not known any more
        books = following
    return Model(table.select("vec_id", "label", "code", "error"), books, work)


def compress(vectors: DataFrame, options: Options = Options()) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every kept row: two hex digits for each part, the summed squared distances of the row and of all rows
    with its label (rows without one together), and a digest of the codebooks. See ``fit`` for odd rows; without any kept row the result is empty."""
    model = fit(vectors, options)
    free_shuffles(vectors.sparkSession)
    totals, _ = saved(model.codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    rows = model.codes.join(broadcast_if_small(totals, totals.count()), F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
