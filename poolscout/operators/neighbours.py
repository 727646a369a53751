"""Exact neighbours among fingerprints: all pairs of distinct bit sets within a Tanimoto distance.

Two sets of similarity ``s`` share ``s`` of either one's bits, so with bits in one order (rarest first) the first bit that they share stands
in the prefix of ``n - ceil(s n) + 1`` bits of both, and the second one a place further at most. Sets meet under the first bit of their prefix that they
share. A bit that is in too many prefixes is split by the second shared bit, and whatever is still too large by blocks. Each pair is compared under every key that
both have, but reported only under the one of its own first bits, so there is nothing to de-duplicate. Copies are one set with a weight.

Sets of many bits out of few meet under so many bits that this compares a pair more than once and sends a set thousands of times. Where the bits of the prefixes say
so, all sets are compared once instead, packed as bitmaps into blocks of like size; blocks whose sizes rule out the similarity never meet. Two sets are compared by a few
words first: of bits that share a place of these words the parity is kept, and as many parities differ as bits do at most. What that does not rule out is counted in whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import broadcast_if_small, cut

#: Sets under one key that a task compares with one another; fewer where fingerprints are long, as a block is a matrix.
BLOCK = 2048
BLOCK_CELLS = 1 << 22
#: Prefixes that may hold a bit before it is split by a second one.
HOT = 1000
#: Blocks that all sets are packed into, whatever the number of partitions, if each then holds about no fewer and no more sets than this.
PACKS, LEAST_PACKED, MOST_PACKED = 32, 1024, 65536
#: Sets in a block of those that are so long that any two are likely near.
MOST_NEAR = 4096
#: Sets that are made bitmaps at once.
PART = 1024
#: Sets of a packed block that are compared with as many of another by the same number of words, words that these may be, and sets in a step of that.
TILE, TILE_WORDS, STEP = 8192, 1 << 20, 8
#: Near pairs that are gathered before they are given out.
MOST_FOUND = 1 << 17
#: What it takes to count the bits of a pair, by that of a word of its parities.
WHOLE = 200
#: Longest fingerprint that is sent as a bitmap in a block.
PACKED_LENGTH = 1 << 16
#: Guards the ceiling of a product of a fraction against rounding; too long a prefix is harmless.
SLACK = 1e-9


def distinct_sets(items: DataFrame) -> DataFrame:
    """``(id, bits, members)``: one row per distinct bit set, under the least id that has it. Items without bits are left out."""
    # a filter on the bits would move below what computes them, and have them computed twice
    sets = items.groupBy("bits").agg(F.min("id").alias("id"), F.count("bits").alias("members"))
    return sets.where("members > 0").select("id", "bits", "members")


def set_members(items: DataFrame) -> DataFrame:
    """``(id, set_id)``: the row of ``distinct_sets`` that stands for each item."""
    rows = items.where("bits IS NOT NULL").select("id", "bits")
    # a set's rows meet one row of the other side, so Spark may split a group of copies
    return rows.join(rows.groupBy("bits").agg(F.min("id").alias("set_id")), "bits").select("id", "set_id")


def _ranks(sets: DataFrame, length: int) -> np.ndarray:
    """The place of every bit in the order by how many sets have it; at most ``length`` counts reach the driver."""
    counts = np.zeros(length, dtype=np.int64)
    for r in sets.select(F.explode("bits").alias("bit")).groupBy("bit").count().collect():
        counts[r["bit"]] = r["count"]
    ranks = np.empty(length, dtype=np.int64)
    ranks[np.lexsort((np.arange(length), counts))] = np.arange(length)
    return ranks


def _prefix(n: int, floor: float) -> int:
    return n - int(np.ceil(floor * n - SLACK)) + 1


def _keys(ranks: list[int], floor: float, hot: np.ndarray) -> Iterator[tuple[int, int]]:
    """The keys of a set whose bits are ``ranks`` in rising order; the second place is -1 where a bit is not split."""
    n = len(ranks)
    stop = _prefix(n, floor) if n else 0
    for i in range(stop):
        if not hot[ranks[i]]:
            yield ranks[i], -1
            continue
        for j in range(i + 1, min(stop + 1, n)):
            yield ranks[i], ranks[j]
        if n * floor <= 1 + SLACK:  # so small that one shared bit may do
            yield ranks[i], -1


def _similar(left: np.ndarray, right: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shared = (left @ right.T).astype(np.float64)  # counts are exact in single precision
    union = left.sum(1, dtype=np.float64)[:, None] + right.sum(1, dtype=np.float64)[None, :] - shared
    value = shared / np.maximum(union, 1.0)
    row, col = np.nonzero(value >= floor)
    return row, col, value[row, col]


def _as_bytes(ranks: np.ndarray, sizes: np.ndarray, length: int, dense: bool) -> pa.Array:
    """Sets as bitmaps, or as numbers of four bytes, which is shorter where few bits are set."""
    if dense:
        has = np.zeros((len(sizes), length), dtype=np.uint8)
        has[np.repeat(np.arange(len(sizes)), sizes), ranks] = 1
        return pa.array([row.tobytes() for row in np.packbits(has, axis=1)], pa.binary())
    ends = np.cumsum(sizes)
    return pa.array([ranks[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())


def _as_matrix(sets: pa.Array, length: int, dense: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sets as rows of zeros and ones, and the rank of each column, in rising order."""
    data = sets.to_pylist()
    if dense:
        packed = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), -1)
        return np.unpackbits(packed, axis=1, count=length).astype(np.float32), np.arange(length)
    sizes = [len(x) // 4 for x in data]
    ranks, place = np.unique(np.frombuffer(b"".join(data), dtype="<u4").astype(np.int64), return_inverse=True)
    has = np.zeros((len(data), len(ranks)), dtype=np.float32)
    has[np.repeat(np.arange(len(data)), sizes), place] = 1.0
    return has, ranks


def _compare(floor: float, hot: np.ndarray, length: int, dense: bool):
    def compare(key, rows):
        first, second, low, high = (k.as_py() for k in key)
        if rows.num_rows < 2:
            return pa.table([pa.array([], t) for t in (rows.schema.field("id").type,) * 2 + (pa.float64(),)], names=["a", "b", "similarity"])
        has, bits = _as_matrix(rows.column("ranks"), length, dense)
        block, ids = rows.column("block").to_numpy(), rows.column("id").combine_chunks()
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        row, col, value = _similar(has[a], has[b], floor)
        row, col = a[row], b[col]
        if low == high:
            once = row < col
            row, col, value = row[once], col[once], value[once]
        mine = np.zeros(len(row), dtype=bool)
        for at in range(0, len(row), 4096):  # the bits that a pair shares, rarest first
            both = (has[row[at : at + 4096]] * has[col[at : at + 4096]]) > 0
            lead = both.argmax(axis=1)
            own = bits[lead] == first
            if hot[first]:
                both[np.arange(len(lead)), lead] = False
                follow = np.where(both.any(axis=1), bits[both.argmax(axis=1)], -1)
                own &= follow == second
            mine[at : at + 4096] = own
        x, y = ids.take(pa.array(row[mine])), ids.take(pa.array(col[mine]))
        return pa.table(_in_order(x, y, value[mine]), names=["a", "b", "similarity"])

    return compare


def _in_order(a: pa.Array, b: pa.Array, value: np.ndarray) -> list[pa.Array]:
    swap = pc.greater(a, b)
    return [pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(value)]


def _pack(length: int):
    """Packs the sets of a block into one row."""

    def pack(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, ids, weights, least, most = [], [], [], length, 0
        for batch in batches:
            ids.append(batch.column("id"))
            weights.append(batch.column("weight"))
            for at in range(0, batch.num_rows, PART):
                ranks = batch.column("ranks").slice(at, PART)
                sizes = pc.list_value_length(ranks).to_numpy()
                maps += _as_bytes(ranks.flatten().to_numpy(), sizes, length, True).to_pylist()
                least, most = min(least, int(sizes.min())), max(most, int(sizes.max()))
        lists = [pa.ListArray.from_arrays([0, len(maps)], pa.concat_arrays(c)) for c in (ids, weights)]
        columns = [pa.array([key[0].as_py()]), pa.array([least], pa.int32()), pa.array([most], pa.int32()), *lists, pa.array([b"".join(maps)], pa.binary())]
        yield pa.record_batch(columns, names=["block", "least", "most", "ids", "weights", "sets"])

    return pack


def _two_blocks(batches: Iterator[pa.RecordBatch]) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, weights and bitmaps of the two blocks of a task, or of the only one."""
    packs = {}
    for batch in batches:
        for block, ids, weights, sets in zip(*(batch.column(c) for c in ("block", "ids", "weights", "sets"))):
            packs[block.as_py()] = ids.values, weights.values.to_numpy(), np.frombuffer(sets.as_buffer(), dtype=np.uint8).reshape(len(ids), -1)
    return [packs[k] for k in sorted(packs)]


def _folded(words: np.ndarray, n: int) -> np.ndarray:
    """``n`` words of each set, of the parities of the bits that fall into the same place."""
    out = words[:, :n].copy()
    for at in range(n, words.shape[1], n):
        part = words[:, at : at + n]
        out[:, : part.shape[1]] ^= part
    return out


def _apart(x: np.ndarray, y: np.ndarray, space: np.ndarray, exact: bool) -> np.ndarray:
    """In how many bits each of ``x`` differs from each of ``y``, both given word by word; unless ``exact``, 256 may be given as 0."""
    shape = x.shape[1], y.shape[1]
    differ = space[: shape[0] * shape[1]].reshape(shape)
    out = np.zeros(shape, dtype=np.uint16 if exact or len(x) > 4 else np.uint8)
    for a, b in zip(x, y):
        out += np.bitwise_count(np.bitwise_xor(a[:, None], b, out=differ))
    return out


def _words_to_compare(x: np.ndarray, y: np.ndarray, same: bool, most: np.ndarray) -> int:
    """The number of words that takes least, going by some sets of two tiles; ``most`` bits of two may differ."""
    space, whole = np.empty(most.size, dtype=np.uint64), x.shape[1]
    best, least = whole, whole
    for n in sorted({k * 2**i // 4 for k in (4, 5, 6, 7) for i in range(whole.bit_length())}):
        if n >= least:
            break
        held = (_apart(_folded(x, n).T, _folded(y, n).T, space, False) <= most).sum() - same * len(x)
        takes = n + WHOLE * held / most.size
        if takes < least:
            best, least = n, takes
    return best


def _near_in_parts(left: np.ndarray, right: np.ndarray, same: bool, floor: float, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and similarity of the near pairs of two blocks, a bounded number at a time; of one block with itself once."""

    def by_size(maps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.bitwise_count(maps).sum(1, dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        words = np.zeros((len(maps), -(-length // 64) * 8), dtype=np.uint8)
        words[:, : maps.shape[1]] = maps[order]
        return order, sizes[order], words.view(np.uint64)

    x_order, n, x = by_size(left)
    y_order, m, y = (x_order, n, x) if same else by_size(right)
    whole = x.shape[1]
    tile, some = max(64, min(TILE, TILE_WORDS // whole)), max(1, TILE_WORDS // whole)
    may_differ = (1.0 - floor) / (1.0 + floor)  # of the sizes of two near sets
    space = np.empty(STEP * tile, dtype=np.uint64)

    def shared(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        both = [np.bitwise_count(x[row[at : at + some]] & y[col[at : at + some]]).sum(1, dtype=np.int64) for at in range(0, len(row), some)]
        return np.concatenate(both)

    def of_tiles(i: int, end: int, j: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        some_x, some_y = (np.unique(np.linspace(a, b - 1, 48).astype(np.int64)) for a, b in ((i, end), (j, stop)))
        few = _words_to_compare(x[some_x], y[some_y], same and (i, end) == (j, stop), may_differ * (n[some_x][:, None] + m[some_y]) + SLACK)
        left_words, right_words = (np.ascontiguousarray(_folded(z, few).T) for z in (x[i:end], y[j:stop]))
        step, may, held = max(1, min(8 * STEP, len(space) // (stop - j))), [], 0
        for at in range(i, end, step):
            to = min(at + step, end)
            after = max(at + 1 - j, 0) if same else 0  # the first of a step meets sets after it only
            differ = _apart(left_words[:, at - i : to - i], right_words[:, after:], space, few == whole)
            most = np.floor(may_differ * (n[to - 1] + m[j + after : stop]) + SLACK)
            pairs = np.flatnonzero(differ <= np.minimum(most, np.iinfo(differ.dtype).max).astype(differ.dtype))
            if len(pairs):
                row, col = np.divmod(pairs, differ.shape[1])
                may.append((row + at, col + j + after, differ.ravel()[pairs]))
                held += len(pairs)
            if may and (held >= MOST_FOUND or to == end):
                row, col, differ = (np.concatenate(z) for z in zip(*may))
                both = (n[row] + m[col] - differ) / 2 if few == whole else shared(row, col).astype(np.float64)
                value = both / np.maximum(n[row] + m[col] - both, 1.0)
                near = value >= floor
                if same:
                    near &= row < col
                if near.any():
                    yield x_order[row[near]], y_order[col[near]], value[near]
                may, held = [], 0

    found, held = [], 0
    for i in range(0, len(x), tile):
        end = min(i + tile, len(x))
        first = max(i if same else 0, int(np.searchsorted(m, floor * n[i] - SLACK)))
        last = int(np.searchsorted(m, n[end - 1] / floor + SLACK, "right"))
        for j in range(first, last, tile):
            for near in of_tiles(i, end, j, min(j + tile, last)):
                found.append(near)
                held += len(near[0])
                if held >= MOST_FOUND:
                    yield tuple(np.concatenate(z) for z in zip(*found))
                    found, held = [], 0
    if held:
        yield tuple(np.concatenate(z) for z in zip(*found))


def _compare_packed(floor: float, length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _two_blocks(batches)
        (left_ids, _, left), (right_ids, _, right) = blocks[0], blocks[-1]
        for row, col, value in _near_in_parts(left, right, len(blocks) == 1, floor, length):
            yield pa.record_batch(_in_order(left_ids.take(pa.array(row)), right_ids.take(pa.array(col)), value), names=["a", "b", "similarity"])

    return compare


def _joining(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the links ``x``, ``y`` that join what the others do not, fewer than there are nodes; ``group``, by node, names what has been joined.

    In each round a group takes one link to a group that a fresh order puts before it, so links make no ring, and at least half of the groups are expected to.
    """
    order = np.random.default_rng(0)
    while True:
        a, b = group[x], group[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        place = order.permutation(len(group))
        later = place[a] > place[b]
        moved, at = np.unique(np.where(later, a, b), return_index=True)
        yield x[at], y[at]
        to = np.arange(len(group))
        to[moved] = np.where(later, b, a)[at]
        while (to[to] != to).any():
            to = to[to]
        group[:] = to[group]


def _link_packed(floor: float, length: int, least: int):
    """What two blocks add to ``near_links``: a row ``(a, b)`` per link, and one with ``near`` per set that has neighbours."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _two_blocks(batches)
        same = len(blocks) == 1
        ids, weights = pa.concat_arrays([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        near, group, names = np.zeros(len(ids)), np.arange(len(ids)), ["a", "b", "near"]  # sums below 2**53 are exact
        for row, col, _ in _near_in_parts(blocks[0][2], blocks[-1][2], same, floor, length):
            col = col if same else col + len(blocks[0][0])
            for one, other in ((row, col), (col, row)):
                near += np.bincount(one, weights[other], len(ids))
            core = near + 1 >= least
            sure = core[row] & core[col]
            for x, y in ((row[~sure], col[~sure]), *_joining(row[sure], col[sure], group)):
                if len(x):
                    yield pa.record_batch([*_in_order(ids.take(pa.array(x)), ids.take(pa.array(y)), np.zeros(len(x)))[:2], pa.nulls(len(x), pa.int64())], names=names)
        has = np.flatnonzero(near)
        yield pa.record_batch([ids.take(pa.array(has)), pa.nulls(len(has), ids.type), pa.array(near[has].astype(np.int64))], names=names)

    return link


def _all_pairs(rows: DataFrame, length: int, floor: float, n: int, kind: str, per: int | None, of: Callable, schema: str) -> DataFrame:
    """What ``of`` makes of every two blocks of ``rows(id, ranks, weight)`` that may hold neighbours. A set is sent once for each such block, and a task holds two blocks."""
    per = per or min(MOST_PACKED, max(LEAST_PACKED, -(-n // PACKS)))
    rows = rows.withColumn("size", F.size("ranks")).where("size > 0")
    # sets of so many bits are likely near whatever they hold, and a task gives out what two blocks have of such pairs
    room = F.when(F.col("size") * (1 + floor) >= 1.6 * floor * length, max(1, per // MOST_NEAR)).otherwise(1)
    counts = rows.groupBy("size").count().withColumn("room", room)  # a row per number of bits
    counts = counts.withColumn("before", F.sum(F.col("count") * F.col("room")).over(W.orderBy("size")) - F.col("count") * F.col("room"))
    place = F.col("before") + F.pmod(F.xxhash64("ranks"), F.col("count")) * F.col("room")
    dealt = rows.join(F.broadcast(counts), "size").select(F.floor(place / per).alias("block"), "id", "ranks", "weight")
    packed = cut(dealt.groupBy("block").applyInArrow(_pack(length), f"block long, least int, most int, ids array<{kind}>, weights array<long>, sets binary"))
    sizes = packed.select("block", "least", "most")
    other = sizes.toDF("high", "high_least", "high_most")
    may = (F.col("block") <= F.col("high")) & (F.col("most") >= F.col("high_least") * floor - SLACK) & (F.col("high_most") >= F.col("least") * floor - SLACK)
    meet = cut(sizes.join(F.broadcast(other), may).select(F.col("block").alias("low"), "high"))  # sizes of blocks, not blocks
    sent = meet.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
    posts = packed.join(broadcast_if_small(sent, 2 * meet.count()), "block").select("low", "high", "block", "ids", "weights", "sets")
    return posts.groupBy("low", "high").applyInArrow(of, schema)


@dataclass(frozen=True)
class _Ranked:
    """Sets ``rows(id, ranks, weight)`` whose bits are their places in the order by rarity."""

    rows: DataFrame
    #: Prefixes that hold a bit.
    held: dict[int, int]
    n: int
    dense: bool
    length: int
    floor: float
    kind: str

    @property
    def meet_often(self) -> bool:
        """Whether the prefixes would compare more pairs than there are."""
        return self.length <= PACKED_LENGTH and sum(c * c for c in self.held.values()) > self.n**2


def _ranked(sets: DataFrame, length: int, max_distance: float) -> _Ranked:
    """``sets(id, bits, weight)`` with their bits in order."""
    floor = 1.0 - max_distance
    if floor <= 0:
        raise ValueError("the distance must be below 1")
    kind = sets.schema["id"].dataType.simpleString()
    sets = cut(sets)
    order = _ranks(sets, length)
    size = sets.agg(F.avg(F.size("bits")).alias("bits"), F.count(F.lit(1)).alias("n")).first()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = [np.sort(order[np.asarray(b.values, dtype=np.int64)]).astype(np.int32) for b in batch.column("bits")]
            yield pa.record_batch([batch.column("id"), pa.array(ranks, pa.list_(pa.int32())), batch.column("weight")], names=["id", "ranks", "weight"])

    rows = cut(sets.mapInArrow(ranked, f"id {kind}, ranks array<int>, weight long"))
    n = F.size("ranks")
    head = F.slice("ranks", 1, F.when(n > 0, n - F.ceil(n * F.lit(floor) - F.lit(SLACK)).cast("int") + 1).otherwise(0))
    held = {r["bit"]: r["count"] for r in rows.select(F.explode(head).alias("bit")).groupBy("bit").count().collect()}
    return _Ranked(rows, held, size["n"], 4 * (size["bits"] or 0.0) >= length / 8, length, floor, kind)


def neighbour_pairs(
    sets: DataFrame, length: int, max_distance: float, hot_sets: int = HOT, block: int | None = None, method: str | None = None
) -> DataFrame:
    """All pairs ``(a, b, similarity)``, ``a < b``, of rows of ``sets(id, bits)`` with a Tanimoto distance of at most ``max_distance`` (below 1). Bits are distinct
    positions below ``length``; ``sets`` are distinct, as from ``distinct_sets``, and empty ones have no neighbours.

    method ``prefix``: what a set sends grows with its own bits, a task holds two blocks, and the driver sees two counts per bit. A key with many blocks copies its sets
    once per block, which the split by second bits leaves to bits that nearly always come together.
    method ``all``: every two sets of like size are compared once, and a task holds two blocks. Without a method it is taken where the prefixes would compare more pairs than that.
    """
    if method not in (None, "prefix", "all"):
        raise ValueError(f"unknown method {method!r}")
    ranked = _ranked(sets.select("id", "bits", F.lit(1).cast("long").alias("weight")), length, max_distance)
    if method == "all" or method is None and ranked.meet_often:
        compare = _compare_packed(ranked.floor, length)
        return _all_pairs(ranked.rows, length, ranked.floor, ranked.n, ranked.kind, block, compare, f"a {ranked.kind}, b {ranked.kind}, similarity double")
    return _pairs_by_prefix(ranked, hot_sets, block)


def near_links(sets: DataFrame, length: int, max_distance: float, least: int) -> tuple[DataFrame, DataFrame]:
    """``near(id, near)``, the added up weights of the neighbours of each row of ``sets(id, bits, weight)``, and ``links(a, b)``: all pairs of neighbours but for those of
    two sets with ``least`` neighbours (themselves and weights included), of which it has enough to keep what they join joined.

    Long sets: two blocks give out no pair of which both have been seen to have that many, unless it joins what earlier ones did not, so a set is in a bounded number of
    rows of each task, however many neighbours it has.
    """
    ranked = _ranked(sets.select("id", "bits", "weight"), length, max_distance)
    if ranked.meet_often:
        link = _link_packed(ranked.floor, length, least)
        found = cut(_all_pairs(ranked.rows, length, ranked.floor, ranked.n, ranked.kind, None, link, f"a {ranked.kind}, b {ranked.kind}, near long"))
        near = found.where("near IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("near").alias("near"))
        return found.where("near IS NULL").select("a", "b"), near
    pairs = cut(_pairs_by_prefix(ranked).select("a", "b"))
    both = pairs.union(pairs.select("b", "a"))
    weight = sets.select(F.col("id").alias("b"), "weight").distinct()
    return pairs, both.join(weight, "b").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("near"))


def _pairs_by_prefix(ranked: _Ranked, hot_sets: int = HOT, block: int | None = None) -> DataFrame:
    rows, length, floor, dense, kind = ranked.rows, ranked.length, ranked.floor, ranked.dense, ranked.kind
    hot = np.zeros(length, dtype=bool)
    hot[[bit for bit, c in ranked.held.items() if c > hot_sets]] = True
    block = block or max(64, min(BLOCK, BLOCK_CELLS // length))

    def posted(whole: bool):
        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    ranks = part.column("ranks")
                    sizes = pc.list_value_length(ranks).to_numpy()
                    flat, ends = ranks.flatten().to_numpy(), np.cumsum(sizes)
                    keys = [(i, x, y) for i, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist())) for x, y in _keys(flat[e - n : e].tolist(), floor, hot)]
                    i, x, y = np.array(keys, dtype=np.int64).reshape(-1, 3).T
                    columns = [pa.array(np.ascontiguousarray(c)) for c in (x, y)]
                    if whole:
                        at_row = pa.array(np.ascontiguousarray(i))
                        columns += [part.column("id").take(at_row), _as_bytes(flat, sizes, length, dense).take(at_row)]
                    yield pa.record_batch(columns, names=["first", "second", "id", "ranks"][: len(columns)])

        return post

    keys = rows.mapInArrow(posted(False), "first long, second long")
    sizes = keys.groupBy("first", "second").count().where("count > 1")
    blocks = F.ceil(F.col("count") / block).cast("long").alias("blocks")
    large = cut(sizes.where(F.col("count") > block).select("first", "second", blocks))
    posts = rows.mapInArrow(posted(True), f"first long, second long, id {kind}, ranks binary")
    # a key of one set makes a group of one row, which costs less than a join to tell
    posts = posts.join(broadcast_if_small(large, large.count()), ["first", "second"], "left")
    own = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    posts = posts.withColumn("block", own.cast("long"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    posts = posts.select("first", "second", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "ranks")
    return posts.groupBy("first", "second", "low", "high").applyInArrow(_compare(floor, hot, length, dense), f"a {kind}, b {kind}, similarity double")


def greedy_independent(nodes: DataFrame, pairs: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Nodes that a pass in id order would take, taking each node that has no neighbour among the earlier ones taken: ``(id)``.

    All nodes decide at once, in rounds: a node without an undecided smaller neighbour is taken, and its neighbours are out. In a random order of ids the number of
    rounds grows with the logarithm of the nodes; edges of decided nodes leave, so each round is smaller than the one before.
    """
    edges = cut(pairs.select("a", "b"))
    left = cut(nodes.select("id"))
    taken = None
    for _ in range(most_rounds):
        n = edges.count()
        waiting = edges.select(F.col("b").alias("id")).distinct()
        new = cut(left.join(waiting, "id", "left_anti")) if n else left
        taken = new if taken is None else taken.unionByName(new)
        if not n:
            return cut(taken)
        gone = cut(edges.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        decided = new.unionByName(gone)
        left = cut(left.join(decided, "id", "left_anti"))
        edges = edges.join(decided.select(F.col("id").alias("a")), "a", "left_anti")
        edges = cut(edges.join(decided.select(F.col("id").alias("b")), "b", "left_anti"))
    raise RuntimeError("the nodes did not settle")
