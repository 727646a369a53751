"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact weighted similarity.

Windows are as many words as an item has. Weights are multiplicities: the similarity of a window and an item is the sum over their
five-word shingles of the smaller count, over that of the larger. A window that reaches the threshold with an item holds at least
that share of shingles that stand in items of its size; other windows are passed over. The fingerprints of the rest are looked up
in the multi-index, which gives every item of that size within the Hamming radius, and these pairs alone are verified.

At a similarity of exactly 0.75 a fingerprint's 128 bits differ in 22 on average; some 0.7 in 100 such pairs lie beyond the radius
of 32 and are not found, far fewer above that similarity. Windows of fewer words than a shingle are compared as one hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import map_slices, saved
from .near_dups import _lower
from .suffix_dedup import _stretches


@dataclass(frozen=True)
class Decontamination:
    """``radius`` of 128 bits, in ``blocks``. Items come to the tasks ``items`` at a time, and all texts are matched with each such
    group of items; after ``chain`` groups the rows are written, so that no task holds more of them at once."""

    shingle: int = 5
    percent: int = 75
    radius: int = 32
    blocks: int = 7
    items: int = 20_000
    chain: int = 4


#: Bits of a fingerprint, as two 64-bit words.
BITS = 128


def run_prints(hashes: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of each (non-empty) run of shingle hashes, two words a row; a shingle counts as often as it stands. Runs may overlap:
    the ones among a run's bits are a difference of two running sums."""
    out = np.zeros((len(start), BITS // 64), dtype=np.uint64)
    if not len(start):
        return out
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + count, -1)
    used = np.cumsum(change[:-1]) > 0
    low = (np.cumsum(used) - 1)[start]
    used = hashes[used]
    sums = np.zeros(len(used) + 1, dtype=np.int32)
    for word in range(out.shape[1]):
        bits = tk.mix(used, 91 + word)
        for bit in range(64):
            np.cumsum((bits >> np.uint64(bit)) & np.uint64(1), out=sums[1:])
            out[:, word] |= (2 * (sums[low + count] - sums[low]) > count).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return run_prints(hashes, bounds[:-1], np.diff(bounds))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def blocks_of(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """First bit and width of each block, and the radius in it, less than 0 for blocks that are not looked at.

    Where every block differs by more than its radius, the whole differs by the sum of ``radius of the block + 1`` at least, which
    is ``radius + 1``.
    """
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    base, extra = divmod(radius + 1 - blocks, blocks)
    return [(a, b - a, min(base + (k < extra), b - a)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]


def block_values(prints: np.ndarray, low: int, width: int) -> np.ndarray:
    word, shift = divmod(low, 64)
    value = prints[:, word] >> np.uint64(shift)
    if shift + width > 64:
        value |= prints[:, word + 1] << np.uint64(64 - shift)
    return value & np.uint64(2**width - 1)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle from each word on, and which of them lie inside one text. A text of fewer words has its whole sequence
    as one shingle, at its first word."""
    out = np.zeros(len(words), dtype=np.uint64)
    inside = np.zeros(len(words), dtype=bool)
    window = tk.window_hashes(words, size, 1)
    ok = tk.windows_inside(bounds, size, len(words))
    out[: len(window)][ok] = window[ok]
    inside[: len(window)] = ok
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = tk.running_sums(tk.mix(words, 9))
        out[bounds[short]] = tk.mix(tk.run_hashes(sums, bounds[short], bounds[short + 1]) ^ counts[short].astype(np.uint64), 10)
        inside[bounds[short]] = True
    return out, inside


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tk.text_bytes(column)
    starts, ends, first = tk.words_of(raw, offsets)
    return tk.word_hashes(_lower[raw], starts, ends), first


class Index:
    """The items of one block: shingle counts, which items hold a shingle, and the multi-index of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str], options: Decontamination):
        self.options = options
        words, bounds = _words(pa.array(texts, pa.string()))
        sizes = np.diff(bounds)
        self.ids = np.array(ids, dtype=np.int64)
        self.words = sizes
        hashes, inside = shingles(words, bounds, options.shingle)
        owner = np.repeat(np.arange(len(ids)), sizes)[inside]
        hashes = hashes[inside]
        self.total = np.bincount(owner, minlength=len(ids))
        self.prints = fingerprints(hashes, np.concatenate(([0], np.cumsum(self.total))))
        # counts of (item, shingle), and the items of each shingle
        order = np.lexsort((owner, hashes))
        h, j = hashes[order], owner[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (j[1:] != j[:-1])))
        at = np.flatnonzero(fresh)
        self.holder = j[at]
        self.shingle, self.first = np.unique(h[at], return_index=True)
        self.first = np.append(self.first, len(at))
        pair = tk.mix(h[at] ^ tk.mix(j[at], 92), 93)
        by = np.argsort(pair)
        self.pair, self.count = pair[by], np.diff(np.append(at, len(h)))[by]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.shingle >> np.uint64(44)] = True
        # multi-index: size, block number and block value lead to items
        keys, items = [], []
        self.present: list[np.ndarray] = []
        for number, (low, width, _) in enumerate(blocks_of(options.radius, options.blocks)):
            values = block_values(self.prints, low, width)
            self.present.append(np.zeros(1 << width, dtype=bool))
            self.present[-1][values] = True
            keys.append(self._key(sizes, number, values))
            items.append(np.arange(len(ids)))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.items = items[order]
        self.block, self.begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(self.begin, len(order))

    @staticmethod
    def _key(sizes: np.ndarray, number: int, value: np.ndarray) -> np.ndarray:
        return tk.mix(value | (np.uint64(number) << np.uint64(32)) | (sizes.astype(np.uint64) << np.uint64(40)), 94)

    def holders(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position in hashes, item)`` of every shingle that an item holds."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        row = np.minimum(np.searchsorted(self.shingle, hashes[at]), len(self.shingle) - 1)
        good = self.shingle[row] == hashes[at]
        at, row = at[good], row[good]
        many = self.first[row + 1] - self.first[row]
        return np.repeat(at, many), self.holder[_stretches(self.first[row], many)]

    def looked_up(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, item)`` of equal size that come within a block's radius in some block."""
        found = [np.empty(0, np.int64)]
        for number, (low, width, radius) in enumerate(blocks_of(self.options.radius, self.options.blocks)):
            if radius < 0:
                continue
            values = block_values(prints, low, width)
            flips = np.arange(1 << width, dtype=np.uint64)
            flips = flips[np.bitwise_count(flips) <= radius]
            step = max(1, 2_000_000 // len(flips))
            for first in range(0, len(values), step):
                probe = values[first : first + step, None] ^ flips
                window, flip = np.nonzero(self.present[number][probe])
                key = self._key(sizes[first + window], number, probe[window, flip])
                row = np.minimum(np.searchsorted(self.block, key), len(self.block) - 1)
                at = np.flatnonzero(self.block[row] == key)
                many = self.begin[row[at] + 1] - self.begin[row[at]]
                found.append(np.repeat(first + window[at], many) * len(self.ids) + self.items[_stretches(self.begin[row[at]], many)])
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        good = sizes[window] == self.words[item]
        return window[good], item[good]

    def near(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ``(window, item)`` of equal size whose fingerprints differ in at most ``radius`` bits."""
        window, item = self.looked_up(prints, sizes)
        good = distances(prints[window], self.prints[item]) <= self.options.radius
        return window[good], item[good]

    def shared(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Sum of the smaller counts for each pair of a run of shingles and an item."""
        at = _stretches(start, size)
        pair = np.repeat(np.arange(len(start)), size)
        wanted = tk.mix(hashes[at] ^ tk.mix(item[pair], 92), 93)
        row = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        good = self.pair[row] == wanted
        both, times = np.unique(pair[good] * len(self.pair) + row[good], return_counts=True)
        less = np.minimum(times, self.count[both % len(self.pair)])
        return np.bincount(both // len(self.pair), weights=less, minlength=len(start)).astype(np.int64)

    def windows(self, hashes: np.ndarray, inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, first word and item size of the windows that hold enough shingles of items of that size."""
        options, n = self.options, len(hashes)
        at = np.flatnonzero(inside)
        hit, item = self.holders(hashes[at])
        size, where = np.divmod(np.unique(self.words[item] * n + at[hit]), n)
        owner = np.searchsorted(bounds, where, side="right") - 1
        reach = np.maximum(size - options.shingle + 1, 1)
        last = np.arange(len(where)) + -(-options.percent * reach // 100) - 1
        there = np.minimum(last, len(where) - 1)
        good = (last < len(where)) & (owner[there] == owner) & (size[there] == size) & (where[there] - where <= reach - 1)
        some = np.flatnonzero(good)
        low, high, size, owner = where[there[some]] - reach[some] + 1, where[some], size[some], owner[some]
        floor = bounds[owner]
        top = np.maximum(floor, bounds[owner + 1] - size)
        low, high = np.clip(low, floor, top), np.clip(high, floor, top)
        many = high - low + 1
        size, start = np.divmod(np.unique(np.repeat(size, many) * n + _stretches(low, many)), n)
        return np.searchsorted(bounds, start, side="right") - 1, start, size

    def match(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, item id, first word, words and similarity of the best window for each text and item; of equally good ones the
        first."""
        options = self.options
        words, bounds = _words(column)
        empty = np.empty(0, np.int64)
        if not len(words) or not len(self.ids):
            return empty, empty, empty, empty, empty.astype(float)
        found = [self._short(words, bounds)]
        hashes, inside = shingles(words, bounds, options.shingle)
        owner, start, size = self.windows(hashes, inside, bounds)
        if len(owner):
            own = np.minimum(size, np.diff(bounds)[owner])
            count = np.maximum(own - options.shingle + 1, 1)
            window, item = self.near(run_prints(hashes, start, count), size)
            both = self.shared(hashes, start[window], count[window], item)
            union = count[window] + self.total[item] - both
            good = 100 * both >= options.percent * union
            window, item = window[good], item[good]
            found.append((owner[window], item, start[window], own[window], both[good] / union[good]))
        owner, item, start, own, similarity = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, -similarity, self.ids[item], owner))
        fresh = np.ones(len(order), dtype=bool)
        key = np.stack((owner[order], self.ids[item[order]]))
        fresh[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        some = order[fresh]
        return owner[some], self.ids[item[some]], start[some] - bounds[owner[some]], own[some], similarity[some]

    def _short(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of as many words as an item that has fewer than a shingle: their one shingle is the item's or not."""
        found = [(np.empty(0, np.int64),) * 4]
        sums = None
        for size in range(1, self.options.shingle):
            if not (self.words == size).any():
                continue
            sums = tk.running_sums(tk.mix(words, 9)) if sums is None else sums
            start = np.flatnonzero(tk.windows_inside(bounds, size, len(words)))
            hit, item = self.holders(tk.mix(tk.run_hashes(sums, start, start + size) ^ np.uint64(size), 10))
            good = self.words[item] == size
            at, item = start[hit[good]], item[good]
            found.append((np.searchsorted(bounds, at, side="right") - 1, item, at, np.full(len(at), size)))
        owner, item, start, own = (np.concatenate(x) for x in zip(*found))
        return owner, item, start, own, np.ones(len(owner))


MATCHES = "array<struct<item_id: bigint, start: bigint, words: bigint, similarity: double>>"


def _blocks(benchmark: DataFrame, options: Decontamination) -> Iterator[Index]:
    """The benchmark's items with a word, block by block; repeated ids are separate items of one id."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    rows = rows.where("item_id IS NOT NULL AND text RLIKE '[^ \\\\t-\\\\r]'").orderBy("item_id", "text")
    held: list = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == options.items:
            yield Index([r[0] for r in held], [r[1] for r in held], options)
            held = []
    if held:
        yield Index([r[0] for r in held], [r[1] for r in held], options)


def find_matches(docs: DataFrame, benchmark: DataFrame, options: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, matches)`` for every row of ``docs``: the items found in the text, each with its best window and similarity.

    Null and empty texts match nothing, nor do items without a word; without items nothing matches. A text shorter than an item
    is one window. Whole texts are searched, in one pass for each ``items`` items and without a shuffle.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.array().cast(MATCHES).alias("matches"))
    schema = f"doc_id long, text string, matches {MATCHES}"
    fields = [pa.field("item_id", pa.int64()), pa.field("start", pa.int64()), pa.field("words", pa.int64()), pa.field("similarity", pa.float64())]
    for number, index in enumerate(_blocks(benchmark, options)):
        if number and number % options.chain == 0:
            rows, _ = saved(rows, "matches")
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by Decontamination.items

        def step(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            owner, *values = shared.value.match(batch.column(1))
            before = batch.column(2)
            old = np.asarray(before.offsets, dtype=np.int64)
            earlier = before.flatten()
            previous = np.repeat(np.arange(batch.num_rows), np.diff(old))
            merged = [np.concatenate((np.asarray(earlier.field(k)), v)) for k, v in enumerate(values)] if len(earlier) else values
            owner = np.concatenate((previous, owner))
            order = np.argsort(owner, kind="stable")
            items = pa.StructArray.from_arrays([pa.array(v[order], f.type) for v, f in zip(merged, fields)], fields=fields)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
            return pa.record_batch([batch.column(0), batch.column(1), lists], names=["doc_id", "text", "matches"])

        rows = map_slices(rows, step, schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, options: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, contaminated, n_items, item_id, similarity, start, words)`` for every row: the match of the highest similarity, of
    the smallest item id among equals."""
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["similarity"].alias("s"), (-m["item_id"]).alias("i"), m["start"].alias("a"), m["words"].alias("w"))))
    found = find_matches(docs, benchmark, options, id_col, text_col).select(
        "doc_id", F.size(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))).cast("long").alias("n_items"), best.alias("best")
    )
    return found.select(
        "doc_id",
        (F.col("n_items") > 0).alias("contaminated"),
        "n_items",
        (-F.col("best.i")).alias("item_id"),
        F.col("best.s").alias("similarity"),
        F.col("best.a").alias("start"),
        F.col("best.w").alias("words"),
    )
