"""Suffix-array dedup: an enhanced suffix array per bucket of text contexts, scanned with a stack into the tree of its common-prefix
intervals; intervals with differing left extensions are the maximal repeats, each with all its occurrences.

A repeat of ``length`` bytes is a window whose minimum (see ``windows``) another document holds too. Neighbouring windows with
one minimum make a *context*, a short stretch of text that goes to the minimum's bucket. Equal windows so meet in one bucket, and
every repeat there is a common prefix of suffixes of contexts. Longer repeats come out as overlapping pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import windows as ws
from .common import free_shuffles, keyed_texts, map_slices, pack, pieces, saved, unpack
from .substring_dedup import digests, flagged_documents

#: Bytes of the grams that name windows.
GRAM = 16
#: Buckets of contexts for each bucket of minima; a bucket's suffix array is held in memory.
PARTS = 4
SENT = "bucket int, passed boolean, doc binary, fp binary, pos binary, size binary, data binary"


def byte_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tk.text_bytes(column)
    return tk.byte_units(raw), offsets


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all stretches, one after another."""
    shift = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    return np.repeat(begin - shift, size) + np.arange(int(size.sum()))


def equal_stretches(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per stretch of ``data``, the same for equal ones and in the order in which they first occur, and those first
    ones. The starts ascend. Hashes of 128 bits tell stretches apart."""
    a, b = (tk.stretch_hashes(data, begin, begin + size, seed) for seed in (81, 82))
    order = np.argsort(a)
    same_a, same_b = a[order][1:] == a[order][:-1], b[order][1:] == b[order][:-1]
    if (same_a & ~same_b).any():
        order = np.lexsort((b, a))
        same_a, same_b = a[order][1:] == a[order][:-1], b[order][1:] == b[order][:-1]
    if not len(order):
        return order, order
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = ~(same_a & same_b)
    earliest = np.minimum.reduceat(order, np.flatnonzero(fresh))
    rank = np.empty(len(earliest), dtype=np.int64)
    rank[np.argsort(earliest)] = np.arange(len(earliest))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = rank[np.cumsum(fresh) - 1]
    return out, np.sort(earliest)


def suffix_array(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``begin[i] .. end[i]`` in an order that puts those with equal first ``length`` bytes together and sorts these, and the
    length of the common prefix of each with the one before (0 if below ``length``)."""
    words = np.zeros(len(data) + 8, dtype=np.uint64)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    for k in range(8):
        words[: len(data)] |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)

    def column(at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        left = np.clip(stop - at, 0, 8)
        shift = (8 * (8 - left)).astype(np.uint64)
        value = words[np.minimum(at, len(words) - 1)]
        return np.where(left == 0, np.uint64(0), (value >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)))

    longest = int((end - begin).max()) if len(begin) else 0
    whole = range(0, length // 8)
    tail = range(length // 8, -(-longest // 8))
    head = tk.stretch_hashes(data, begin, begin + length, 83)
    order = np.lexsort([end - begin] + [column(begin + 8 * k, end) for k in reversed(tail)] + [head])
    start, stop = begin[order], end[order]
    lcp = np.zeros(len(order), dtype=np.int64)
    near = np.flatnonzero(head[order][1:] == head[order][:-1]) + 1
    for k in [*whole, *tail]:  # only those that agree so far go on
        x, y = column(start[near] + 8 * k, stop[near]), column(start[near - 1] + 8 * k, stop[near - 1])
        same = x == y
        differing = near[~same]
        bits = (x ^ y)[~same]
        lead = np.zeros(len(bits), dtype=np.int64)
        for step in (32, 16, 8):  # leading zero bytes
            clear = (bits >> np.uint64(64 - step)) == 0
            lead[clear] += step // 8
            bits = np.where(clear, bits << np.uint64(step), bits)
        lcp[differing] = 8 * k + lead
        near = near[same]
    lcp[near] = longest
    reach = stop - start
    lcp[1:] = np.minimum(lcp[1:], np.minimum(reach[1:], reach[:-1]))
    lcp[lcp < length] = 0
    return order, lcp


def maximal_intervals(lcp: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last row and depth of the common-prefix intervals whose rows differ in what stands on their left; ``left`` is a
    number, and below 0 it differs from everything.

    One scan keeps the open intervals on a stack: a smaller common prefix closes the deeper ones, which are then known whole.
    """
    change = np.ones(len(lcp), dtype=np.int64)
    change[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
    changes = np.cumsum(change).tolist()
    firsts, lasts, depths = [], [], []
    stack: list[tuple[int, int]] = []
    row = 0
    for depth in [*lcp.tolist()[1:], 0]:
        row += 1
        begin = row - 1
        while stack and stack[-1][0] > depth:
            closed, begin = stack.pop()
            if changes[row - 1] != changes[begin]:
                firsts.append(begin)
                lasts.append(row - 1)
                depths.append(closed)
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))
    return np.array(firsts, dtype=np.int64), np.array(lasts, dtype=np.int64), np.array(depths, dtype=np.int64)


def repeats_of_contexts(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least ``length`` bytes between the (distinct) contexts: group number, context, offset and depth of
    every occurrence."""
    count = np.maximum(size - length + 1, 0)
    context = np.repeat(np.arange(len(size)), count)
    start = _stretches(begin, count)
    offset = start - begin[context]
    end = (begin + size)[context]
    # suffixes whose first bytes stand alone are in no interval
    head = tk.stretch_hashes(data, start, start + length, 84)
    _, back, times = np.unique(head, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[back] > 1)
    if not len(some):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    order, lcp = suffix_array(data, start[some], end[some], length)
    rows = some[order]
    left = np.where(offset[rows] > 0, data[np.maximum(start[rows] - 1, 0)].astype(np.int64), -1)
    first, last, depth = maximal_intervals(lcp, left)
    sizes = last - first + 1
    at = rows[_stretches(first, sizes)]
    return np.repeat(np.arange(len(first)), sizes), context[at], offset[at], np.repeat(depth, sizes)


def _contexts(batch: pa.RecordBatch, length: int):
    """The contexts of a slice: owner, position, bytes."""
    raw, offsets = tk.text_bytes(batch.column(1))
    least, inside = ws.minima(tk.byte_units(raw), offsets, GRAM, length)
    first, last = ws.runs_of(least, inside, most=length - GRAM + 1)
    owner = ws.owner_of(offsets, first)
    good = ws.member(ws.short(least[first]), owner, batch.column(3))
    first, last = first[good], last[good]
    return raw, offsets, owner[good], least[first], first, last - first + length


def _send(batch: pa.RecordBatch, length: int, buckets: int) -> pa.RecordBatch | None:
    raw, offsets, owner, least, begin, size = _contexts(batch, length)
    if not len(begin):
        return None
    doc, fp = batch.column(0).to_numpy()[owner], batch.column(2).to_numpy()[owner]
    pos = begin - offsets[owner]
    # of equal contexts in this slice those of later documents are settled: all of their bytes go
    same, _ = equal_stretches(raw, begin, size)
    order = np.lexsort((doc, same))
    start = np.concatenate(([True], same[order][1:] != same[order][:-1]))
    low = doc[order][np.flatnonzero(start)][np.cumsum(start) - 1]
    settled = np.zeros(len(doc), dtype=bool)
    settled[order] = doc[order] > low
    columns: list[list] = [[], [], [], [], [], [], []]
    press = zstandard.ZstdCompressor(level=1)
    names = (tk.mix(least, 85) % np.uint64(buckets)).astype(np.int64)
    names[settled] = ws.part_of(doc[settled], buckets)
    for code, some in zip(*ws._dealt(names * 2 + settled)):
        columns[0].append(code // 2)
        columns[1].append(bool(code % 2))
        columns[2].append(pack(doc[some]))
        columns[3].append(fp[some].tobytes())
        columns[4].append(pack(pos[some]))
        columns[5].append(pack(size[some]))
        columns[6].append(b"" if code % 2 else press.compress(raw[_stretches(begin[some], size[some])].tobytes()))
    types = (pa.int32(), pa.bool_()) + (pa.binary(),) * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SENT.split(", ")])


def _placed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, text, position and size of the contexts in these rows."""
    doc, pos, size = (unpack(rows.column(c).combine_chunks()) for c in ("doc", "pos", "size"))
    return doc, ws.numbers(rows.column("fp"), np.int64), pos, size


def _received(table: pa.Table):
    asked = table.filter(pa.compute.invert(table.column("passed")))
    press = zstandard.ZstdDecompressor()
    data = np.frombuffer(b"".join(press.decompress(x.as_buffer()) for x in asked.column("data").combine_chunks()), dtype=np.uint8)
    doc, fp, pos, size = _placed(asked)
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    return data, doc, fp, pos, size, begin, *equal_stretches(data, begin, size)


def removed_runs(sent: DataFrame, length: int, buckets: int) -> DataFrame:
    """``(doc_id, fp, hits)``: per text the byte runs that a smaller document holds too, packed as ``first << 32 | behind last``."""

    def run(table: pa.Table) -> pa.Table:
        data, doc, fp, pos, size, begin, same, first = _received(table)
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, same, doc)
        far_doc, far_fp, far_pos, far_size = _placed(table.filter(table.column("passed")))
        out = [[far_doc], [far_fp], [far_pos], [far_pos + far_size]]

        def add(at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
            for column, values in zip(out, (doc[at], fp[at], start, stop)):
                column.append(values)

        later = np.flatnonzero(doc > low[same])
        add(later, pos[later], pos[later] + size[later])
        group, context, offset, depth = repeats_of_contexts(data, begin[first], size[first], length)
        if len(group):
            least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, low[context])
            hit = low[context] > least[group]
            context, offset, depth = context[hit], offset[hit], depth[hit]
            # the occurrences of a context in its least document; the others are gone already
            rows = np.flatnonzero(doc == low[same])
            rows = rows[np.argsort(same[rows], kind="stable")]
            start = np.searchsorted(same[rows], context)
            many = np.searchsorted(same[rows], context, side="right") - start
            at = rows[_stretches(start, many)]
            shift, long = np.repeat(offset, many), np.repeat(depth, many)
            add(at, pos[at] + shift, pos[at] + shift + long)
        d, f, a, b = (np.concatenate(x) for x in out)
        return ws.answers(d, f, (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), buckets)

    return ws.regroup(sent.groupBy("bucket").applyInArrow(run, ws.ANSWER), np.uint64, with_fp=True)


def _found(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All texts, the candidates, and the runs to remove from them; the last two are written tables."""
    texts = keyed_texts(docs, id_col, text_col)
    buckets = ws.bucket_count(texts)
    candidates, _ = flagged_documents(texts, byte_units, GRAM, length, buckets, "suffix-candidates")
    sent = map_slices(candidates.select("doc_id", "text", "fp", "hits"), lambda b: _send(b, length, PARTS * buckets), SENT)
    runs, _ = saved(removed_runs(sent, length, PARTS * buckets), "suffix-runs")
    free_shuffles(docs.sparkSession)
    return texts, candidates, runs


def maximal_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(group, bytes, doc_id, fp, start)``: the maximal repeats of at least ``length`` bytes with all their occurrences. Repeats that are
    longer than a context come out in overlapping pieces. A row per occurrence; meant for a look at what repeats, as dedup
    needs the runs alone."""
    texts = keyed_texts(docs, id_col, text_col)
    buckets = ws.bucket_count(texts)
    candidates, _ = flagged_documents(texts, byte_units, GRAM, length, buckets, "suffix-candidates")

    def occurrences(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets, owner, least, begin, size = _contexts(batch, length)
        arrays = [
            pa.array((tk.mix(least, 85) % np.uint64(PARTS * buckets)).astype(np.int32)),
            pa.array(np.zeros(len(begin), dtype=bool)),
        ]
        for values in (batch.column(0).to_numpy()[owner], batch.column(2).to_numpy()[owner], begin - offsets[owner], size):
            some = np.split(values, np.arange(1, len(values)))
            arrays.append(pa.array([pack(v) for v in some] if len(arrays) != 3 else [v.tobytes() for v in some], pa.binary()))
        press = zstandard.ZstdCompressor(level=1)
        arrays.append(pa.array([press.compress(raw[a:b].tobytes()) for a, b in zip(begin, begin + size)], pa.binary()))
        return pa.record_batch(arrays, names=[x.split()[0] for x in SENT.split(", ")])

    def run(table: pa.Table) -> pa.Table:
        data, doc, fp, pos, size, begin, same, first = _received(table)
        group, context, offset, depth = repeats_of_contexts(data, begin[first], size[first], length)
        # equal contexts are one row above; alone they are a repeat of their own
        times = np.bincount(same, minlength=len(first))
        alone = np.flatnonzero(times > 1)
        group = np.concatenate((group, (group[-1] + 1 if len(group) else 0) + np.arange(len(alone))))
        context, offset = np.concatenate((context, alone)), np.concatenate((offset, np.zeros(len(alone), np.int64)))
        depth = np.concatenate((depth, size[first][alone]))
        rows = np.argsort(same, kind="stable")
        start = np.searchsorted(same[rows], context)
        many = times[context] if len(context) else context
        at = rows[_stretches(start, many)]
        number = np.repeat(group, many)
        bucket = table.column("bucket")[0].as_py()
        begins = begin[at] + np.repeat(offset, many)
        long = np.repeat(depth, many)
        text = pieces(data[_stretches(begins, long)], np.concatenate(([0], np.cumsum(long))))
        return pa.table(
            {
                "repeat": pa.array((number + (bucket << 40)).astype(np.int64)),
                "content": text.cast(pa.binary()),
                "doc_id": pa.array(doc[at]),
                "fp": pa.array(fp[at]),
                "start": pa.array(pos[at] + np.repeat(offset, many)),
            }
        )

    sent = map_slices(candidates.select("doc_id", "text", "fp", "hits"), occurrences, SENT)
    return sent.groupBy("bucket").applyInArrow(run, "repeat long, content binary, doc_id long, fp long, start long")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    raw, offsets = tk.text_bytes(batch.column(1))
    given, bounds = tk.text_bytes(batch.column(2))
    runs = np.frombuffer(given.tobytes(), dtype=np.uint64)
    of = offsets[np.repeat(np.arange(batch.num_rows), np.diff(bounds) // 8)]
    change = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(change, of + (runs >> np.uint64(32)).astype(np.int64), 1)
    np.add.at(change, of + (runs & np.uint64(0xFFFFFFFF)).astype(np.int64), -1)
    gone = np.cumsum(change[:-1]) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    opens[edge] = gone[edge]
    removed = tk.count_between(gone, offsets)
    size = np.diff(offsets)
    kept = raw[~gone]
    cuts = np.concatenate(([0], np.cumsum(size - removed)))
    arrays = [batch.column(0), pa.array(size), pa.array(removed), pa.array(tk.count_between(opens, offsets)), pa.array(digests(kept, cuts), pa.string())]
    if "kept" in names:
        arrays.append(pieces(kept, cuts))
    if "fp" in names:
        arrays.append(batch.column(3))
    return pa.record_batch(arrays, names=names)


def _cut(candidates: DataFrame, runs: DataFrame, more: str = "") -> DataFrame:
    """The candidates without the runs."""
    schema = RESULT + more
    names = [part.split()[0] for part in schema.split(", ")]
    hit = candidates.select("doc_id", "fp", "text").join(runs, ["doc_id", "fp"], "left")
    hit = hit.select("doc_id", "text", F.coalesce("hits", F.lit(b"")).alias("runs"), "fp")
    return map_slices(hit, lambda batch: _finish(batch, names), schema)


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` for every row with an id: each byte covered by a string of ``length``
    bytes that also starts in a document with a smaller id is removed; strings are judged on the input and never cross texts.

    Null and empty texts have no bytes, shorter ones lose nothing. Rows with equal ids do not remove from each other. ``kept`` is
    binary, as a cut may fall inside a character.
    """
    texts, candidates, runs = _found(docs, length, id_col, text_col)
    cut = _cut(candidates, runs, ", kept binary" * with_text)
    body = F.col("text").cast("binary")
    nothing = F.lit(0).cast("long")
    whole = [F.col("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256")]
    rest = texts.select(*whole, *([body.alias("kept")] if with_text else []))
    rest = rest.join(candidates.select("doc_id").distinct(), "doc_id", "left_anti")
    return rest.union(cut)


def shortened_texts(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, kept)`` of the texts that lose something, once each: what is left of them. ``fp`` is the hash of the text before,
    as in ``keyed_texts``."""
    _, candidates, runs = _found(docs, length, id_col, text_col)
    cut = _cut(candidates, runs, ", kept binary, fp long").where("n_removed > 0")
    return cut.select("doc_id", "fp", "kept").dropDuplicates(["doc_id", "fp"])
