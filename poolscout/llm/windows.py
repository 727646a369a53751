"""Windows that several documents share: the exchange behind substring and suffix-array dedup.

Every window of ``length`` units (words or bytes) is named by its *minimum*, the least hash of the grams of ``gram`` units in it.
Equal windows have equal minima, and neighbouring windows mostly share theirs, so a table of each document's distinct minima is a
small fraction of its windows. A window whose minimum stands in one document alone cannot be shared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import map_slices, pack, pieces, unpack

#: Bytes of text per bucket of an exchange; a bucket's hashes are a fraction of that in memory.
BUCKET_BYTES = 16_000_000

#: Rows of the first exchange, to the buckets of the keys, and of the second, back to the documents.
ASK = "bucket int, passed boolean, a binary, b binary, d binary"
ANSWER = "part int, d binary, f binary, many binary, v binary"


def bucket_count(texts: DataFrame) -> int:
    """Buckets in proportion to the bytes of all texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))


def minima(units: np.ndarray, bounds: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimum of the window from each position on, and which of these windows lie inside one text."""
    least = tk.sliding_min(tk.gram_hashes(units, gram), length - gram + 1)
    inside = np.ones(len(least), dtype=bool)
    for bound in bounds[1:-1].tolist():
        inside[max(0, bound - length + 1) : bound] = False
    return least, inside


def runs_of(least: np.ndarray, inside: np.ndarray, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of the runs of neighbouring windows with one minimum, ``most`` long at most. Between the windows of
    two texts there is always one that is in neither."""
    joined = inside[1:] & inside[:-1]
    joined &= least[1:] == least[:-1]
    fresh, final = inside.copy(), inside.copy()
    fresh[1:] &= ~joined
    final[:-1] &= ~joined
    first, last = np.flatnonzero(fresh), np.flatnonzero(final)
    many = (last - first) // most + 1
    if len(many) and many.max() > 1:
        start = np.repeat(first, many) + most * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        return start, np.minimum(np.repeat(last, many), start + most - 1)
    return first, last


def owner_of(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, at, side="right") - 1


def _groups(a: np.ndarray, b: np.ndarray | None, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document, group starts in that order, and group numbers."""
    order = np.lexsort((d, a) if b is None else (d, b, a))
    fresh = np.ones(len(order), dtype=bool)
    x = a[order]
    fresh[1:] = x[1:] != x[:-1]
    if b is not None:
        y = b[order]
        fresh[1:] |= y[1:] != y[:-1]
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def hits(a: np.ndarray, b: np.ndarray | None, d: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are hit, and the first entry of each key (that of the least document).

    An entry is hit if its key has a smaller document (``later``), or another document at all.
    """
    if not len(a):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
    order, begin, group = _groups(a, b, d)
    sorted_docs = d[order]
    first = sorted_docs[begin]
    if later:
        hit = sorted_docs > first[group]
    else:
        last = sorted_docs[np.append(begin[1:], len(order)) - 1]
        hit = (last > first)[group]
    out = np.zeros(len(a), dtype=bool)
    out[order] = hit
    return out, order[begin]


def _dealt(name: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct names, and the entries of each."""
    order = np.argsort(name, kind="stable")
    names, begin = np.unique(name[order], return_index=True)
    return names.tolist(), np.split(order, begin[1:])


def part_of(d: np.ndarray, parts: int) -> np.ndarray:
    return (tk.mix(d.view(np.uint64), 51) % np.uint64(parts)).astype(np.int32)


def send(a: np.ndarray, b: np.ndarray | None, d: np.ndarray, buckets: int, later: bool, wire: Callable[[np.ndarray], np.ndarray] = lambda a: a) -> pa.RecordBatch:
    """Rows of the first exchange for the entries (key ``a`` or ``(a, b)``, document ``d``) of one slice.

    What the slice settles on its own is passed on to the document's part; of each key one entry, that of the least document,
    goes to the key's bucket. A key that a third of all documents hold is so one entry per slice. Keys travel as ``wire`` makes
    them; what the slice settles and the bucket follow the whole key.
    """
    hit, first = hits(a, b, d, later)
    columns: list[list] = [[], [], [], [], []]
    settled = np.flatnonzero(hit)
    for passed, at, bucket in ((True, settled, part_of(d[settled], buckets)), (False, first, (tk.mix(a[first], 52) % np.uint64(buckets)).astype(np.int32))):
        if len(at):
            for name, some in zip(*_dealt(bucket)):
                some = at[some]
                columns[0].append(name)
                columns[1].append(passed)
                columns[2].append(wire(a[some]).tobytes())
                columns[3].append(b"" if b is None or passed else b[some].tobytes())
                columns[4].append(pack(d[some]))
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in ASK.split(", ")])


def numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    raw, _ = tk.text_bytes(column.combine_chunks())
    return np.frombuffer(raw.tobytes(), dtype=kind)


def answers(d: np.ndarray, f: np.ndarray | None, v: np.ndarray, parts: int) -> pa.Table:
    """Rows of the second exchange: values for documents (and their texts), dealt by document. The values of one text stand
    together, so a row names each text once."""
    columns: list[list] = [[], [], [], [], []]
    if len(d):
        for name, some in zip(*_dealt(part_of(d, parts))):
            own = np.zeros(len(some), np.int64) if f is None else f[some]
            order = np.lexsort((own, d[some]))
            some, own = some[order], own[order]
            fresh = np.ones(len(some), dtype=bool)
            fresh[1:] = (d[some][1:] != d[some][:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(fresh)
            columns[0].append(name)
            columns[1].append(pack(d[some[at]]))
            columns[2].append(b"" if f is None else own[at].tobytes())
            columns[3].append(pack(np.diff(np.append(at, len(some)))))
            columns[4].append(v[some].tobytes())
    kinds = (pa.int32(),) + (pa.binary(),) * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in ANSWER.split(", ")])


def regroup(found: DataFrame, kind: type, with_fp: bool = False) -> DataFrame:
    """``(doc_id[, fp], hits)``: per document (and text) its distinct values, packed."""

    def run(table: pa.Table) -> pa.Table:
        d, many = (unpack(table.column(c).combine_chunks()) for c in ("d", "many"))
        f = numbers(table.column("f"), np.int64) if with_fp else np.zeros(len(d), np.int64)
        d, f, v = np.repeat(d, many), np.repeat(f, many), numbers(table.column("v"), kind)
        order = np.lexsort((v, f, d))
        d, f, v = d[order], f[order], v[order]
        text = np.ones(len(d), dtype=bool)
        text[1:] = (d[1:] != d[:-1]) | (f[1:] != f[:-1])
        fresh = text.copy()
        fresh[1:] |= v[1:] != v[:-1]
        text, d, f, v = np.flatnonzero(text[fresh]), d[fresh], f[fresh], np.ascontiguousarray(v[fresh])
        packed = pieces(v.view(np.uint8), np.append(text, len(v)) * v.itemsize)
        out = {"doc_id": pa.array(d[text])} | ({"fp": pa.array(f[text])} if with_fp else {})
        return pa.table(out | {"hits": packed})

    return found.groupBy("part").applyInArrow(run, "doc_id long, fp long, hits binary" if with_fp else "doc_id long, hits binary")


def settle(sent: DataFrame, buckets: int, later: bool, kind: type) -> DataFrame:
    """``(doc_id, hits)``: per document its keys that are hit, packed."""

    def run(table: pa.Table) -> pa.Table:
        passed = table.filter(table.column("passed"))
        asked = table.filter(pa.compute.invert(table.column("passed")))
        a, b, d = numbers(asked.column("a"), kind), numbers(asked.column("b"), np.uint64), unpack(asked.column("d").combine_chunks())
        hit, _ = hits(a, b if later else None, d, later)
        docs = np.concatenate((unpack(passed.column("d").combine_chunks()), d[hit]))
        return answers(docs, None, np.concatenate((numbers(passed.column("a"), kind), a[hit])), buckets)

    return regroup(sent.groupBy("bucket").applyInArrow(run, ANSWER), kind)


def short(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key, independent of its bucket. A bucket holds about a million keys however much text there is, so two
    different ones agree in one of some 5000 cases, and a false hit only costs a look at the next level."""
    return (tk.mix(keys, 53) >> np.uint64(32)).astype(np.uint32)


def surviving(least: np.ndarray, inside: np.ndarray, bounds: np.ndarray, packed: pa.Array) -> np.ndarray:
    """Which of the windows have a minimum among the packed ones (shortened) of their text."""
    first, last = runs_of(least, inside)
    good = member(short(least[first]), owner_of(bounds, first), packed)
    step = np.zeros(len(inside) + 1, dtype=np.int32)
    step[first[good]] += 1
    step[last[good] + 1] -= 1
    return np.cumsum(step[:-1]) > 0


def shared_minima(
    texts: DataFrame, units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], gram: int, length: int, buckets: int, before: int | None = None
) -> DataFrame:
    """``(doc_id, hits)`` of the documents that hold a minimum of another document, with those minima (shortened). Given the gram
    ``before``, only windows count whose minimum of such grams stands in the column ``hits`` of ``texts``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        values, bounds = units(batch.column(1))
        least, inside = minima(values, bounds, gram, length)
        if before is not None:
            inside = surviving(*minima(values, bounds, before, length), bounds, batch.column(2))
        first, _ = runs_of(least, inside)
        if not len(first):
            return None
        keys, docs = least[first], batch.column(0).to_numpy()[owner_of(bounds, first)]
        # a document's repeats of its own are one entry
        _, some = np.unique(tk.mix(keys ^ tk.mix(docs.view(np.uint64), 54), 55), return_index=True)
        return send(keys[some], None, docs[some], buckets, later=False, wire=short)

    columns = ["doc_id", "text"] + ["hits"] * (before is not None)
    return settle(map_slices(texts.select(*columns), step, ASK), buckets, later=False, kind=np.uint32)


def member(keys: np.ndarray, owner: np.ndarray, packed: pa.Array) -> np.ndarray:
    """Which ``(key, row)`` stand among the packed keys of their row."""
    raw, offsets = tk.text_bytes(packed)
    given = np.frombuffer(raw.tobytes(), dtype=keys.dtype)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // keys.itemsize)
    known = np.sort(tk.mix(given.astype(np.uint64) ^ tk.mix(rows, 61), 62))
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    wanted = tk.mix(keys.astype(np.uint64) ^ tk.mix(owner, 61), 62)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return known[at] == wanted
