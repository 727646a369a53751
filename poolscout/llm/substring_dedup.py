"""Substring dedup by level-wise doubling: windows that repeat at one length are extended to twice that length.

The lengths are the final one and its halves (13, 25, 50 words). On a level below the last a window of the final length is named by
its minimum, the least hash of the level's grams in it, and survives if another document holds that minimum too; only survivors are
named by grams twice as long on the next level. What is left at the final length is compared by 128-bit hashes. It ends early where
no candidate survives. ``longest_repeats`` has no final length and goes on doubling until then.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import windows as ws
from .common import discard, free_shuffles, keyed_texts, map_slices, saved


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tk.text_bytes(column)
    starts, ends, first = tk.words_of(raw, offsets)
    return tk.word_hashes(raw, starts, ends), first


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space, as bytes and offsets."""
    n = len(first) - 1
    kept = np.flatnonzero(keep)
    owner = np.searchsorted(first, kept, side="right") - 1
    change = np.zeros(len(raw) + 1, dtype=np.int8)
    change[starts[kept]] += 1
    change[ends[kept]] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    out = raw.copy()
    follows = np.zeros(len(kept), dtype=bool)
    follows[:-1] = owner[1:] == owner[:-1]
    gaps = ends[kept[follows]]  # the separator after a word that another kept word follows
    inside[gaps] = True
    out[gaps] = 0x20
    size = np.bincount(owner, weights=(ends - starts)[kept] + follows, minlength=n).astype(np.int64)
    return out[inside], np.concatenate(([0], np.cumsum(size)))


def digests(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    data = memoryview(np.ascontiguousarray(raw))
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def flagged_documents(texts: DataFrame, units, gram: int, length: int, buckets: int, label: str) -> tuple[DataFrame, str]:
    """The texts that share a minimum with another document, with these minima, as a written table."""
    shared = ws.shared_minima(texts, units, gram, length, buckets)
    found = saved(texts.join(shared, "doc_id"), label)
    free_shuffles(texts.sparkSession)
    return found


def doubling(length: int, least: int = 13) -> list[int]:
    """The lengths of the levels: ``length``, its half, the half of that, while a half is of ``least`` units or more, and one half at
    least."""
    levels = [length, (length + 1) // 2]
    while (levels[-1] + 1) // 2 >= least:
        levels.append((levels[-1] + 1) // 2)
    return levels[::-1]


def repeated_windows(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All texts; the candidates ``(doc_id, text, fp, hits)``; and ``(doc_id, removed)`` with the packed hashes of the windows that
    also start in a document with a smaller id."""
    texts = keyed_texts(docs, id_col, text_col)
    buckets = ws.bucket_count(texts)
    rows, path, before = texts, None, None
    for gram in doubling(length)[:-1]:
        shared = ws.shared_minima(rows, word_units, gram, length, buckets, before)
        found, found_path = saved(rows.select("doc_id", "text", "fp").join(shared, "doc_id"), f"substring-level-{gram}")
        free_shuffles(docs.sparkSession)
        if path:
            discard(docs.sparkSession, path)
        rows, path, before = found, found_path, gram
        if rows.isEmpty():
            break
    candidates = rows

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        units, bounds = word_units(batch.column(1))
        at = np.flatnonzero(ws.surviving(*ws.minima(units, bounds, before, length), bounds, batch.column(3)))
        if not len(at):
            return None
        a, b = tk.window_hashes(units, length, 71)[at], tk.window_hashes(units, length, 72)[at]
        return ws.send(a, b, batch.column(0).to_numpy()[ws.owner_of(bounds, at)], buckets, later=True)

    sent = map_slices(candidates.select("doc_id", "text", "fp", "hits"), extend, ws.ASK)
    removed = ws.settle(sent, buckets, later=True, kind=np.uint64).withColumnRenamed("hits", "removed")
    return texts, candidates, removed


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])`` for every row with an id: each word covered by a window of ``length`` words
    that also starts in a document with a smaller id is removed; windows are judged on the input.

    Null and empty texts have no words. Rows with equal ids are one document's: neither removes from the other, and each
    loses what smaller ids hold. Texts of fewer words than a window lose nothing.
    """
    texts, candidates, removed = repeated_windows(docs, length, id_col, text_col)
    schema = RESULT + ", kept string" * with_text
    names = [part.split()[0] for part in schema.split(", ")]

    def finish(batch: pa.RecordBatch, packed: pa.Array | None) -> pa.RecordBatch:
        raw, offsets = tk.text_bytes(batch.column(1))
        starts, ends, first = tk.words_of(raw, offsets)
        keep = np.ones(len(starts), dtype=bool)
        if packed is not None:
            units = tk.word_hashes(raw, starts, ends)
            at = np.flatnonzero(tk.windows_inside(first, length, len(units)))
            owner = np.searchsorted(first, at, side="right") - 1
            hit = ws.member(tk.window_hashes(units, length, 71)[at], owner, packed)
            keep = ~tk.covered(at[hit], length, len(units)) if len(units) else keep
        data, bounds = joined_words(raw, starts, ends, first, keep)
        arrays = [batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(tk.count_between(~keep, first), pa.int64()), pa.array(digests(data, bounds))]
        if with_text:
            arrays.append(pa.array([data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()))
        return pa.record_batch(arrays, names=names)

    # texts without a candidate window stay whole; of the others the windows that are hit come along
    whole = texts.join(candidates.select("doc_id").distinct().withColumn("c", F.lit(True)), "doc_id", "left_anti") if with_text else None
    hit = candidates.select("doc_id", "text").join(removed, "doc_id", "left").withColumn("removed", F.coalesce("removed", F.lit(b"")))
    cut = map_slices(hit.select("doc_id", "text", "removed"), lambda b: finish(b, b.column(2)), schema)
    if with_text:
        rest = map_slices(whole.select("doc_id", "text"), lambda b: finish(b, None), schema)
    else:
        # digests of all texts are narrow, so the candidates are taken out after them and no text moves
        rest = map_slices(texts.select("doc_id", "text"), lambda b: finish(b, None), schema)
        rest = rest.join(candidates.select("doc_id").distinct(), "doc_id", "left_anti")
    return rest.union(cut)


def longest_repeats(docs: DataFrame, start: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(length, doc_id)``: for ``start`` words and every doubling of it, the documents with a window that another document repeats;
    it ends with the length at which no window survives. From the second level on only windows are looked at of which both
    halves have survived."""
    texts = keyed_texts(docs, id_col, text_col)
    buckets = ws.bucket_count(texts)
    spark = docs.sparkSession
    rows, out, length, path = texts.withColumn("hits", F.lit(b"")), None, start, None
    while True:

        def level(batch: pa.RecordBatch, length: int = length, first_level: bool = path is None) -> pa.RecordBatch | None:
            units, bounds = word_units(batch.column(1))
            at = np.flatnonzero(tk.windows_inside(bounds, length, len(units)))
            owner = np.searchsorted(bounds, at, side="right") - 1
            if not first_level:  # both halves must have survived
                below = tk.window_hashes(units, length // 2, 71)
                good = ws.member(below[at], owner, batch.column(3)) & ws.member(below[at + length // 2], owner, batch.column(3))
                at, owner = at[good], owner[good]
            if not len(at):
                return None
            docs_ = batch.column(0).to_numpy()[owner]
            return ws.send(tk.window_hashes(units, length, 71)[at], tk.window_hashes(units, length, 72)[at], docs_, buckets, later=False)

        sent = map_slices(rows.select("doc_id", "text", "fp", "hits"), level, ws.ASK)
        found = ws.settle(sent, buckets, later=False, kind=np.uint64)
        following, new_path = saved(texts.join(found, "doc_id"), "doubling")
        if path:
            discard(spark, path)
        rows, path = following, new_path
        counts, _ = saved(rows.select(F.lit(length).alias("length"), "doc_id").distinct(), "doubling-counts")
        if counts.isEmpty():
            return counts if out is None else out
        out = counts if out is None else out.union(counts)
        length *= 2
