"""Near duplicates by MinHash with sequential Bayesian verification.

Documents with equal shingle sets are one class. Signatures of the classes are banded; of a candidate pair, batches of signature
values are compared until the posterior probability that the pair is similar enough falls below the chosen miss probability;
what survives all batches is verified on the full shingle sets. Components of the verified links are the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import discard, free_shuffles, keyed_texts, map_slices, pieces, saved
from .components import components


@dataclass(frozen=True)
class NearDups:
    """Sets of ``shingle`` words, linked from a similarity of ``percent`` / 100. ``bands`` of ``rows`` values: a pair at 0.75 misses
    all 32 bands of 4 with probability 5e-6. ``miss`` is the posterior probability at which a comparison stops, looked at after
    every ``batch`` values. Members of one band bucket are compared in blocks of ``block``."""

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    block: int = 2000


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted within the text, and the bounds of the texts. A text with fewer words than
    a shingle has its whole sequence as one."""
    raw, offsets = tk.text_bytes(column)
    starts, ends, first = tk.words_of(raw, offsets)
    words = tk.word_hashes(_lower[raw], starts, ends)
    counts = np.diff(first)
    window = tk.window_hashes(words, size, 1)
    fits = tk.windows_inside(first, size, len(words))
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[: len(window)][fits]
    window = window[fits]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = tk.running_sums(tk.mix(words, 9))
        whole = tk.mix(tk.run_hashes(sums, first[short], first[short + 1]) ^ counts[short].astype(np.uint64), 10)
        window, owner = np.concatenate((window, whole)), np.concatenate((owner, short.astype(np.int32)))
    order = np.argsort(window)
    order = order[np.argsort(owner[order], kind="stable")]
    window, owner = window[order], owner[order]
    fresh = np.ones(len(window), dtype=bool)
    fresh[1:] = (window[1:] != window[:-1]) | (owner[1:] != owner[:-1])
    window, owner = window[fresh], owner[fresh]
    return window, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray, values: int) -> np.ndarray:
    """A row of ``values`` 32-bit minima per set; empty sets have zeros."""
    out = np.zeros((len(bounds) - 1, values), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        begin = bounds[:-1][full]
        factors, masks = tk.mix(np.arange(values), 3) | np.uint64(1), tk.mix(np.arange(values), 4)
        for k in range(values):
            out[full, k] = np.minimum.reduceat((hashes ^ masks[k]) * factors[k], begin) >> np.uint64(32)
    return out


def stop_counts(options: NearDups) -> list[tuple[int, int]]:
    """After how many values a pair with at most how many equal ones is given up.

    With a flat prior the posterior of the similarity after m equal values of n is beta(m + 1, n - m + 1), whose mass above
    the threshold t is the binomial probability of at most m successes in n + 1 trials at t.
    """
    t, stops = options.percent / 100, []
    total = options.bands * options.rows
    for n in range(options.batch, total + 1, options.batch):
        mass, m = 0.0, -1
        while m < n:
            step = math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if mass + step >= options.miss:
                break
            mass, m = mass + step, m + 1
        stops.append((n, m))
    return stops


def survivors(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, stops: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs (rows ``a`` of the left, ``b`` of the right signatures) that no batch gives up. Only the values of a
    batch, and of the pairs still alive, are ever put side by side."""
    alive, equal, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), 0
    for upto, most in stops:
        equal = equal + (left[a[alive], done:upto] == right[b[alive], done:upto]).sum(axis=1, dtype=np.int32)
        good = equal > most
        alive, equal, done = alive[good], equal[good], upto
        if not len(alive):
            break
    return alive


def _signature_rows(column: pa.Array, values: int) -> np.ndarray:
    raw, _ = tk.text_bytes(column)
    return raw.view(np.uint32).reshape(-1, values)


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tk.text_bytes(column)
    return np.frombuffer(raw.tobytes(), dtype=np.uint64), offsets // 8


def _linked(pairs: DataFrame, held: DataFrame, options: NearDups) -> DataFrame:
    """The candidate pairs ``(a, tag_a, b, tag_b)`` that pass the sequential test and whose full sets are similar enough."""
    values, stops = options.bands * options.rows, stop_counts(options)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (_signature_rows(batch.column(i), values) for i in (2, 3))
            (x, x_at), (y, y_at) = (_sets(batch.column(i)) for i in (4, 5))
            here = np.arange(batch.num_rows)
            kept = [i for i in survivors(left, right, here, here, stops).tolist() if _alike(x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]], options.percent)]
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    sides = [held.select(F.col("rep").alias(k), F.col("tag").alias(f"tag_{k}"), F.col("sig").alias(f"sig_{k}"), F.col("hashes").alias(f"set_{k}")) for k in ("a", "b")]
    both = pairs.join(sides[0], ["a", "tag_a"]).join(sides[1], ["b", "tag_b"]).select("a", "b", "sig_a", "sig_b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long")


def _crossing(members: DataFrame, held: DataFrame, options: NearDups) -> DataFrame:
    """Of the buckets ``(band_key, rep, tag, root)`` that still hold several components, the links between these.

    A bucket is dealt out in blocks, each pair of blocks to a group of its own, so that no group exceeds twice the block. A group
    takes all pairs between components through the sequential test and verifies what passes. It gives out a link only if it joins
    members that its earlier links do not, so fewer links than members.
    """
    values, stops = options.bands * options.rows, stop_counts(options)
    open_keys = members.groupBy("band_key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).where("r0 <> r1")
    blocks = F.ceil(F.col("m") / options.block).cast("int")
    rows = members.join(open_keys.select("band_key", blocks.alias("blocks")), "band_key")
    own = F.pmod(F.xxhash64("rep", "tag"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band_key", "rep", "tag", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(held, ["rep", "tag"]).select("band_key", "i", "j", "own", "rep", "root", "sig", "hashes")

    def run(table: pa.Table) -> pa.Table:
        rep, root, side = (table.column(c).to_numpy() for c in ("rep", "root", "own"))
        sig = _signature_rows(table.column("sig").combine_chunks(), values)
        sets, bounds = _sets(table.column("hashes").combine_chunks())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        names, label = np.unique(root, return_inverse=True)
        parent = list(range(len(names)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        links: list[tuple[int, int]] = []
        step = max(1, 200_000 // max(1, len(right)))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            a, b = np.repeat(some, len(right)), np.tile(right, len(some))
            cross = root[a] != root[b]
            if i == j:
                cross &= a < b
            a, b = a[cross], b[cross]
            good = survivors(sig, sig, a, b, stops) if len(a) else a
            for x, y in zip(a[good].tolist(), b[good].tolist()):
                u, v = find(label[x]), find(label[y])
                if u != v and _alike(sets[bounds[x] : bounds[x + 1]], sets[bounds[y] : bounds[y + 1]], options.percent):
                    parent[u] = v
                    links.append((int(rep[x]), int(rep[y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("band_key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, options: NearDups = NearDups(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row with an id.

    Null and empty texts have no shingles and link with nothing. Rows of one id are in one component, whatever their texts, and each
    is kept if its id is the component's; every one of their texts links with others. Candidates are first the pairs of a bucket's
    least member with the others; buckets whose members are not in one component after that have all their pairs between components
    compared, so that no candidate is left out.

    A class is named by its least id, ``rep``. Of an id with several sets the classes may share that name, which is right for
    components; ``tag`` tells them apart where sets are compared, and is 0 for all other ids.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs, id_col, text_col).select("doc_id", "text")
    values = options.bands * options.rows

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = shingle_sets(batch.column(1), options.shingle)
        n = np.diff(bounds)
        sums = []
        for seed in (21, 22):
            total = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(tk.mix(hashes, seed), out=total[1:])
            sums.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
        sig = signatures(hashes, bounds, values)
        packed = pieces(sig.view(np.uint8).ravel(), np.arange(len(n) + 1) * 4 * values)
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *sums, packed], names=["doc_id", "n", "s1", "s2", "sig"])

    signed_all, path = saved(map_slices(texts, sign, "doc_id long, n long, s1 long, s2 long, sig binary"), "near-signatures")
    sets = ["n", "s1", "s2"]
    # ids with several sets; hardly any table has one
    several = signed_all.groupBy("doc_id").agg(F.min(F.struct(*sets)).alias("low"), F.max(F.struct(*sets)).alias("top")).where("low <> top")
    several, _ = saved(several.select("doc_id"), "near-several")

    def tagged(frame: DataFrame) -> DataFrame:
        known = several.select(F.col("doc_id").alias("rep"), F.lit(True).alias("many"))
        return frame.join(known, "rep", "left").withColumn("tag", F.when(F.col("many"), F.col("s1")).otherwise(F.lit(0).cast("long"))).drop("many")

    grouped = signed_all.where("n > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig"))
    classes, _ = saved(tagged(grouped).select(*sets, "rep", "tag", "sig"), "near-classes")
    rows, _ = saved(signed_all.select("doc_id", *sets), "near-rows")
    discard(spark, path)
    signed = classes.select("rep", "tag", "sig")
    own = rows.join(several, "doc_id", "left_semi").join(classes.select(*sets, "rep"), sets)
    ties, _ = saved(own.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "near-ties")

    # a bucket is a band's number and values
    width = 4 * options.rows
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(options.bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * width + 1, F.lit(width)))))
    banded = signed.select("rep", "tag", band.alias("band_key"))
    shared = banded.groupBy("band_key").agg(F.min("rep").alias("hub"), F.min_by("tag", "rep").alias("hub_tag"), F.max("rep").alias("top")).where("hub < top")
    members, members_path = saved(banded.join(shared.select("band_key", "hub", "hub_tag"), "band_key"), "near-buckets")
    free_shuffles(spark)

    # the sets of all that share a bucket; only their texts are read for it
    need, _ = saved(members.select(F.col("rep").alias("doc_id")).distinct(), "near-needed")

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = shingle_sets(batch.column(1), options.shingle)
        sig = signatures(hashes, bounds, values)
        packed = pieces(sig.view(np.uint8).ravel(), np.arange(len(bounds)) * 4 * values)
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(tk.mix(hashes, 21), out=total[1:])
        s1 = pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
        return pa.record_batch([batch.column(0), s1, pieces(hashes.view(np.uint8), bounds * 8), packed], names=["rep", "s1", "hashes", "own_sig"])

    wanted = texts.join(need, "doc_id", "left_semi").select("doc_id", "text")
    full = tagged(map_slices(wanted, collect, "rep long, s1 long, hashes binary, own_sig binary"))
    held = full.join(signed, ["rep", "tag"]).where("sig = own_sig").dropDuplicates(["rep", "tag"]).select("rep", "tag", "sig", "hashes")
    held, held_path = saved(held, "near-held")
    free_shuffles(spark)

    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("hub_tag").alias("tag_a"), F.col("rep").alias("b"), F.col("tag").alias("tag_b")).distinct()
    links, _ = saved(_linked(stars, held, options), "near-links")
    roots, _ = saved(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(ties)), "near-roots")

    placed = members.join(roots, members["rep"] == roots["node"], "left").select("band_key", "rep", "tag", F.coalesce("root", "rep").alias("root"))
    placed, placed_path = saved(placed, "near-placed")
    more = _crossing(placed, held, options)
    edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots, _ = saved(components(edges), "near-components")
    discard(spark, members_path, held_path, placed_path)

    placed = classes.select(*sets, "rep").join(roots, F.col("rep") == roots["node"], "left").select(*sets, F.coalesce("root", "rep").alias("component"))
    # rows of an id with several sets, one of which may be empty, follow their id
    ids = several.join(roots, F.col("doc_id") == roots["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("id_root"))
    component = F.coalesce("id_root", "component", "doc_id")
    found = rows.join(placed, sets, "left").join(ids, "doc_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
