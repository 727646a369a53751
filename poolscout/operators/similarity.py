"""Picking diverse leaders from fingerprints and assigning items to them.

Comparisons run as matrix products inside map tasks against bounded blocks of leaders. No pair of items is ever
emitted, so a bit, or a group of copies, shared by a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .neighbours import greedy_independent, neighbour_pairs
from .ordered import top_n

#: Leaders held by one task at a time: a block of 4096 x 2048 floats is 32 MB.
BLOCK = 4096
#: Map stages chained before the lineage is cut.
CHAIN = 16
#: Blocks of distinct items up to which leaders are settled block by block.
MOST_BLOCKS = 64


def _matrix(bits, length: int) -> np.ndarray:
    out = np.zeros((len(bits), length), dtype=np.float32)
    for i, positions in enumerate(bits):
        out[i, np.asarray(positions, dtype=np.int64)] = 1.0
    return out


def _similarity(items: np.ndarray, leaders: np.ndarray) -> np.ndarray:
    # counts are exact in single precision, their quotient is not
    shared = (items @ leaders.T).astype(np.float64)
    union = items.sum(1, dtype=np.float64)[:, None] + leaders.sum(1, dtype=np.float64)[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared, dtype=np.float64), where=union > 0)


def _slices(frame: pd.DataFrame, rows: int = 2048) -> Iterator[pd.DataFrame]:
    for start in range(0, len(frame), rows):
        yield frame.iloc[start : start + rows]


def _settle(length: int, floor: float):
    """One-by-one pass over a bounded block, in one task."""

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(frames)).sort_values("id").reset_index(drop=True)
        matrix = _matrix(block["bits"], length)
        near = np.zeros(len(block), dtype=bool)
        chosen = []
        for i in range(len(block)):
            if not near[i]:
                chosen.append(i)
                near |= _similarity(matrix, matrix[i : i + 1])[:, 0] >= floor
        yield block.iloc[chosen]

    return settle


def pick_leaders(
    items: DataFrame, length: int, max_distance: float = 0.65, max_picks: int | None = None, block: int = BLOCK, method: str = "auto"
) -> DataFrame:
    """Sphere exclusion in id order: an item is a leader unless an earlier leader lies within ``max_distance``.

    ``rounds`` finds all pairs within the distance and lets every item decide once its smaller neighbours have; the number of rounds grows with the logarithm of the
    items in a random order of ids. ``blocks`` needs no pairs, but a round for each ``block`` leaders. ``auto`` takes blocks up to ``MOST_BLOCKS`` blocks of
    distinct items, and beyond it, if no number of picks ends it early, rounds. All give the same leaders.

    Each round of blocks settles the ``block`` smallest open ids among themselves and then removes, in one map pass, every open
    item near the new leaders. That equals the one-by-one pass, because all smaller ids are settled before. Returns
    ``(id, bits)`` of the leaders.
    """
    spark = items.sparkSession
    floor = 1.0 - max_distance
    if method not in ("auto", "rounds", "blocks"):
        raise ValueError(f"unknown method {method!r}")
    open_items = cut(items.filter(F.col("bits").isNotNull()).groupBy("bits").agg(F.min("id").alias("id")).select("id", "bits"))
    if method == "rounds" or method == "auto" and max_picks is None and open_items.count() > MOST_BLOCKS * block:
        chosen = greedy_independent(open_items, neighbour_pairs(open_items, length, max_distance))
        return top_n(open_items.join(chosen, "id"), max_picks, [F.col("id")]) if max_picks is not None else open_items.join(chosen, "id")
    picked: DataFrame | None = None
    n_picked = 0
    while True:
        head = cut(open_items.orderBy("id").limit(block))
        ends = head.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).first()
        if not ends["n"]:
            break
        new = cut(head.coalesce(1).mapInPandas(_settle(length, floor), head.schema).orderBy("id"))
        if max_picks is not None:
            new = cut(new.orderBy("id").limit(max_picks - n_picked))
        leaders = new.collect()
        n_picked += len(leaders)
        picked = new if picked is None else cut(picked.unionByName(new))
        if max_picks is not None and n_picked >= max_picks or ends["n"] < block:
            break
        shared = spark.sparkContext.broadcast(_matrix([r["bits"] for r in leaders], length))

        def far_from_leaders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for part in _slices(frame):
                    yield part[(_similarity(_matrix(part["bits"], length), shared.value) < floor).all(axis=1)]

        later = open_items.filter(F.col("id") > ends["last"])
        open_items = cut(later.mapInPandas(far_from_leaders, open_items.schema))
    return picked if picked is not None else items.select("id", "bits").limit(0)


def _blocks(leaders: DataFrame, block: int) -> Iterator[list]:
    """Leaders in id order, a bounded block at a time."""
    last = None
    while True:
        rest = leaders if last is None else leaders.filter(F.col("id") > last)
        rows = rest.orderBy("id").limit(block).collect()
        if rows:
            yield rows
        if len(rows) < block:
            return
        last = rows[-1]["id"]


def assign_to_leaders(items: DataFrame, leaders: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """Most similar leader per item (the smaller id on ties); a leader belongs to itself. ``(id, leader, similarity)``."""
    spark = items.sparkSession
    state = items.filter(F.col("bits").isNotNull()).select(
        "id", "bits", F.lit(None).cast(items.schema["id"].dataType).alias("leader"), F.lit(-1.0).alias("similarity")
    )
    schema = state.schema
    for i, rows in enumerate(_blocks(leaders, block), start=1):
        shared = spark.sparkContext.broadcast(
            (np.array([r["id"] for r in rows]), _matrix([r["bits"] for r in rows], length))
        )

        def best_in_block(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for frame in frames:
                for part in _slices(frame):
                    part = part.copy()
                    sims = _similarity(_matrix(part["bits"], length), matrix)
                    best = sims.argmax(axis=1)
                    value = sims[np.arange(len(part)), best]
                    own = part["id"].isin(ids).to_numpy()
                    value = np.where(own, 2.0, value)
                    leader = np.where(own, part["id"].to_numpy(dtype=object), ids[best].astype(object))
                    better = value > part["similarity"].to_numpy()
                    part["leader"] = np.where(better, leader, part["leader"].to_numpy(dtype=object))
                    part["similarity"] = np.where(better, value, part["similarity"])
                    yield part

        state = state.mapInPandas(best_in_block, schema)
        if i % CHAIN == 0:
            state = cut(state)
    return state.select("id", "leader", F.least(F.col("similarity"), F.lit(1.0)).alias("similarity"))


def within_distance(items: DataFrame, leaders: DataFrame, length: int, max_distance: float, block: int = BLOCK) -> DataFrame:
    """Every (leader, item) pair within ``max_distance``: ``(leader, id, similarity)``. At most leaders x items rows; leaders lie
    apart from one another, so an item is near few of them."""
    spark = items.sparkSession
    kind = items.schema["id"].dataType.simpleString()
    floor = 1.0 - max_distance
    found: DataFrame | None = None
    for rows in _blocks(leaders, block):
        shared = spark.sparkContext.broadcast(
            (np.array([r["id"] for r in rows]), _matrix([r["bits"] for r in rows], length))
        )

        def near(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for frame in frames:
                for part in _slices(frame):
                    sims = _similarity(_matrix(part["bits"], length), matrix)
                    row, col = np.nonzero(sims >= floor)
                    yield pd.DataFrame(
                        {"leader": ids[col], "id": part["id"].to_numpy()[row], "similarity": sims[row, col]}
                    )

        pairs = items.filter(F.col("bits").isNotNull()).select("id", "bits").mapInPandas(
            near, f"leader {kind}, id {kind}, similarity double"
        )
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return items.select(F.col("id").alias("leader"), "id", F.lit(0.0).alias("similarity")).limit(0)
    return found


def cluster_classes(assigned: DataFrame) -> DataFrame:
    """``(id, class)``: clusters of one are singletons, clusters of the largest size are large, the rest mid."""
    sizes = assigned.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.max("size").alias("m")).scalar()
    kind = F.when(F.col("size") == 1, "singleton").when(F.col("size") == largest, "large").otherwise("mid")
    return assigned.join(sizes.select("leader", kind.alias("class")), "leader").select("id", "class")
