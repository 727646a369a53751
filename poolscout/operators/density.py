"""Density clusters of fingerprints under the Tanimoto distance, and the components that they rest on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SMALL_ROWS, cut
from .neighbours import _joining, distinct_sets, near_links, set_members


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, to)``: every node of the edges of a task and one that stands for all that are joined with it."""
    parts = [*batches]
    if parts:
        nodes = pa.concat_arrays([b.column(c) for c in ("a", "b") for b in parts]).dictionary_encode()
        place, group = nodes.indices.to_numpy().astype(np.int64), np.arange(len(nodes.dictionary))
        for _ in _joining(place[: len(place) // 2], place[len(place) // 2 :], group):
            pass
        yield pa.record_batch([nodes.dictionary, nodes.dictionary.take(pa.array(group))], names=["a", "to"])


def connected_components(pairs: DataFrame, most_rounds: int = 200, small: int = SMALL_ROWS) -> DataFrame:
    """``(id, component)`` for every node of the undirected ``pairs(a, b)``; a component is named by its least node.

    In each round every node hands itself to the neighbour, or itself, that a hash puts first; the nodes that met become one, and edges inside them
    vanish. The hash changes with the round, so no order of ids makes rounds many: each leaves a share of the nodes only. Up to ``small`` edges are left to one task.
    """
    edges = cut(pairs.where("a <> b").select("a", "b").distinct())
    names = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    names = cut(names.withColumn("node", F.col("id")))
    for turn in range(most_rounds):
        n = edges.count()
        if n <= small:
            if n:
                kind = edges.schema["a"].dataType.simpleString()
                to = edges.repartition(1).mapInArrow(_settle, f"a {kind}, to {kind}")
                names = cut(names.join(to.withColumnRenamed("a", "node"), "node", "left").select("id", F.coalesce("to", "node").alias("node")))
            return cut(names.join(names.groupBy("node").agg(F.min("id").alias("component")), "node").select("id", "component"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        draw = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        to = cut(both.groupBy("a").agg(F.min(draw("b")).alias("best")).select("a", F.least("best", draw("a"))["n"].alias("to")))
        names = cut(names.join(to.withColumnRenamed("a", "node"), "node", "left").select("id", F.coalesce("to", "node").alias("node")))
        moved = edges.join(to, "a").select(F.col("to").alias("a"), F.col("b").alias("old"))
        moved = moved.join(to.select(F.col("a").alias("old"), F.col("to").alias("b")), "old").where("a <> b")
        edges = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    raise RuntimeError("the components did not settle")


def density_clusters(items: DataFrame, length: int, max_distance: float, min_items: int) -> DataFrame:
    """``(id, cluster_id, core)`` of ``items(id, bits)``: an item is core if ``min_items`` items, itself and copies included, lie within ``max_distance``. Core items within
    that distance of each other are one cluster, named by its least core id. Another item near a core one joins the cluster of the least core id near it; the rest
    is noise, with no cluster. Copies of an item share its neighbours and so are in the same place. Items without a bit
    are noise, and those whose bits are NULL are left out.

    Copies are one set with a weight, so links exist between different sets only. Where long sets are compared in blocks, a block gives out counts, all links of sets that are
    not seen to be core, and of the others those that join, so a large group of near copies is not written out as pairs.
    """
    items = cut(items.select("id", "bits"))
    sets = cut(distinct_sets(items))
    weighted = sets.join(sets.groupBy("id").agg(F.sum("members").alias("weight")), "id")
    links, around = near_links(weighted, length, max_distance, min_items)
    both = links.union(links.select("b", "a"))
    enough = (F.size("bits") > 0) & (F.col("members") + F.coalesce("near", F.lit(0)) >= min_items)
    counted = cut(sets.join(around, "id", "left").select("id", enough.alias("core")))
    cores = counted.where("core").select("id")
    linked = links.join(cores.select(F.col("id").alias("a")), "a", "left_semi").join(cores.select(F.col("id").alias("b")), "b", "left_semi")
    found = connected_components(linked.select("a", "b"))
    named = cut(cores.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id")))
    near_core = both.join(named.select(F.col("id").alias("b"), "cluster_id"), "b").groupBy(F.col("a").alias("id"))
    border = near_core.agg(F.min_by("cluster_id", "b").alias("border_id"))
    placed = counted.join(named, "id", "left").join(border, "id", "left").select(
        F.col("id").alias("set_id"), F.coalesce("cluster_id", "border_id").alias("cluster_id"), "core"
    )
    return set_members(items).join(placed, "set_id").select("id", "cluster_id", "core")
