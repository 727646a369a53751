"""Filter interaction audit: what every filter removes in every order, from one pass over the texts.

A document counts by its failure mask, one bit for each filter, so a part of the corpus is at most ``2 ** filters`` cells. A walk in
Gray-code order visits all subsets of filters by toggling one filter at a time: each cell holds how many of the active filters
it fails, and the running survivors change only by the cells whose counter leaves or reaches zero. The survivors of each subset are stored
once; a step of any order is the difference of two stored states.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WORD = r"[^\x20\x09-\x0D]+"
#: What is counted in every cell.
WEIGHTS = ("docs", "good", "toxic")
#: Rows without an id match no label; they are spread over so many keys.
SPREAD = 4096


@dataclass(frozen=True)
class Limits:
    least_words: int = 100
    least_distinct_percent: int = 80
    most_upper_percent: int = 10
    symbols: str = "[#$%&*|]"


def text_filters(limits: Limits = Limits()) -> dict[str, Column]:
    """Failure conditions over the columns ``text`` and ``words`` (its words, as an array)."""
    n_words = F.size("words").cast("long")
    n_distinct = F.size(F.array_distinct("words")).cast("long")
    n_upper = F.regexp_count("text", F.lit("[A-Z]")).cast("long")
    return {
        "A": n_words < limits.least_words,
        "B": 100 * n_distinct < limits.least_distinct_percent * n_words,
        "C": 100 * n_upper > limits.most_upper_percent * F.length("text").cast("long"),
        "D": F.col("text").rlike(limits.symbols),
    }


def _mask(filters: dict[str, Column]) -> Column:
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(filters.values())]
    return sum(bits[1:], bits[0]).cast("int")


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part_col: str = "lang") -> DataFrame:
    """``(part, mask, docs, good, toxic, copies, good_copies, toxic_copies)``: documents by part and mask of ``filters``, and how many of them are
    copies, that is, equal to the text of a smaller id anywhere in the table.

    A null text is empty and a null part is the empty string. A row without an id is no copy, makes none and has no label; rows that share an
    id don't make each other copies. A document is good (toxic) if any row of ``labels`` for its id has ``quality`` (``toxic``) 1.

    Texts are read once. What moves is a digest and a mask, counted per id before it joins the labels and per text before copies are told apart, so
    a text or an id that holds a third of all rows is a few rows by then.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    part = F.coalesce(docs[part_col].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), part.alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(filters).alias("mask"))
    slot = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0)
    counted = rows.withColumn("slot", slot).groupBy("id", "slot", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(labels["doc_id"].cast("long").alias("id"))
        .agg(F.max(F.when(labels["quality"] == 1, 1).otherwise(0)).alias("good"), F.max(F.when(labels["toxic"] == 1, 1).otherwise(0)).alias("toxic"))
        .withColumn("slot", F.lit(0).cast("long"))
    )
    joined = counted.join(known, ["id", "slot"], "left").fillna(0, ["good", "toxic"])
    groups = joined.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("at_least"),
    )
    groups = groups.withColumn("first", F.min("least").over(W.partitionBy("digest")))
    groups = groups.withColumn("copies", F.col("with_id") - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0))
    return groups.groupBy("part", "mask").agg(
        F.sum("n").alias("docs"),
        *[F.sum(F.col("n") * F.col(w)).alias(w) for w in WEIGHTS[1:]],
        F.sum("copies").alias("copies"),
        *[F.sum(F.col("copies") * F.col(w)).alias(f"{w}_copies") for w in WEIGHTS[1:]],
    )


def gray_walk(masks: np.ndarray, weights: np.ndarray, n_filters: int) -> np.ndarray:
    """Summed weights of the surviving cells, a row for each subset of filters."""
    failing = np.zeros(len(masks), dtype=np.int64)
    alive = weights.sum(axis=0)
    states = np.empty((1 << n_filters, weights.shape[1]), dtype=np.int64)
    states[0] = alive
    subset = 0
    for step in range(1, 1 << n_filters):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        toggled = (masks >> bit & 1) == 1
        if subset >> bit & 1:
            alive = alive - weights[toggled & (failing == 0)].sum(axis=0)
            failing[toggled] += 1
        else:
            failing[toggled] -= 1
            alive = alive + weights[toggled & (failing == 0)].sum(axis=0)
        states[subset] = alive
    return states


def states(found: DataFrame, n_filters: int) -> DataFrame:
    """One row per part: the survivors of every subset of filters, as arrays by subset, and for every filter the documents that fail it,
    that fail it alone, and that it removes over all orders. The last filter is that of copies. A part is at most as many rows as there
    are masks."""
    last = n_filters - 1
    chances = [factorial(k) * factorial(last - k) for k in range(n_filters)]

    def walk(key, table):
        column = lambda name: table.column(name).to_numpy()
        copies = np.stack([column(c) for c in ("copies", "good_copies", "toxic_copies")], axis=1)
        rest = np.stack([column(c) for c in WEIGHTS], axis=1) - copies
        masks = np.concatenate([column("mask"), column("mask") | 1 << last])
        weights = np.concatenate([rest, copies])
        survivors = gray_walk(masks, weights, n_filters)
        fails = [int(weights[masks >> f & 1 == 1, 0].sum()) for f in range(n_filters)]
        alone = [int(weights[masks == 1 << f, 0].sum()) for f in range(n_filters)]
        total = [
            sum(chances[s.bit_count()] * int(survivors[s, 0] - survivors[s | 1 << f, 0]) for s in range(1 << n_filters) if not s >> f & 1)
            for f in range(n_filters)
        ]
        out = [[key[0].as_py()], *([survivors[:, i].tolist()] for i in range(3)), [fails], [alone], [total]]
        names = ["part", *WEIGHTS, "fails", "alone", "total"]
        return pa.table([pa.array(v, pa.string() if n == "part" else pa.list_(pa.int64())) for n, v in zip(names, out)], names=names)

    schema = "part string, docs array<long>, good array<long>, toxic array<long>, fails array<long>, alone array<long>, total array<long>"
    return found.groupBy("part").applyInArrow(walk, schema)


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of documents that ``filter_order`` gives from left to right:
    ``kept`` after the step, ``removed`` in it, ``redundant`` (fail its filter but are gone already), ``unique_fails`` (fail no other filter), ``good_lost`` and
    ``toxic_lost`` (removed in it and labelled so) and ``shapley`` (what its filter removes, summed over all orders). An empty table has no
    part and so no row. See ``cells`` for nulls and repeated rows."""
    filters = text_filters(limits)
    letters = [*filters, "E"]
    by_part = states(cells(docs, labels, filters, part_col), len(letters))
    orders = list(permutations(range(len(letters))))
    name = ["".join(letters[f] for f in order) for order in orders for _ in order]
    step = np.array([k + 1 for order in orders for k in range(len(order))], dtype=np.int32)
    f = np.array(orders).ravel()
    before = np.array([sum(1 << g for g in order[:k]) for order in orders for k in range(len(order))])
    after = before + (1 << f)

    def differences(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = {c: np.array(v) for c, v in row.items() if c != "part"}
                removed, good, toxic = (at[w][before] - at[w][after] for w in WEIGHTS)
                numbers = [at["docs"][after], removed, at["fails"][f] - removed, at["alone"][f], good, toxic, at["total"][f]]
                yield pa.record_batch([pa.array([row["part"]] * len(f), pa.string()), pa.array(name), pa.array(step), *map(pa.array, numbers)], names=columns)

    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return by_part.mapInArrow(differences, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns[3:]))
