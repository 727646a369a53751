"""Mini-batch k-means: centres move by small batches, each at a rate that falls with the rows it has seen."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..session import scratch_path

#: Rows compared with all centres at a time.
STEP = 4096


@dataclass(frozen=True)
class MiniBatch:
    """``rounds`` batches of about ``batch_size`` rows, ``stretch`` of them in one task. ``starts`` times k-means++ on ``init_size`` rows gives the first centres; with 0 starts these are the first rows of
    the draw. A stretch whose last round moves no centre by ``tolerance`` ends the fit."""

    batch_size: int = 1024
    rounds: int = 100
    init_size: int = 3072
    starts: int = 3
    tolerance: float = 0.0
    stretch: int = 25


def _features(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if centres.size <= 64:  # differences are exact where a product of large numbers is not
        return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
    return (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, the lower one of equals."""
    return np.concatenate([_distances(x[i : i + STEP], centres).argmin(1) for i in range(0, len(x), STEP)]) if len(x) else np.empty(0, np.int64)


def _spread_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.integers(len(x)))]
    least = _distances(x, x[chosen]).min(1)
    while len(chosen) < k:
        weight = np.maximum(least, 0.0)
        total = weight.sum()
        chosen.append(int(rng.choice(len(x), p=weight / total)) if total > 0 else int(rng.integers(len(x))))
        least = np.minimum(least, _distances(x, x[chosen[-1:]]).min(1))
    return x[chosen]


def first_centres(sample: np.ndarray, k: int, starts: int, seed: int) -> np.ndarray:
    """The best of several k-means++ starts, by the summed distance of the sample after a few full rounds on it."""
    if not starts:
        return sample[:k].copy()
    best, least = None, np.inf
    for start in range(starts):
        centres = _spread_centres(sample, k, np.random.default_rng((seed, start)))
        for _ in range(5):
            of = nearest(sample, centres)
            sums, counts = np.zeros_like(centres), np.bincount(of, minlength=k)
            np.add.at(sums, of, sample)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        cost = _distances(sample, centres).min(1).sum()
        if cost < least:
            best, least = centres, cost
    return best


def drawn_batches(pool: DataFrame, n: int, options: MiniBatch, seed: int) -> DataFrame:
    """``(batch, id, features)`` of all rounds, drawn in one pass: a hash of the id deals an epoch's rows into batches, every epoch by another hash. The table is as large as
    the batches are, and sorted by batch, so that a round reads its own rows."""
    per_epoch = max(1, n // options.batch_size)
    places = []
    for epoch in range(-(-options.rounds // per_epoch)):
        batch = F.floor(uniform(F.col("id"), seed + 1 + epoch) * per_epoch).cast("long") + epoch * per_epoch
        places.append(F.when(batch < options.rounds, batch))
    rows = pool.withColumn("batch", F.explode(F.array_compact(F.array(*places)))).select("batch", "id", "features")
    path = scratch_path(pool.sparkSession, "batches")
    rows.repartitionByRange("batch").sortWithinPartitions("batch").write.parquet(path)
    return pool.sparkSession.read.schema(rows.schema).parquet(path)


def _by_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The features of one batch after another, from rows sorted by batch."""
    held, name = [], None
    for part in parts:
        numbers = part.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
            if lo == hi:
                continue
            if held and numbers[lo] != name:
                yield np.concatenate(held)
                held = []
            held.append(_features(part.column(2).slice(lo, hi - lo)))
            name = numbers[lo]
    if held:
        yield np.concatenate(held)


def fit_minibatch(pool: DataFrame, n_clusters: int = 100, options: MiniBatch = MiniBatch(), seed: int = 42) -> np.ndarray:
    """Centres (clusters, features) of ``pool(id, features)``. With fewer rows than clusters there are as many centres as rows.

    A centre that has seen ``N`` rows and gets ``m`` of a batch moves by ``(sum - m * centre) / (N + m)``. Each batch needs the centres that the one before left, and is small by its
    parameter, so one task streams a stretch of batches and hands over its centres, which are what a lost stretch starts again from. What grows with the pool, the draw and the
    assignment, is spread. Draws are hashes of ids, so a fit does not depend on how rows are dealt out.
    """
    pool = pool.select("id", F.col("features").cast("array<double>").alias("features")).where("features IS NOT NULL")
    n = pool.count()
    if not n:
        raise ValueError("there are no rows to cluster")
    wanted = max(n_clusters, options.init_size if options.starts else n_clusters)
    sample = pool.orderBy(uniform(F.col("id"), seed), "id").limit(wanted).collect()
    sample = np.array([r["features"] for r in sample], dtype=np.float64)
    k = min(n_clusters, len(sample))
    centres, seen = first_centres(sample, k, options.starts, seed), np.zeros(k)
    batches = drawn_batches(pool, n, options, seed)
    for first in range(0, options.rounds, options.stretch):
        stop = min(first + options.stretch, options.rounds)

        def run(parts: Iterator[pa.RecordBatch], centres=centres, seen=seen) -> Iterator[pa.RecordBatch]:
            moved = 0.0
            for x in _by_batch(parts):
                of = nearest(x, centres)
                m, sums = np.bincount(of, minlength=k).astype(float), np.zeros_like(centres)
                np.add.at(sums, of, x)
                seen = seen + m
                step = np.where(m[:, None] > 0, (sums - m[:, None] * centres) / np.maximum(seen, 1.0)[:, None], 0.0)
                centres, moved = centres + step, float(np.abs(step).max())
            columns = [pa.array(centres.tolist(), pa.list_(pa.float64())), pa.array(seen), pa.array([moved] * k), pa.array(range(k), pa.int64())]
            yield pa.record_batch(columns, names=["centre", "seen", "moved", "i"])

        rows = batches.where(F.col("batch").between(first, stop - 1)).coalesce(1).sortWithinPartitions("batch", "id")
        out = sorted(rows.mapInArrow(run, "centre array<double>, seen double, moved double, i long").collect(), key=lambda r: r["i"])
        centres, seen = np.array([r["centre"] for r in out]), np.array([r["seen"] for r in out])
        if out[0]["moved"] < options.tolerance:
            break
    return centres


def assign_clusters(pool: DataFrame, centres: np.ndarray) -> DataFrame:
    """``pool`` with ``cluster_id``, the index of the nearest centre; NULL where features are. One pass without a shuffle."""
    shared = pool.sparkSession.sparkContext.broadcast(centres)  # clusters x features

    @F.pandas_udf("int")
    def of(features: pd.Series) -> pd.Series:
        known = features.notna().to_numpy()
        out = pd.Series([None] * len(features), dtype="Int32")
        if known.any():
            out[known] = nearest(np.vstack(features[known].to_numpy()).astype(float), shared.value).astype("int32")
        return out

    return pool.withColumn("cluster_id", of(F.col("features").cast("array<double>")))

