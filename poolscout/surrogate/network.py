"""Feed-forward networks of a fixed, small size, trained by data-parallel gradient descent.

A step is one batch: tasks add up the gradients of their rows, the JVM adds the tasks' sums (the driver those of a few tasks), and the driver moves the weights, which is all that it holds. Batches are
dealt by a hash of the id and grow with the rows, so an epoch has a bounded number of steps. Rows are written once as matrices, by batch, so that a step reads the rows of its
batch only. While all training rows are small enough for one task, the same steps run there without a job each. Draws (first weights, batches, held-out rows, units left out) are hashes or seeded, so a fit does not depend on how rows are dealt out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform, uniform_value
from ..session import cut, scratch_path
from .base import Surrogate, no_variance, vectors

LEAST_VARIANCE = 1e-6
#: Batches of an epoch at most, and rows of a batch at least.
MOST_BATCHES, BATCH_ROWS = 64, 128
#: Rows, and numbers in them, that a network sees at once: what the way through its layers holds grows with them.
CHUNK_ROWS, CHUNK_CELLS = 4096, 1 << 19
#: Tasks of a step up to which the driver adds up their sums itself, which are as long as the weights; sums of more tasks meet in the JVM first.
FEW_TASKS = 16
#: Batch numbers of the held-out rows and of rows without an id, which no step sees.
HELD, NO_BATCH = -1, -2


@dataclass(frozen=True)
class Network:
    hidden: tuple[int, ...] = (100, 100)
    activation: str = "relu"
    #: Two outputs, of which the second gives the variance, instead of one.
    variance: bool = False
    dropout: float = 0.0
    epochs: int = 50
    rate: float = 0.01
    decay: float = 1e-4
    held_out: float = 0.2
    patience: int = 5
    #: Numbers in the training rows up to which one task trains.
    local_cells: int = 1 << 23


def _relu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(z, 0.0), (z > 0).astype(float)


def _tanh(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(z)
    return h, 1.0 - h * h


ACTIVATIONS: dict[str, Callable] = {"relu": _relu, "tanh": _tanh, "linear": lambda z: (z, np.ones_like(z))}


def _shapes(dims: int, net: Network) -> list[tuple[int, int]]:
    sizes = [dims, *net.hidden, 2 if net.variance else 1]
    return list(zip(sizes, sizes[1:]))


def _layers(flat: np.ndarray, dims: int, net: Network) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in _shapes(dims, net):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def first_weights(dims: int, net: Network, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([rng.standard_normal(a * b) * np.sqrt(2.0 / a), np.zeros(b)]) for a, b in _shapes(dims, net)])


def unit_masks(net: Network, key: int, seed: int) -> list[np.ndarray]:
    """Which units of each hidden layer stay in a pass, scaled so that sums keep their size; from the hash of pass and unit."""
    keep, at, total = [], 0, sum(net.hidden)
    for size in net.hidden:
        drawn = np.array([uniform_value(key * total + at + u, seed) >= net.dropout for u in range(size)])
        keep.append(drawn / (1.0 - net.dropout))
        at += size
    return keep


def forward(flat: np.ndarray, x: np.ndarray, net: Network, masks: list | None = None) -> tuple[np.ndarray, list]:
    """Outputs, and what the way back needs: inputs and slopes of each layer."""
    act, kept, h = ACTIVATIONS[net.activation], [], x
    layers = _layers(flat, x.shape[1], net)
    for i, (w, b) in enumerate(layers[:-1]):
        value, slope = act(h @ w + b)
        if masks is not None:
            value, slope = value * masks[i], slope * masks[i]
        kept.append((h, slope))
        h = value
    w, b = layers[-1]
    return h @ w + b, [*kept, (h, None)]


def spread(raw: np.ndarray) -> np.ndarray:
    """Softplus, so that a variance is positive."""
    return np.logaddexp(0.0, raw) + LEAST_VARIANCE


def loss_and_gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray, net: Network, masks: list | None = None) -> np.ndarray:
    """Summed gradient of the rows, then their summed loss and their number, in one array."""
    out, kept = forward(flat, x, net, masks)
    if net.variance:
        v = spread(out[:, 1])
        gap = out[:, 0] - y
        loss = 0.5 * (np.log(v) + gap * gap / v)
        back = np.stack([gap / v, 0.5 * (1.0 / v - gap * gap / (v * v)) / (1.0 + np.exp(-out[:, 1]))], axis=1)
    else:
        gap = out[:, 0] - y
        loss, back = 0.5 * gap * gap, gap[:, None]
    grads = []
    layers = _layers(flat, x.shape[1], net)
    for i in reversed(range(len(layers))):
        h, _ = kept[i]
        grads.append(np.concatenate([(h.T @ back).ravel(), back.sum(0)]))
        if i:
            back = (back @ layers[i][0].T) * kept[i - 1][1]
    return np.concatenate([*reversed(grads), [loss.sum(), len(y)]])


class _Adam:
    """Moves weights against a mean gradient, at a rate that falls to a tenth over the steps."""

    def __init__(self, net: Network, steps: int, size: int):
        self.net, self.steps, self.m, self.v, self.t = net, max(steps, 1), np.zeros(size), np.zeros(size), 0

    def move(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        g = gradient + self.net.decay * flat
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        rate = self.net.rate * (1.0 - 0.9 * min(self.t / self.steps, 1.0))
        return flat - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def train(flat: np.ndarray, net: Network, batches: int, seed: int, step: Callable, held: Callable | None) -> np.ndarray:
    """The epochs. ``step(batch, flat, masks)`` gives gradient, loss and number of a batch; ``held(flat)`` loss and number of the held-out rows, whose
    best weights are kept, and which end the fit when they have not got better for ``patience`` epochs."""
    adam, best, least, worse = _Adam(net, net.epochs * batches, len(flat)), flat, np.inf, 0
    for epoch in range(net.epochs):
        for b in range(batches):
            masks = unit_masks(net, adam.t, seed + 1) if net.dropout else None
            added = step((b + epoch) % batches, flat, masks)
            if added[-1]:
                flat = adam.move(flat, added[:-2] / added[-1])
        if held is None:
            best = flat
            continue
        loss, n = held(flat)
        if n and loss / n < least:
            best, least, worse = flat, loss / n, 0
        else:
            worse += 1
            if worse >= net.patience:
                break
    return best


def chunk_rows(dims: int) -> int:
    return max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(dims, 1)))


def in_chunks(of: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums that ``of`` makes of rows and targets, a chunk of rows at a time."""
    per = chunk_rows(x.shape[1])
    total = of(x[:per], y[:per])
    for at in range(per, len(x), per):
        total = total + of(x[at : at + per], y[at : at + per])
    return total


def _finish_sums(flat: np.ndarray, x: np.ndarray, y: np.ndarray, net: Network) -> np.ndarray:
    """Sums from which the output layer is finished: products of the last hidden layer and the target, or residuals by their variance."""
    out, kept = forward(flat, x, net)
    if not net.variance:
        h = np.hstack([kept[-1][0], np.ones((len(x), 1)), y[:, None]])
        return (h.T @ h).ravel()
    v, gap = spread(out[:, 1]), y - out[:, 0]
    return np.array([(gap / v).sum(), (1.0 / v).sum(), (gap * gap / v).sum(), len(y)])


def _solved(sums: np.ndarray, flat: np.ndarray, net: Network) -> np.ndarray:
    """One output: the last layer as the least-squares solution for its inputs."""
    size = int(np.sqrt(len(sums)))
    products = sums.reshape(size, size)
    weights = np.linalg.lstsq(products[:-1, :-1], products[:-1, -1], rcond=1e-12)[0]
    return np.concatenate([flat[: len(flat) - len(weights)], weights])


class NetworkSurrogate(Surrogate):
    """Means; with ``variance`` also variances from a second output, fitted by likelihood.

    After the descent the last layer of a one-output network is solved by least squares. Of two outputs the mean is shifted to where the residuals, weighted by
    their variances, add up to zero, and the variance is scaled to the squared residuals of the held-out rows (of all rows, if none is held out).
    """

    def __init__(self, seed: int = 42, **options):
        self.net, self.seed = Network(**options), seed
        self.provides = frozenset({"means", "vars"}) if self.net.variance else frozenset({"means"})
        self.flat = self.x_mean = self.x_sd = None
        self.mu, self.sd, self.shift, self.scale = 0.0, 1.0, 0.0, 1.0

    def fit(self, rows: DataFrame) -> "NetworkSurrogate":
        net, seed = self.net, self.seed
        held = uniform(F.col("id"), seed + 2) < net.held_out
        data = cut(rows.select("id", F.col("features").cast("array<double>").alias("features"), F.col("score").cast("double").alias("score"), held.alias("held")))
        if data.isEmpty():
            raise ValueError("there are no labelled rows to fit on")
        stats = data.agg(
            F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"), F.count("score").alias("n"), F.sum(F.col("held").cast("long")).alias("h"),
            F.count(F.lit(1)).alias("rows"), Summarizer.metrics("mean", "std").summary(vectors(F.col("features"))).alias("x"),
        ).first()
        n = stats["n"]
        self.mu, self.sd = stats["mu"], stats["sd"] or 1.0
        self.x_mean, sd = stats["x"]["mean"].toArray(), stats["x"]["std"].toArray()
        self.x_sd = np.where(sd > 0, sd, 1.0)
        dims = len(self.x_mean)
        self.flat = first_weights(dims, net, seed)
        use_held = 0 < stats["h"] < n
        batches = min(MOST_BATCHES, max(1, (n - stats["h"] if use_held else n) // BATCH_ROWS))
        batch = F.floor(uniform(F.col("id"), seed + 3) * batches).cast("int")
        batch = F.when(F.col("held"), HELD).otherwise(batch) if use_held else batch
        data = data.select("id", "features", "score", F.coalesce(batch, F.lit(NO_BATCH)).alias("batch"))
        local = stats["rows"] * dims <= net.local_cells
        summed = self._in_one_task(data, stats["rows"], batches, use_held) if local else self._in_jobs(data, batches, use_held)
        if net.variance:
            gap, weight, square, count = summed[4:] if use_held else summed[:4]
            self.shift = summed[0] / summed[1]
            self.scale = max((square - 2 * self.shift * gap + self.shift**2 * weight) / count, LEAST_VARIANCE)
        elif not net.dropout:
            self.flat = _solved(summed, self.flat, net)
        return self

    def _reader(self) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        x_mean, x_sd, mu, sd = self.x_mean, self.x_sd, self.mu, self.sd

        def read(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Scaled rows and targets, and the batch of each."""
            sizes = pc.list_value_length(rows.column("features"))
            if sizes.null_count or (sizes.to_numpy() != len(x_mean)).any():
                raise ValueError(f"every row must have {len(x_mean)} features")
            x = rows.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(x_mean))
            return (x - x_mean) / x_sd, (rows.column("score").to_numpy(zero_copy_only=False) - mu) / sd, rows.column("batch").to_numpy()

        return read

    def _in_one_task(self, data: DataFrame, n: int, batches: int, use_held: bool) -> np.ndarray:
        net, seed, start, read, dims = self.net, self.seed, self.flat, self._reader(), len(self.x_mean)

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y, of, at = np.empty((n, dims)), np.empty(n), np.empty(n, np.int64), 0
            for frame in frames:
                to = at + frame.num_rows
                x[at:to], y[at:to], of[at:to] = read(frame)
                at = to
            ends = np.searchsorted(of, np.arange(HELD, batches + 1))  # rows come by batch
            parts = {b: (x[i:j], y[i:j]) for b, i, j in zip(range(HELD, batches), ends, ends[1:])}
            flat = train(
                start, net, batches, seed, lambda b, w, masks: in_chunks(lambda p, q: loss_and_gradient(w, p, q, net, masks), *parts[b]),
                (lambda w: in_chunks(lambda p, q: loss_and_gradient(w, p, q, net), *parts[HELD])[-2:]) if use_held else None,
            )
            kinds = [(x, y), parts[HELD]] if net.variance and use_held else [(x, y)]
            sums = np.concatenate([in_chunks(lambda p, q: _finish_sums(flat, p, q, net), *kind) for kind in kinds])
            yield pa.record_batch([pa.array([flat.tolist()]), pa.array([sums.tolist()])], names=["flat", "sums"])

        out = data.coalesce(1).sortWithinPartitions("batch", "id").mapInArrow(run, "flat array<double>, sums array<double>").first()
        self.flat = np.array(out["flat"])
        return np.array(out["sums"])

    def _in_jobs(self, data: DataFrame, batches: int, use_held: bool) -> np.ndarray:
        net, read, dims, spark = self.net, self._reader(), len(self.x_mean), data.sparkSession
        per, schema = chunk_rows(len(self.x_mean)), "x binary, y binary"

        def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows, which come by batch, as matrices of rows of one batch."""
            for frame in frames:
                x, y, of = read(frame)
                ends = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in zip(ends, ends[1:]):
                    for at in range(a, b, per):
                        to = min(at + per, b)
                        columns = [pa.array([x[at:to].tobytes()], pa.binary()), pa.array([y[at:to].tobytes()], pa.binary()), pa.array(of[at : at + 1], pa.int32())]
                        yield pa.record_batch(columns, names=["x", "y", "batch"])

        path = scratch_path(spark, "batches")
        dealt = data.repartitionByRange("batch", F.xxhash64("id")).sortWithinPartitions("batch", "id")
        dealt.mapInArrow(pack, f"{schema}, batch int").write.partitionBy("batch").parquet(path)
        found = [r["batch"] for r in spark.read.parquet(path).select("batch").distinct().collect()]
        packs = {b: spark.read.schema(schema).parquet(f"{path}/batch={b}") for b in found}
        few = {id(rows) for rows in packs.values() if rows.rdd.getNumPartitions() <= FEW_TASKS}

        def total(rows: DataFrame | None, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            size = len(of(np.zeros((1, dims)), np.zeros(1)))
            if rows is None:
                return np.zeros(size)

            def add_up(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums = np.zeros(size)
                for frame in frames:
                    for x, y in zip(frame.column("x"), frame.column("y")):
                        sums += of(np.frombuffer(x.as_buffer()).reshape(-1, dims), np.frombuffer(y.as_buffer()))
                yield pa.record_batch([pa.array([sums.tolist()])], names=["s"])

            sums = rows.mapInArrow(add_up, "s array<double>")
            if id(rows) in few:
                return np.sum([np.array(r["s"]) for r in sums.collect()], axis=0)  # no shuffle, whose planning takes longer than a small step
            return sums.agg(Summarizer.sum(array_to_vector("s")).alias("s")).first()["s"].toArray()

        def step(b: int, flat: np.ndarray, masks: list | None) -> np.ndarray:
            return total(packs.get(b), lambda x, y: loss_and_gradient(flat, x, y, net, masks))

        def held(flat: np.ndarray) -> np.ndarray:
            return total(packs.get(HELD), lambda x, y: loss_and_gradient(flat, x, y, net))[-2:]

        self.flat = flat = train(self.flat, net, batches, self.seed, step, held if use_held else None)
        finish = lambda rows: total(rows, lambda x, y: _finish_sums(flat, x, y, net))
        every = finish(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path))
        return np.concatenate([every, finish(packs.get(HELD))]) if net.variance and use_held else every

    def outputs(self, x: np.ndarray, masks: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of rows of raw features."""
        per = chunk_rows(x.shape[1])
        out = np.concatenate([forward(self.flat, (x[at : at + per] - self.x_mean) / self.x_sd, self.net, masks)[0] for at in range(0, max(len(x), 1), per)])
        mean = (out[:, 0] + self.shift) * self.sd + self.mu
        return mean, spread(out[:, 1]) * self.scale * self.sd**2 if self.net.variance else np.full(len(x), np.nan)

    def _score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.outputs(x)

    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        score = self._score

        @F.pandas_udf("y_mean double, y_var double")
        def predicted(features: pd.Series) -> pd.DataFrame:
            if not len(features):
                return pd.DataFrame({"y_mean": [], "y_var": []}, dtype="float64")
            mean, var = score(np.vstack(features.to_numpy()).astype(float))
            return pd.DataFrame({"y_mean": mean, "y_var": var})

        scored = pool.withColumn("_p", predicted(F.col("features")))
        var = F.col("_p.y_var").alias("y_var") if "vars" in self.provides and not mean_only else no_variance()
        return scored.select(*pool.columns, F.col("_p.y_mean").alias("y_mean"), var)

    def state(self) -> dict:
        return {"flat": self.flat.tolist(), "x_mean": self.x_mean.tolist(), "x_sd": self.x_sd.tolist(), "mu": self.mu, "sd": self.sd, "shift": self.shift, "scale": self.scale}

    def restore(self, state: dict) -> None:
        self.flat, self.x_mean, self.x_sd = (np.array(state[k]) for k in ("flat", "x_mean", "x_sd"))
        self.mu, self.sd, self.shift, self.scale = (state[k] for k in ("mu", "sd", "shift", "scale"))

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(self.state()),)], "state string").coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, path: str) -> "NetworkSurrogate":
        from pyspark.sql import SparkSession

        self.restore(json.loads(SparkSession.getActiveSession().read.parquet(path).first()["state"]))
        return self


class MeanVarianceNetwork(NetworkSurrogate):
    def __init__(self, seed: int = 42, **options):
        super().__init__(seed, **({"variance": True} | options))


class DropoutNetwork(NetworkSurrogate):
    """Hidden units are left out in training, and in several passes of a prediction, whose mean and variance it gives. A pass leaves the same units out for all rows.
    With ``start_round`` a prediction is one draw, by other units in every round."""

    def __init__(self, seed: int = 42, passes: int = 10, dropout: float = 0.2, **options):
        super().__init__(seed, **({"dropout": dropout} | options))
        self.passes, self.draw, self.round = passes, False, 0
        self.provides = frozenset({"means", "vars", "stochastic"})

    def start_round(self, iteration: int, draw: bool) -> None:
        self.draw, self.round = draw, iteration if draw else 0

    def _score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = [self.round * self.passes + p for p in range(1 if self.draw else self.passes)]
        runs = np.stack([self.outputs(x, unit_masks(self.net, k, self.seed))[0] for k in keys])
        return runs.mean(axis=0), runs.var(axis=0)


class EnsembleNetwork(Surrogate):
    """Members with their own first weights, batches and held-out rows; mean and variance over members."""

    provides = frozenset({"means", "vars"})

    def __init__(self, members: int = 5, seed: int = 42, **options):
        self.models = [NetworkSurrogate(seed + 100 * i, **options) for i in range(members)]

    def fit(self, rows: DataFrame) -> "EnsembleNetwork":
        kept = cut(rows.select("id", "features", "score"))
        with ThreadPoolExecutor(len(self.models)) as threads:
            list(threads.map(inheritable_thread_target(rows.sparkSession)(lambda m: m.fit(kept)), self.models))
        return self

    def _score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = np.stack([m.outputs(x)[0] for m in self.models])
        return runs.mean(axis=0), runs.var(axis=0)

    predict = NetworkSurrogate.predict

    def save(self, path: str) -> None:
        for i, model in enumerate(self.models):
            model.save(f"{path}/member_{i}")

    def load(self, path: str) -> "EnsembleNetwork":
        for i, model in enumerate(self.models):
            model.load(f"{path}/member_{i}")
        return self
