"""Bayesian linear regression: the Gaussian process with a dot kernel, and others through random features.

Only the solved weights and the factor of their covariance reach the driver; their size depends on the number of features and
not on the number of rows. Prior variance, noise and length scale are those of most evidence: the summed products are taken apart into eigenvalues once,
and then the evidence of any prior and noise is a sum over the eigenvalues, without another look at the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Surrogate, no_variance

MAX_FEATURES = 8192
#: Numbers in the rows that are expanded and multiplied at once.
CHUNK_CELLS = 1 << 20
#: Tasks that add up feature products; each gives one triangle.
PARTIAL_SUMS = 512
SOLVED = "row int, weight double, factor binary"
CHOSEN = "prior double, noise double, evidence double, scale double"
#: Exponents of two between which the prior variance of a weight and the noise (as a share of the variance of the targets) are sought.
PRIORS, NOISES = (-20, 20), (-20, 2)
#: Length scales that are tried if none are given.
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)


def _random_features(kernel: str, dims: int, count: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases whose cosines approximate the kernel; a Matern kernel has heavy-tailed frequencies."""
    rng = np.random.default_rng(seed)
    freq = rng.standard_normal((dims, count)) / scale
    if kernel == "matern":
        nu = 1.5
        freq = freq / np.sqrt(rng.gamma(nu, 1.0 / nu, size=count))
    return freq, rng.uniform(0.0, 2.0 * np.pi, size=count)


def chunks_of(features: pd.Series, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of a bounded number of cells, and where they are; ``width`` is that of the rows they are expanded to."""
    per = max(1, CHUNK_CELLS // max(width, 1))
    for at in range(0, len(features), per):
        part = slice(at, at + per)
        yield part, np.vstack(features.iloc[part].to_numpy()).astype(float)


def residual_noise(gram: np.ndarray, n: int) -> float:
    """The noise of the least-squares residuals."""
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    d = len(xx)
    ridge = np.linalg.solve(xx + np.eye(d) * 1e-3, xy)
    residual = max(float(yy - 2 * ridge @ xy + ridge @ xx @ ridge), 0.0)
    return max(residual / max(n - d, 1), 1e-6)


def log_evidence(values: np.ndarray, parts: np.ndarray, yy: float, n: int, prior: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Log evidence of the targets for each prior variance and noise (arrays of one shape). ``values`` are the eigenvalues of the features' products and
    ``parts`` the products with the targets along their vectors."""
    p, v = np.asarray(prior, float)[..., None], np.asarray(noise, float)[..., None]
    fit = yy - (parts**2 * p / (v + p * values)).sum(-1)
    return -0.5 * (n * np.log(2 * np.pi * v[..., 0]) + np.log1p(p * values / v).sum(-1) + np.maximum(fit, 0.0) / v[..., 0])


def best_evidence(gram: np.ndarray, n: int, refine: int) -> tuple[float, float, float]:
    """Prior variance, noise and log evidence of the best powers of two, moved by half steps ``refine`` times."""
    values, vectors = np.linalg.eigh(gram[:-1, :-1])
    values, parts, yy = np.maximum(values, 0.0), vectors.T @ gram[:-1, -1], float(gram[-1, -1])
    p, v = (np.arange(lo, hi + 1, dtype=float) for lo, hi in (PRIORS, NOISES))
    p, v, step = np.repeat(p, len(v)), np.tile(v, len(p)), 1.0
    for turn in range(refine + 1):
        found = np.concatenate([log_evidence(values, parts, yy, n, 2.0 ** p[i : i + 64], 2.0 ** v[i : i + 64]) for i in range(0, len(p), 64)])
        best = int(found.argmax())
        chosen = (float(2.0 ** p[best]), float(2.0 ** v[best]), float(found[best]))
        step /= 2
        around = np.array([-step, 0.0, step])
        p, v = p[best] + np.repeat(around, 3), v[best] + np.tile(around, 3)
    return chosen


def _posterior(gram: np.ndarray, prior: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the weights, and the inverse Cholesky factor M of their precision, so that M'M is their covariance."""
    xx, xy = gram[:-1, :-1], gram[:-1, -1]
    d = len(xx)
    factor = np.linalg.solve(np.linalg.cholesky(xx / noise + np.eye(d) / prior), np.eye(d))
    return factor.T @ (factor @ xy) / noise, factor


class GaussianProcessSurrogate(Surrogate):
    """Kernels ``dot`` (also ``dotproduct``), ``rbf`` and ``matern``. Targets are standardised.

    Every task adds up the products of its own rows, the partial sums are added on the JVM side, and one task solves
    the system, whose size is the number of features. With ``evidence`` prior, noise and, of ``scale`` as a sequence, the length scale are those of most
    evidence, found to ``refine`` halvings of a power of two; all scales (``SCALES``, if none are given) are summed in the same pass. Without it the prior variance is 1, the noise is that of
    the least-squares residuals, and ``scale`` is one number.
    """

    provides = frozenset({"means", "vars"})

    def __init__(self, kernel: str = "dot", random_features: int = 256, scale: float | Sequence[float] | None = None, seed: int = 42, evidence: bool = False, refine: int = 6):
        kernel = "dot" if kernel == "dotproduct" else kernel
        if kernel not in ("dot", "rbf", "matern"):
            raise ValueError(f"unknown kernel {kernel!r}")
        if scale is None:
            scale = SCALES if evidence else 1.0
        scales = [float(scale)] if isinstance(scale, (int, float)) else [float(x) for x in scale]
        self.scales = scales if kernel != "dot" and evidence else [scales[0] if len(scales) == 1 else 1.0]
        self.kernel, self.count, self.scale, self.seed, self.evidence, self.refine = kernel, random_features, self.scales[0], seed, evidence, refine
        #: Prior variance, noise and log evidence of the last fit.
        self.chosen: dict[str, float] = {}
        self.weights: np.ndarray | None = None
        self.factor: np.ndarray | None = None
        self.dims = 0
        self.mu = 0.0
        self.sd = 1.0

    def _expand(self, scale: float | None = None):
        """Function from raw feature rows to the rows of the linear model, with a constant in front."""
        if self.kernel == "dot":
            return lambda x: np.hstack([np.ones((len(x), 1)), x])
        freq, phase = _random_features(self.kernel, self.dims, self.count, self.scale if scale is None else scale, self.seed)
        factor = np.sqrt(2.0 / self.count)
        return lambda x: np.hstack([np.ones((len(x), 1)), factor * np.cos(x @ freq + phase)])

    def _width(self) -> int:
        """Numbers in a row, before or after it is expanded, whichever are more."""
        return 1 + max(self.dims, 0 if self.kernel == "dot" else self.count)

    def fit(self, rows: DataFrame) -> "GaussianProcessSurrogate":
        stats = rows.agg(
            F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"), F.count("score").alias("n"),
            F.max(F.size("features")).alias("dims"),
        ).first()
        if not stats["n"]:
            raise ValueError("there are no labelled rows to fit on")
        self.mu, self.sd, self.dims = stats["mu"], stats["sd"] or 1.0, stats["dims"]
        if self.dims > MAX_FEATURES:
            raise ValueError(f"at most {MAX_FEATURES} features, got {self.dims}")
        expands, mu, sd, width = [self._expand(x) for x in self.scales], self.mu, self.sd, self._width()

        def partial_products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals = [0.0] * len(expands)
            for frame in frames:
                targets = (frame["score"].to_numpy()[:, None] - mu) / sd
                for part, x in chunks_of(frame["features"], width):
                    for i, expand in enumerate(expands):
                        both = np.hstack([expand(x), targets[part]])
                        totals[i] = totals[i] + both.T @ both
            for i, total in enumerate(totals):  # the products are symmetric: each row from its diagonal on
                if not np.isscalar(total):
                    yield pd.DataFrame({"scale": i, "row": np.arange(len(total)), "products": [total[j, j:] for j in range(len(total))]})

        # a bounded number of partial sums: beyond it a task adds up several splits before anything moves
        products = rows.select("features", "score").coalesce(PARTIAL_SUMS).mapInPandas(partial_products, "scale int, row int, products array<double>")
        total = Summarizer.sum(array_to_vector("products"))
        n, scales, by_evidence, refine = stats["n"], self.scales, self.evidence, self.refine

        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for i, sums in pd.concat(list(frames)).sort_values(["scale", "row"]).groupby("scale"):
                upper = np.zeros((len(sums), len(sums)))
                for j, row in enumerate(sums["products"]):
                    upper[j, j:] = row
                gram = upper + np.triu(upper, 1).T
                found = best_evidence(gram, n, refine) if by_evidence else (1.0, residual_noise(gram, n), 0.0)
                if best is None or found[2] > best[0][2]:
                    best = (found, gram, scales[i])
            (prior, noise, value), gram, scale = best
            weights, factor = _posterior(gram, prior, noise)
            lines = [factor[i, : i + 1].tobytes() for i in range(len(factor))]
            yield pd.DataFrame({"row": np.arange(len(weights)), "weight": weights, "factor": lines, "prior": prior, "noise": noise, "evidence": value, "scale": scale})

        summed = products.groupBy("scale", "row").agg(vector_to_array(total).alias("products"))
        solved = summed.coalesce(1).mapInPandas(solve, f"{SOLVED}, {CHOSEN}").collect()
        self.chosen = {k: solved[0][k] for k in ("prior", "noise", "evidence")}
        self.scale = solved[0]["scale"]
        self._keep(solved)
        return self

    def _keep(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r["row"])
        self.weights = np.array([r["weight"] for r in rows])
        self.factor = np.zeros((len(rows), len(rows)))
        for i, r in enumerate(rows):
            self.factor[i, : i + 1] = np.frombuffer(r["factor"])

    def predict(self, pool: DataFrame, mean_only: bool = True) -> DataFrame:
        expand, mu, sd, w, width = self._expand(), self.mu, self.sd, self.weights, self._width()
        shared = pool.sparkSession.sparkContext.broadcast(self.factor.T if not mean_only else None)

        @F.pandas_udf("y_mean double, y_var double")
        def score(features: pd.Series) -> pd.DataFrame:
            mean, var = np.empty(len(features)), np.full(len(features), np.nan)
            for part, x in chunks_of(features, width):
                x = expand(x)
                mean[part] = x @ w * sd + mu
                if shared.value is not None:
                    var[part] = ((x @ shared.value) ** 2).sum(axis=1) * sd**2
            return pd.DataFrame({"y_mean": mean, "y_var": var})

        scored = pool.withColumn("_p", score("features"))
        var = no_variance() if mean_only else F.col("_p.y_var").alias("y_var")
        return scored.select(*pool.columns, F.col("_p.y_mean").alias("y_mean"), var)

    def save(self, path: str) -> None:
        """One row per weight, and the scalars apart."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        rows = [(i, float(w), self.factor[i, : i + 1].tobytes()) for i, w in enumerate(self.weights)]
        spark.createDataFrame(rows, SOLVED).write.mode("overwrite").parquet(f"{path}/rows")
        state = json.dumps({"mu": self.mu, "sd": self.sd, "dims": self.dims, "kernel": self.kernel, "count": self.count, "scale": self.scale, "seed": self.seed, "chosen": self.chosen})
        spark.createDataFrame([(state,)], "state STRING").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    def load(self, path: str) -> "GaussianProcessSurrogate":
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        self.mu, self.sd, self.dims, self.kernel = state["mu"], state["sd"], state["dims"], state["kernel"]
        self.count, self.scale, self.seed, self.chosen = state["count"], state["scale"], state["seed"], state["chosen"]
        self._keep(spark.read.parquet(f"{path}/rows").collect())
        return self
