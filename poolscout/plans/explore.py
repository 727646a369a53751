"""One exploration: label a first batch, then fit, predict, prune, acquire and label until a stopping rule holds.

Tables go to the run log after every step, so each round starts from files instead of a growing lineage. Only scalars
stay on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig, batch_rows, budget_rows, top_k_rows
from ..functions.utility import UtilityOptions, check_supported, needs, with_utility
from ..operators.acquire import (
    acquire_batch,
    acquire_batch_by_cluster,
    best_utility,
    exclude_explored,
    initial_batch,
    initial_batch_by_cluster,
    kth_best,
)
from ..operators.objectives import Objective
from ..operators.ordered import rank_within
from ..operators.prune import expected_positives_pruned, retain
from ..operators.stats import top_k_average
from ..session import broadcast_if_small, cut
from ..sources.runlog import RunLog
from ..surrogate.base import Surrogate, training_rows

FINAL_FRACTIONS = (0.0001, 0.0005, 0.001, 0.005)
WARM_START = -1


def gained_little(recent: list[float], window: int, delta: float) -> bool:
    """Whether the latest top-k average is within ``delta`` of the moving average."""
    if len(recent) < window:
        return False
    mean = sum(recent[-window:]) / window
    gain = recent[-1] - mean
    return gain <= 0 if mean == 0 else gain / abs(mean) <= delta


class Exploration:
    """A run over ``pool(id, features[, cluster_id])``, whose ids are unique."""

    def __init__(
        self, spark: SparkSession, pool: DataFrame, objective: Objective, surrogate: Surrogate, config: RunConfig,
        path: str, previous: DataFrame | None = None, resume: bool = False, run_id: str = "run",
    ):
        check_supported(config.metric, surrogate.provides)
        if config.prune and "vars" not in surrogate.provides:
            raise ValueError("pruning needs a model that predicts variances")
        self.spark, self.objective, self.surrogate, self.config = spark, objective, surrogate, config
        self.log, self.run_id = RunLog(spark, path), run_id
        self.full_pool = self.pool = pool
        self.full_rows = pool.count()
        self.k = top_k_rows(config.k, self.full_rows)
        self.budget = budget_rows(config.budget, self.full_rows)
        self.clustered = "cluster_id" in pool.columns
        self.iter, self.adjustment, self.generation = 0, 0, 0
        self.exhausted = self.fitted = False
        self.new_labels, self.predicted_at = True, None
        self.recent_avgs: list[float] = []
        self.n_scores = 0
        if resume:
            self._restore()
        else:
            self.log.write_config(run_id, asdict(config))
            if previous is not None:
                self._warm_start(previous)

    def explored(self) -> DataFrame:
        """All labels so far with their iteration, place and features."""
        return self.log.read("explored", self.iter - 1)

    def acquisitions(self) -> DataFrame:
        """``(run_id, iter, seq, id, score)`` in the form that curves and rewards read; ``seq`` counts the labels from 1 in the order in
        which they were acquired, within a batch best first."""
        return self.explored().select(F.lit(self.run_id).alias("run_id"), "iter", "seq", "id", "score")

    @property
    def labels_used(self) -> int:
        return self.n_scores - self.adjustment

    @property
    def completed(self) -> bool:
        over = self.iter > self.config.max_iters or self.labels_used >= self.budget or self.exhausted
        return over or gained_little(self.recent_avgs, self.config.window, self.config.delta)

    def run(self) -> DataFrame:
        """Explore until a stopping rule holds; returns the iteration table."""
        if self.iter == 0:
            self.explore_initial()
        while not self.completed:
            self.explore_batch()
        self.log.write_final(self.explored().select("id", "score"))
        return self.iterations()

    def final_averages(self) -> dict[float, float]:
        """Top-k averages at fixed fractions of the full pool."""
        done = self.explored()
        return {f: top_k_average(done, top_k_rows(f, self.full_rows)).first()["top_k_avg"] for f in FINAL_FRACTIONS}

    def explore_initial(self) -> None:
        n = batch_rows(self.config.init_size, self.full_rows)
        if self.clustered:
            batch = initial_batch_by_cluster(self.pool.select("id", "cluster_id"), n, self.config.seed)
        else:
            batch = initial_batch(self.pool.select("id"), n, self.config.seed)
        acquired = self._label(batch)
        self.exhausted = acquired == 0
        self._finish_round(acquired)

    def explore_batch(self) -> None:
        if self.iter == 0:
            raise RuntimeError("there is no initial batch yet")
        n = batch_rows(self.config.batch_size(self.iter - 1), self.full_rows)
        done = self.explored()
        preds = self._predictions(done)
        if self.config.prune:
            preds = self._prune(preds, done)
        scored = self._with_utility(preds, done)
        if self.clustered:
            batch = acquire_batch_by_cluster(scored, done, n, self.iter - 1, self.config.temp_i, self.config.temp_f)
        else:
            batch = acquire_batch(scored, done, n, self.config.epsilon, self.config.seed + self.iter)
        acquired = self._label(batch)
        # annealed shares make a batch smaller on purpose: what ends a run is a pool without candidates
        self.exhausted = acquired == 0 or (acquired < n and self._no_candidates_left())
        self._finish_round(acquired)

    def _no_candidates_left(self) -> bool:
        done = self.log.read("explored", self.iter)
        return exclude_explored(self.pool.select("id"), done).isEmpty()

    def _predictions(self, done: DataFrame) -> DataFrame:
        """Predictions for the pool. If all labels of the last round failed, the model and its predictions stay as they are."""
        columns = ["id", "y_mean", "y_var", *(["cluster_id"] if self.clustered else [])]
        draw = self.config.metric == "thompson" and "stochastic" in self.surrogate.provides
        if self.fitted and not self.new_labels and not draw and self.predicted_at is not None:
            last = self.log.read("preds").filter(F.col("iter") == self.predicted_at).select(*columns)
            if self.generation:
                last = last.join(self.pool.select("id"), "id", "left_semi").select(*columns)
            self.predicted_at = self.iter
            return self.log.write("preds", self.iter, last)
        if self.new_labels or not self.fitted:
            labelled = done.select("id", "score", "iter")
            rows = training_rows(labelled, done.select("id", "features"), self.config.retrain)
            self.surrogate.fit(rows)
            self.fitted = True
        self.surrogate.start_round(self.iter, draw)
        self.predicted_at = self.iter
        mean_only = "vars" not in needs(self.config.metric) and not self.config.prune
        return self.log.write("preds", self.iter, self.surrogate.predict(self.pool, mean_only).select(*columns))

    def _prune(self, preds: DataFrame, done: DataFrame) -> DataFrame:
        if preds.count() < self.k:
            raise RuntimeError(f"fewer than k = {self.k} candidates are left in the pool")
        source = kth_best(done, self.k) if self.config.use_observed_threshold else kth_best(preds, self.k, "y_mean")
        threshold = source.first()["best"]
        kept = retain(preds, threshold, self.config.prune_min_hit_prob)
        ids = self.log.write("retained", self.iter, kept.select("id"))
        lost = expected_positives_pruned(preds, ids, threshold)
        self.log.write("lost", self.iter, lost)
        self.generation = self.iter
        # only ids are kept; features come from the full pool
        self.pool = self.full_pool.join(ids, "id", "left_semi")
        return preds.join(ids, "id", "left_semi")

    def _with_utility(self, preds: DataFrame, done: DataFrame) -> DataFrame:
        c = self.config
        options = UtilityOptions(c.beta, c.xi, c.threshold, c.seed + self.iter, "stochastic" in self.surrogate.provides)
        best = F.lit(float(kth_best(done, self.k).first()["best"])) if c.metric in ("ei", "pi") else None
        spread = preds.agg(F.stddev_pop("y_mean").alias("s")).scalar() if c.metric == "noisy" else None
        return with_utility(preds, c.metric, options, best, spread)

    def _label(self, batch: DataFrame) -> int:
        """Label a batch and store it with its places and features, so that training never scans the pool again."""
        ranked = rank_within(batch.select("id", "utility"), [], best_utility(), "_rank")
        placed = self.log.write("batch", self.iter, ranked.select("id", (F.col("_rank") + self.n_scores).cast("long").alias("seq")))
        ids = placed.select("id")
        n = ids.count()
        rows = self.pool.select("id", "features").join(broadcast_if_small(placed, n), "id")
        self.log.write("explored", self.iter, rows.join(self.objective(ids), "id", "left").select("id", "score", "features", "seq"))
        self.n_scores += n
        return n

    def _finish_round(self, acquired: int) -> None:
        """Averages of the round, then its state: the last thing written, so an interrupted round is simply repeated."""
        done = self.log.read("explored", self.iter)
        batch = done.filter(F.col("iter") == self.iter).agg(F.avg("score").alias("m"), F.count("score").alias("n")).first()
        means = {"top_k_avg": top_k_average(done, self.k).first()["top_k_avg"], "batch_mean": batch["m"]}
        self.new_labels = batch["n"] > 0
        enough = self.n_scores >= self.k
        if enough:
            self.recent_avgs.append(means["top_k_avg"])
        self.iter += 1
        self.log.write_state(
            {
                "next_iter": self.iter, "adjustment": self.adjustment, "exhausted": self.exhausted,
                "generation": self.generation, "recent_avgs": self.recent_avgs, "n_scores": self.n_scores,
                "n_new": acquired, "batch_mean": means["batch_mean"], "top_k_avg": means["top_k_avg"] if enough else None,
            }
        )
        if self.fitted and (self.iter % max(self.config.checkpoint_every, 1) == 0 or self.completed):
            self.surrogate.save(f"{self.log.path}/model/iter={self.iter - 1}")

    def iterations(self) -> DataFrame:
        """One row per finished round."""
        return self.log.read("state", self.iter - 1).select("iter", "n_scores", "n_new", "batch_mean", "top_k_avg").orderBy("iter")

    def _restore(self) -> None:
        state = self.log.read_state()
        self.iter, self.adjustment, self.generation = state["next_iter"], state["adjustment"], state["generation"]
        self.exhausted, self.recent_avgs = state["exhausted"], list(state["recent_avgs"])
        self.n_scores = state["n_scores"]
        if self.generation:
            ids = self.log.read("retained").filter(F.col("iter") == self.generation).select("id")
            self.pool = self.full_pool.join(ids, "id", "left_semi")

    def _warm_start(self, previous: DataFrame) -> None:
        """Earlier labels take the place of the initial batch and do not count against the budget; they come best first.

        Labels of candidates outside the pool are kept. They train the model if ``previous`` has their ``features``.
        """
        known = previous if "features" in previous.columns else previous.withColumn("features", F.lit(None).cast(self.full_pool.schema["features"].dataType))
        known = known.select("id", "score", F.col("features").alias("_own"))
        rows = known.join(self.full_pool.select("id", "features"), "id", "left").withColumn("features", F.coalesce("features", "_own"))
        ranked = rank_within(cut(rows.select("id", "score", "features")), [], [F.col("score").desc_nulls_last(), F.col("id").desc()], "_rank")
        stored = self.log.write("explored", WARM_START, ranked.select("id", "score", "features", F.col("_rank").cast("long").alias("seq")))
        self.n_scores = self.adjustment = stored.count()
        self.iter = 1


def sweep(
    spark: SparkSession, grid: Iterable[Mapping[str, Any]], run: Callable[[Mapping[str, Any], int], float]
) -> tuple[DataFrame, Mapping[str, Any]]:
    """Run every parameter set; returns the results table and the set with the highest top-k average."""
    tried = [(i, dict(params), run(params, i)) for i, params in enumerate(grid)]
    rows = [(i, {k: str(v) for k, v in params.items()}, float(value)) for i, params, value in tried]
    table = spark.createDataFrame(rows, "trial INT, params MAP<STRING, STRING>, top_k_avg DOUBLE")
    best = max(tried, key=lambda t: t[2])[1]
    return table, best
