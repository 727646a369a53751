"""Curves, rewards and statistics beyond what the SQL checks cover."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolscout.operators import metrics, stats
from poolscout.plans import curves, rewards


def slow_top_k(scores, k):
    heap, out = [], []
    for i, y in enumerate(scores):
        if y is not None:
            heapq.heappush(heap, y) if len(heap) < k else heapq.heappushpop(heap, y)
        out.append(sum(heap) / k)
    out[:k] = [out[min(k, len(out)) - 1]] * min(k, len(out))
    return out


@pytest.mark.parametrize("k,chunk_rows", [(3, 12), (3, 1000), (5, 20), (40, 10)])
def test_running_top_k_average_over_chunks(spark, k, chunk_rows):
    rng = np.random.default_rng(k)
    rows, want = [], {}
    for run, n in ((1, 170), (2, 9), (3, 64)):
        scores = [None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 50, n)]
        rows += [(run, i + 1, s) for i, s in enumerate(scores)]
        want[run] = slow_top_k(scores, k)
    frame = spark.createDataFrame(rows, "run_id long, seq long, score double")
    got = curves.running_top_k_average(frame, k, chunk_rows).toPandas().sort_values(["run_id", "seq"])
    for run in want:
        assert np.allclose(got[got.run_id == run]["top_k_avg"], want[run])


def test_recall_counts_ties_once(spark):
    runs = spark.createDataFrame([(1, 1, 10, 5.0), (1, 2, 11, 5.0), (1, 3, 12, 9.0), (1, 4, 13, None)], "run_id long, seq long, id long, score double")
    hits = spark.createDataFrame([(12, 9.0), (10, 5.0)], "id long, score double")
    got = [r["recall"] for r in curves.recall_by_score(runs, hits, 2).orderBy("seq").collect()]
    assert got == [0.5, 0.5, 1.0, 1.0]
    assert [r["recall"] for r in curves.recall_by_identity(runs, hits, 2).orderBy("seq").collect()] == [0.5, 0.5, 1.0, 1.0]


def test_rewards_of_perfect_and_empty_runs(spark):
    hits = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, score double")
    runs = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0), ("a", 3, 1.0), ("b", 4, 0.0), ("b", 5, None)], "run string, id long, score double")
    got = {r["run"]: (r["f_avg"], r["f_ids"], r["f_scores"]) for r in rewards.rewards(runs, ["run"], hits, 2).collect()}
    assert got == {"a": (1.0, 1.0, 1.0), "b": (0.0, 0.0, 0.0)}


def test_iteration_recall_equals_taking_the_best_again(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"run_id": 1, "iter": np.arange(200) // 20, "id": np.arange(200), "score": rng.integers(0, 30, 200).astype(float)})
    truth = frame.sort_values(["score", "id"], ascending=False).head(15)
    got = rewards.score_recall_by_iteration(spark.createDataFrame(frame), ["run_id"], spark.createDataFrame(truth[["id", "score"]]), 15)
    for r in got.collect():
        best = frame[frame.iter <= r["iter"]]["score"].nlargest(15)
        missing = sum((truth["score"].value_counts() - best.value_counts().reindex(truth["score"].unique()).fillna(0)).clip(lower=0))
        assert np.isclose(r["f_scores"], (15 - missing) / 15)


def test_cost_curve(spark):
    rows = spark.createDataFrame([(1, 1, 100, 500), (1, 2, 200, 300), (1, 3, 300, 100)], "run_id long, iter int, n_acquired long, n_retained long")
    train, predict = 6.16 / 400e3, 20.52 / 98.2e6
    full = [r["cost"] for r in curves.cost_curve(rows, 1000, False).orderBy("iter").collect()]
    pruned = [r["cost"] for r in curves.cost_curve(rows, 1000, True).orderBy("iter").collect()]
    assert np.allclose(full, np.cumsum([n * train + 1000 * predict for n in (100, 200, 300)]))
    assert np.allclose(pruned, np.cumsum([100 * train + 1000 * predict, 200 * train + 500 * predict, 300 * train + 300 * predict]))


def test_padding(spark):
    rows = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (2, 1, 0.5)], "run_id long, seq long, y double")
    edge = {(r["run_id"], r["seq"]): r["y"] for r in curves.pad_curves(rows, "y", True).collect()}
    gap = {(r["run_id"], r["seq"]): r["y"] for r in curves.pad_curves(rows, "y", False).collect()}
    assert edge[(2, 2)] == 0.5 and gap[(2, 2)] is None and len(edge) == len(gap) == 4


def test_student_cdf():
    # One-sided tail probabilities from a table of Student's t.
    for t, freedom, p in ((-6.313752, 1, 0.05), (-2.015048, 5, 0.05), (-1.812461, 10, 0.05), (-2.763769, 10, 0.01), (0.0, 7, 0.5), (1.697261, 30, 0.95)):
        assert abs(stats.student_cdf(t, freedom) - p) < 1e-6


def test_t_statistic_of_population_and_sample_sd(spark):
    a, b = np.array([1.0, 2.0, 4.0]), np.array([2.0, 5.0, 6.0, 7.0])
    rows = [("t", "x", float(v)) for v in a] + [("t", "y", float(v)) for v in b]
    frame = spark.createDataFrame(rows, "target string, arm string, value double")
    sp = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / 5
    want = (a.mean() - b.mean()) / np.sqrt(sp * (1 / 3 + 1 / 4))
    for population in (False, True):
        row = rewards.arm_tests(frame, "y", "x", population).first()
        assert np.isclose(row["t"], want) and row["freedom"] == 5


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": rng.integers(0, 3, 301), "v": rng.standard_normal(301), "id": np.arange(301)})
    at = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = stats.quantiles(spark.createDataFrame(frame), ["k"], "v", "id", at).toPandas().set_index("k")
    for k, part in frame.groupby("k"):
        assert np.allclose(got.loc[k], np.quantile(part["v"], at))
    assert np.allclose(list(stats.quantiles(spark.createDataFrame(frame), [], "v", "id", at).first()), np.quantile(frame["v"], at))


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (10.1,), (-0.1,), (5.0,)], "x double")
    got = {r["bin"]: (r["n"], r["density"]) for r in stats.histogram(rows, "x", 0.0, 10.0, 2).collect()}
    assert got == {0: (1, 0.05), 1: (3, 0.15)}


def test_areas_of_perfect_and_tied_scores(spark):
    rows = spark.createDataFrame(
        [("good", 1, 0.9), ("good", 0, 0.1), ("tied", 1, 0.5), ("tied", 0, 0.5), ("one", 1, 0.2)], "task string, y int, p double"
    )
    auc = {r["task"]: r["auc"] for r in metrics.roc_auc(rows, ["task"], "y", "p").collect()}
    area = {r["task"]: r["pr_auc"] for r in metrics.pr_auc(rows, ["task"], "y", "p").collect()}
    assert auc == {"good": 1.0, "tied": 0.5, "one": None}
    assert area == {"good": 1.0, "tied": 0.75, "one": 1.0}


def test_scaler_of_empty_and_constant_columns(spark):
    empty = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert tuple(stats.scaler(empty, "x").first()) == (0.0, 1.0)
    assert tuple(stats.scaler(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").first()) == (3.0, 1.0)


def test_per_task_metrics_skip_missing_targets(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.8), ("a", None, 0.1), ("b", 0.0, 0.6)], "task string, target double, pred double")
    got = {r["task"]: r["accuracy"] for r in metrics.per_task(rows, metrics.classification_metrics(F.col("target"), F.col("pred"))).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_top_k_average(spark):
    rows = spark.createDataFrame([(1, 4.0), (2, None), (3, 2.0)], "id int, score double")
    assert [stats.top_k_average(rows, k).first()["top_k_avg"] for k in (1, 2, 3, 10)] == [4.0, 3.0, 2.0, 2.0]
    failed = rows.filter("score IS NULL")
    assert stats.top_k_average(failed, 2).first()["top_k_avg"] == 0.0
