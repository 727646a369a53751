"""Averages, errors, histograms and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import top_k_rows
from ..functions import scaling
from ..operators import metrics, stats
from ..operators.clusters import cluster_sizes, size_histogram
from ..operators.ordered import rank_within
from ..plans.explore import FINAL_FRACTIONS
from ..session import broadcast_if_small, cut, scratch_path
from ..sources.tables import unpivot_tasks
from ..surrogate.ensembles import member_stats
from .registry import explored, pool_scores, preds, query, r6, trials


def _average_sql(k: str) -> str:
    return (
        f"(SELECT sum(coalesce(score, 0)) / count(*) FROM (SELECT score FROM explored ORDER BY score DESC NULLS LAST, id DESC LIMIT {k}))"
    )


@query("A1", f"SELECT round({_average_sql('100')}, 6) AS top_k_avg", ("explored",))
def top_k_average(t):
    return stats.top_k_average(explored(t), 100).select(r6("top_k_avg").alias("top_k_avg"))


@query(
    "A1 L10",
    " UNION ALL ".join(
        f"SELECT {f} :: DOUBLE AS fraction, round("
        + _average_sql(f"(SELECT greatest(1, CAST(floor({f} * count(*)) AS BIGINT)) FROM preds)")
        + ", 6) AS top_k_avg"
        for f in FINAL_FRACTIONS
    ),
    ("explored", "preds"),
)
def final_averages(t):
    rows = preds(t).count()
    done = explored(t)
    parts = [
        stats.top_k_average(done, top_k_rows(f, rows)).select(F.lit(f).alias("fraction"), r6("top_k_avg").alias("top_k_avg"))
        for f in FINAL_FRACTIONS
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("A2", "SELECT iter, round(avg(score), 6) AS batch_mean FROM explored GROUP BY iter", ("explored",))
def batch_means(t):
    return explored(t).groupBy("iter").agg(r6(F.avg("score")).alias("batch_mean"))


def _errors(t):
    """Prediction errors per iteration; each iteration's model is less uncertain than the one before."""
    shift = F.col("y_mean") + F.sqrt("y_var") / (F.col("iter") + 1)
    return preds(t).join(explored(t), "id").filter("score IS NOT NULL").select(
        "iter", "id", "score", shift.alias("pred"), (F.col("score") - shift).alias("error")
    )


ERRORS_SQL = (
    "errors AS (SELECT iter, id, score, y_mean + sqrt(y_var) / (iter + 1) AS pred, score - (y_mean + sqrt(y_var) / (iter + 1)) AS error "
    "FROM preds JOIN explored USING (id) WHERE score IS NOT NULL)"
)
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(
    "A9",
    f"WITH {ERRORS_SQL} SELECT iter, "
    + ", ".join(f"round(quantile_cont(error, {q}), 6) AS q{round(q * 100)}" for q in QUANTILES)
    + " FROM errors GROUP BY iter",
    ("preds", "explored"),
)
def error_quantiles(t):
    rows = stats.quantiles(_errors(t), ["iter"], "error", "id", QUANTILES)
    return rows.select("iter", *[r6(f"q{round(q * 100)}").alias(f"q{round(q * 100)}") for q in QUANTILES])


#: Rank error that a sketch of the default size stays far below.
SKETCH_ERROR = 0.02


@query(
    "A9",
    f"WITH {ERRORS_SQL}, k AS (SELECT unnest({list(QUANTILES)}) AS q), c AS (SELECT iter, count(*) AS n FROM errors GROUP BY iter UNION ALL SELECT -1, count(*) FROM errors) "
    "SELECT CAST(iter AS INTEGER) AS iter, CAST(q AS DOUBLE) AS q, n, true AS close FROM c, k",
    ("preds", "explored"),
)
def error_quantile_sketches(t):
    """Quantiles of the errors of every iteration and, as iteration -1, of all: the sketches of the iterations are stored and then merged, without another look at the errors.
    ``close`` says that the exact share of errors below the estimate is off by less than ``SKETCH_ERROR``."""
    path = scratch_path(t.spark, "sketches")
    errors = cut(_errors(t).select("iter", "error"))
    stats.quantile_sketches(errors, ["iter"], "error").write.parquet(path)
    stored = t.spark.read.parquet(path)
    merged = stats.merged_sketches(stored, []).select(F.lit(-1).alias("iter"), "sketch")
    found = cut(stats.sketch_quantiles(stored.unionByName(merged), QUANTILES))
    estimates = found.groupBy("iter", "n").agg(F.array_sort(F.collect_list(F.struct("q", "estimate"))).alias("at"))  # the shares asked for
    shares = [F.struct(F.lit(q).alias("q"), F.avg((F.col("error") < F.col("at")[i]["estimate"]).cast("int")).alias("low"),
                       F.avg((F.col("error") <= F.col("at")[i]["estimate"]).cast("int")).alias("high")) for i, q in enumerate(QUANTILES)]
    both = errors.unionByName(errors.withColumn("iter", F.lit(-1)))
    counted = both.join(broadcast_if_small(estimates, estimates.count()), "iter").groupBy("iter", "n").agg(F.count(F.lit(1)).alias("rows"), F.array(*shares).alias("s"))
    rows = counted.select("iter", "n", "rows", F.inline("s"))
    close = (F.col("rows") == F.col("n")) & (F.col("low") <= F.col("q") + SKETCH_ERROR) & (F.col("high") >= F.col("q") - SKETCH_ERROR)
    return rows.select("iter", "q", "n", close.alias("close"))


@query(
    "A19 A15",
    f"WITH {ERRORS_SQL} SELECT iter, round(avg(error * error), 6) AS mse, round(sqrt(avg(error * error)), 6) AS rmse, "
    "round(avg(abs(error)), 6) AS mae, round(1 - sum(error * error) / (var_pop(score) * count(*)), 6) AS r2 FROM errors GROUP BY iter",
    ("preds", "explored"),
)
def regression_errors(t):
    values = metrics.regression_metrics(F.col("score"), F.col("pred"))
    return _errors(t).groupBy("iter").agg(*[r6(v).alias(n) for n, v in values.items()])


@query(
    "A24",
    "SELECT round(avg((ln(greatest(y_var, 1e-5)) + (y_mean - score) * (y_mean - score) / greatest(y_var, 1e-5)) / 2), 6) AS nll "
    "FROM (SELECT y_mean + sqrt(y_var) AS y_mean, y_var, score FROM preds JOIN explored USING (id) WHERE score IS NOT NULL)",
    ("preds", "explored"),
)
def gaussian_nll(t):
    rows = preds(t).join(explored(t), "id").filter("score IS NOT NULL")
    value = metrics.gaussian_nll(F.col("score"), F.col("y_mean") + F.sqrt("y_var"), F.col("y_var"))
    return rows.agg(r6(value).alias("nll"))


LOW, HIGH, BINS = 0.0, 500.0, 75


def _bin_sql(x: str, low: float, high: float, bins: int) -> str:
    return f"CAST(least(floor(({x} - CAST({low} AS DOUBLE)) / CAST({(high - low) / bins!r} AS DOUBLE)), {bins - 1}) AS INTEGER)"


@query(
    "A10",
    f"SELECT {_bin_sql('score', LOW, HIGH, BINS)} AS bin, count(*) AS n, "
    f"round(count(*) / CAST((SELECT count(*) FROM pool_scores WHERE score BETWEEN {LOW} AND {HIGH}) AS DOUBLE) / {(HIGH - LOW) / BINS!r}, 6) AS density "
    f"FROM pool_scores WHERE score BETWEEN {LOW} AND {HIGH} GROUP BY 1",
    ("pool_scores",),
)
def score_histogram(t):
    return stats.histogram(pool_scores(t), "score", LOW, HIGH, BINS).withColumn("density", r6("density"))


@query(
    "A10",
    f"SELECT {_bin_sql('y_mean', 0.0, 500.0, 10)} AS bin_x, {_bin_sql('y_var', 0.0, 100.0, 10)} AS bin_y, count(*) AS n "
    "FROM preds WHERE y_mean BETWEEN 0 AND 500 AND y_var BETWEEN 0 AND 100 GROUP BY 1, 2",
    ("preds",),
)
def prediction_histogram_2d(t):
    return stats.histogram_2d(preds(t), "y_mean", "y_var", (0.0, 500.0), (0.0, 100.0), 10)


@query("A11 A4", "SELECT n AS size, count(*) AS clusters FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1")
def cluster_size_histogram(t):
    return size_histogram(cluster_sizes(t.orders.select(F.col("o_custkey").alias("cluster_id"))))


@query(
    "A12",
    "SELECT event_type, round(sum(value / 100 * exp(-value / 100)) / sum(exp(-value / 100)), 6) AS mean FROM events GROUP BY 1",
)
def boltzmann_means(t):
    return t.events.groupBy("event_type").agg(r6(stats.boltzmann_mean(F.col("value") / 100)).alias("mean"))


def _label_tasks(t):
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"),
        (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("prob"),
    )
    return unpivot_tasks(rows, ["doc_id", "prob"], ["quality", "toxic"])


TASKS_SQL = (
    "tasks AS (SELECT doc_id, n_chars / (n_chars + 2000.0::DOUBLE) AS prob, x.task, CASE x.task WHEN 'quality' THEN quality ELSE toxic END AS target "
    "FROM documents JOIN labels USING (doc_id), (VALUES ('quality'), ('toxic')) x(task))"
)


@query("A13", f"WITH {TASKS_SQL} SELECT task, round(1 - avg(target), 6) AS share_0, round(avg(target), 6) AS share_1 FROM tasks GROUP BY 1")
def class_shares(t):
    shares = metrics.class_shares(_label_tasks(t))
    return shares.select("task", r6("share_0").alias("share_0"), r6("share_1").alias("share_1"))


@query("A14", "SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd FROM explored", ("explored",))
def target_scaler(t):
    return stats.scaler(explored(t), "score").select(r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(
    "A16 A18",
    f"WITH {TASKS_SQL} SELECT task, round(avg(CAST(CAST(prob > 0.5 AS INTEGER) = target AS INTEGER)), 6) AS accuracy, "
    "round(avg(-(target * ln(prob) + (1 - target) * ln(1 - prob))), 6) AS binary_cross_entropy FROM tasks GROUP BY 1",
)
def classification_errors(t):
    values = metrics.classification_metrics(F.col("target"), F.col("pred"))
    rows = _label_tasks(t).withColumnRenamed("prob", "pred")
    return metrics.per_task(rows, {n: r6(v) for n, v in values.items()})


@query(
    "A16",
    "SELECT round(avg(-ln(CASE label WHEN 0 THEN 1 / (1 + w) WHEN 1 THEN w / (1 + w) END)), 6) AS cross_entropy "
    "FROM (SELECT quality AS label, n_chars / 1000.0::DOUBLE AS w FROM documents JOIN labels USING (doc_id))",
)
def class_cross_entropy(t):
    w = F.col("n_chars") / F.lit(1000.0)
    value = metrics.cross_entropy(F.col("quality"), [F.lit(1.0) / (F.lit(1.0) + w), w / (F.lit(1.0) + w)])
    return t.documents.join(t.labels, "doc_id").agg(r6(value).alias("cross_entropy"))


@query(
    "A17 A18",
    f"""
    WITH {TASKS_SQL},
    ranked AS (SELECT task, target, rank() OVER w + (count(*) OVER (PARTITION BY task, prob) - 1) / 2.0 AS place
               FROM tasks WINDOW w AS (PARTITION BY task ORDER BY prob)),
    sums AS (SELECT task, sum(CASE WHEN target = 1 THEN place END) AS r, sum(target) AS p, count(*) - sum(target) AS n FROM ranked GROUP BY 1)
    SELECT task, round((r - p * (p + 1) / 2.0) / CAST(p * n AS DOUBLE), 6) AS auc FROM sums
    """,
)
def roc_auc(t):
    return metrics.roc_auc(_label_tasks(t), ["task"], "target", "prob").select("task", r6("auc").alias("auc"))


@query(
    "A17 A18",
    f"""
    WITH {TASKS_SQL},
    scores AS (SELECT task, prob, sum(target) AS p, count(*) AS n FROM tasks GROUP BY 1, 2),
    points AS (SELECT task, p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM scores WINDOW w AS (PARTITION BY task ORDER BY prob DESC)),
    curve AS (SELECT task, p, tp / CAST(seen AS DOUBLE) AS prec, lag(tp / CAST(seen AS DOUBLE), 1, 1.0::DOUBLE) OVER (PARTITION BY task ORDER BY seen) AS before FROM points)
    SELECT task, round(sum(p * (prec + before) / 2) / CAST(sum(p) AS DOUBLE), 6) AS pr_auc FROM curve GROUP BY 1
    """,
)
def precision_recall_auc(t):
    return metrics.pr_auc(_label_tasks(t), ["task"], "target", "prob").select("task", r6("pr_auc").alias("pr_auc"))


@query(
    "A15 A18",
    f"WITH {ERRORS_SQL}, tasks AS (SELECT 'pred' AS task, score AS target, pred FROM errors UNION ALL "
    "SELECT 'half', score, pred / 2 FROM errors) SELECT task, round(sqrt(avg((target - pred) * (target - pred))), 6) AS rmse, "
    "round(1 - sum((target - pred) * (target - pred)) / (var_pop(target) * count(*)), 6) AS r2 FROM tasks GROUP BY 1",
    ("preds", "explored"),
)
def per_task_regression(t):
    rows = _errors(t).select("score", "pred", (F.col("pred") / 2).alias("half"))
    tasks = unpivot_tasks(rows, ["score"], ["pred", "half"]).select("task", F.col("score").alias("target"), F.col("target").alias("pred"))
    values = metrics.regression_metrics(F.col("target"), F.col("pred"))
    return metrics.per_task(tasks, {n: r6(values[n]) for n in ("rmse", "r2")})


@query("A21", "SELECT iter, round(min(score), 6) AS lowest, round(max(score), 6) AS highest FROM explored WHERE score > 50 GROUP BY iter", ("explored",))
def score_range(t):
    rows = explored(t).filter("score > 50")
    return rows.groupBy("iter").agg(r6(F.min("score")).alias("lowest"), r6(F.max("score")).alias("highest"))


@query(
    "A22",
    "SELECT vec_id AS id, round(list_avg(m), 6) AS y_mean, round(list_var_pop(m), 6) AS y_var "
    "FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings)",
)
def member_means_and_variances(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("m"))
    mean, var = member_stats([F.col("m")[i] for i in range(64)])
    return rows.select("id", r6(mean).alias("y_mean"), r6(var).alias("y_var"))


@query("A23", "SELECT o_orderpriority AS node_id, count(*) AS n FROM orders GROUP BY 1")
def members_per_node(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "A6",
    "SELECT target, arm, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(value) AS reps "
    "FROM (SELECT target, arm, rep, avg(score) AS value FROM trials GROUP BY ALL) GROUP BY ALL",
    ("trials",),
)
def replicate_stats(t):
    values = trials(t).groupBy("target", "arm", "rep").agg(F.avg("score").alias("value"))
    rows = stats.replicate_stats(values, ["target", "arm"])
    return rows.select("target", "arm", r6("mean").alias("mean"), r6("sd").alias("sd"), "reps")


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("F11", "SELECT id, round(ln(1 + exp(-abs(x))) + greatest(x, 0), 6) AS y FROM (SELECT id, (y_mean - 250) / 50 AS x FROM preds)", ("preds",))
def softplus(t):
    return preds(t).select("id", r6(scaling.softplus((F.col("y_mean") - 250) / 50)).alias("y"))


@query(
    "F12",
    "SELECT id, round((score - m) / s, 6) AS scaled, round(coalesce((score - m) / s, 0) * s + m, 6) AS restored FROM explored, "
    "(SELECT avg(score) AS m, stddev_pop(score) AS s FROM explored)",
    ("explored",),
)
def standardised_scores(t):
    fitted = stats.scaler(explored(t), "score")
    mean, sd = fitted.select("mean").scalar(), fitted.select("sd").scalar()
    rows = explored(t).withColumns({"m": mean, "s": sd}).withColumn("z", scaling.standardise(F.col("score"), F.col("m"), F.col("s")))
    restored = scaling.unstandardise(F.coalesce("z", F.lit(0.0)), F.col("m"), F.col("s"))
    return rows.select("id", r6("z").alias("scaled"), r6(restored).alias("restored"))


@query("F13", "SELECT id, round(y_mean * 2.5 + 10, 6) AS y_mean, round(y_var * 6.25, 6) AS y_var FROM preds", ("preds",))
def unscaled_predictions(t):
    mean = scaling.unstandardise(F.col("y_mean"), F.lit(10.0), F.lit(2.5))
    return preds(t).select("id", r6(mean).alias("y_mean"), r6(scaling.unstandardise_variance(F.col("y_var"), F.lit(2.5))).alias("y_var"))


@query("F15", "SELECT o_orderkey AS id, round(o_totalprice * (8.0 :: DOUBLE * 0.0475 / 3600 + 1.0 :: DOUBLE * 2.48 / 3600), 8) AS dollars FROM orders")
def cloud_dollars(t):
    rate = scaling.cloud_dollars_per_second(F.lit(8.0), F.lit(1.0))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * rate, 8).alias("dollars"))


@query(
    "F18",
    "SELECT event_id AS id, concat_ws('', CAST(event_type = 'view' AS INTEGER), CAST(event_type = 'click' AS INTEGER), "
    "CAST(event_type NOT IN ('view', 'click') AS INTEGER)) AS code FROM events",
)
def one_hot(t):
    code = scaling.one_hot_with_unknown(F.col("event_type"), ["view", "click"])
    return t.events.select(F.col("event_id").alias("id"), F.concat_ws("", code.cast("array<string>")).alias("code"))
