"""Surrogates, feature clusters and whole runs."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.fingerprint import dense_bits, fingerprint, has_tokens
from ..operators.clusters import cluster_pool
from ..operators.minibatch import MiniBatch, assign_clusters, fit_minibatch
from ..operators.objectives import lookup_objective
from ..plans import curves
from ..plans.explore import Exploration, sweep
from ..session import cut, scratch_path, spread_few_splits
from ..surrogate.ensembles import LOG_CHI_MEAN
from ..surrogate.factory import make_surrogate
from ..surrogate.linear import NOISES, PRIORS
from .registry import Tables, preds, query, r6, uniform_sql


def vector_pool(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def vector_labels(t: Tables) -> DataFrame:
    """A linear score of the vectors plus a little noise."""
    x = F.col("embedding")
    noise = (F.col("label") - 4.5) * 0.01
    score = (x[0] * 3.0 - x[1] * 2.0 + x[2] + x[3] * x[4]).cast("double") + noise
    return t.embeddings.select(F.col("vec_id").alias("id"), score.alias("score"))


def _predict(t: Tables, model, mean_only: bool = False) -> DataFrame:
    """Fit on all labelled vectors and predict all."""
    fitted = model.fit(vector_pool(t).join(vector_labels(t), "id"))
    return fitted.predict(vector_pool(t), mean_only).select("id", r6("y_mean").alias("y_mean"), r6("y_var").alias("y_var"))


@query("M1 M8")
def forest_predictions(t):
    return _predict(t, make_surrogate("rf"))


@query("M2")
def process_predictions(t):
    return _predict(t, make_surrogate("gp", kernel="dotproduct"))


@query("M2")
def process_predictions_rbf(t):
    return _predict(t, make_surrogate("gp", kernel="rbf"))


@query("M2")
def process_predictions_matern(t):
    return _predict(t, make_surrogate("gp", kernel="matern"))


@query("M2")
def process_predictions_by_evidence(t):
    """Length scale, prior and noise of most evidence."""
    return _predict(t, make_surrogate("gp", kernel="rbf", evidence=True))


@query("M3 M8")
def regressor_predictions(t):
    return _predict(t, make_surrogate("nn"), mean_only=True)


@query("M3")
def boosted_predictions(t):
    return _predict(t, make_surrogate("nn", kind="gbt"), mean_only=True)


@query("M4")
def ensemble_predictions(t):
    return _predict(t, make_surrogate("nn", "ensemble"))


@query("M5")
def mean_variance_predictions(t):
    return _predict(t, make_surrogate("nn", "mve"))


@query("M6")
def dropout_predictions(t):
    return _predict(t, make_surrogate("nn", "dropout"))


@query("M3 M8")
def network_predictions(t):
    return _predict(t, make_surrogate("network"), mean_only=True)


@query("M4")
def network_ensemble_predictions(t):
    return _predict(t, make_surrogate("network", "ensemble"))


@query("M5")
def network_mean_variance_predictions(t):
    return _predict(t, make_surrogate("network", "mve"))


@query("M6")
def network_dropout_predictions(t):
    return _predict(t, make_surrogate("network", "dropout"))


@query(
    "M7",
    f"SELECT vec_id AS id, round({uniform_sql('vec_id', 1)}, 6) AS y_mean, round({uniform_sql('vec_id', 2)}, 6) AS y_var FROM embeddings",
)
def random_predictions(t):
    return _predict(t, make_surrogate("random", seed=1))


# --- one feature: the models have closed forms ----------------------------------------------------------------------

ONE_FEATURE = (
    "train AS (SELECT l_orderkey AS id, CAST(sum(l_quantity) AS DOUBLE) AS x, CAST(sum(l_extendedprice) AS DOUBLE) / 1000 AS y "
    "FROM lineitem GROUP BY 1)"
)
LINE = "line AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM train)"


def _orders_as_rows(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array(F.sum("l_quantity").cast("double")).alias("features"), (F.sum("l_extendedprice").cast("double") / 1000).alias("score")
    )


def _one_feature(t: Tables, model, mean_only: bool = False) -> DataFrame:
    rows = _orders_as_rows(t)
    return model.fit(rows).predict(rows.select("id", "features"), mean_only).select("id", F.round("y_mean", 4).alias("y_mean"), F.round("y_var", 4).alias("y_var"))


@query("M3 M8", f"WITH {ONE_FEATURE}, {LINE} SELECT id, round(a + b * x, 4) AS y_mean FROM train, line")
def single_feature_regression(t):
    """Least squares."""
    return _one_feature(t, make_surrogate("nn", reg=0.0), mean_only=True).drop("y_var")


@query("M3 M8", f"WITH {ONE_FEATURE}, {LINE} SELECT id, round(a + b * x, 4) AS y_mean FROM train, line")
def single_unit_network(t):
    """One hidden unit without a bend can give any line, and the solved last layer gives the best."""
    return _one_feature(t, make_surrogate("network", hidden=(1,), activation="linear", epochs=5), mean_only=True).drop("y_var")


@query("M5", f"WITH {ONE_FEATURE} SELECT id, round(mu, 4) AS y_mean, round(v, 4) AS y_var FROM train, (SELECT avg(y) AS mu, var_pop(y) AS v FROM train)")
def constant_feature_network(t):
    """Of rows that look alike the two outputs are mean and variance."""
    rows = _orders_as_rows(t).withColumn("features", F.array(F.lit(1.0)))
    model = make_surrogate("network", "mve", hidden=(4,), held_out=0.0, epochs=5).fit(rows)
    return model.predict(rows.select("id", "features"), False).select("id", F.round("y_mean", 4).alias("y_mean"), F.round("y_var", 4).alias("y_var"))


@query(
    "M2",
    f"""
    WITH {ONE_FEATURE}, scale AS (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM train),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum((y - mu) / sd) AS sy, sum(x * (y - mu) / sd) AS sxy,
                 sum(((y - mu) / sd) * ((y - mu) / sd)) AS syy FROM train, scale),
    r AS (SELECT *, ((sxx + 1e-3) * sy - sx * sxy) / ((n + 1e-3) * (sxx + 1e-3) - sx * sx) AS r0,
                 ((n + 1e-3) * sxy - sx * sy) / ((n + 1e-3) * (sxx + 1e-3) - sx * sx) AS r1 FROM s),
    e AS (SELECT *, greatest((syy - 2 * (r0 * sy + r1 * sxy) + n * r0 * r0 + 2 * sx * r0 * r1 + sxx * r1 * r1) / greatest(n - 2, 1), 1e-6) AS v FROM r),
    b AS (SELECT *, n / v + 1 AS b11, sx / v AS b12, sxx / v + 1 AS b22 FROM e),
    c AS (SELECT *, b22 / (b11 * b22 - b12 * b12) AS c11, -b12 / (b11 * b22 - b12 * b12) AS c12, b11 / (b11 * b22 - b12 * b12) AS c22 FROM b)
    SELECT id, round((c11 * sy + c12 * sxy + (c12 * sy + c22 * sxy) * x) / v * sd + mu, 4) AS y_mean,
           round((c11 + 2 * c12 * x + c22 * x * x) * sd * sd, 4) AS y_var FROM train, scale, c
    """,
)
def single_feature_process(t):
    """The posterior of a Gaussian process with a dot kernel is that of two weights."""
    return _one_feature(t, make_surrogate("gp"))


@query(
    "M2",
    f"""
    WITH {ONE_FEATURE}, scale AS (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM train),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum((y - mu) / sd) AS sy, sum(x * (y - mu) / sd) AS sxy,
                 sum(((y - mu) / sd) * ((y - mu) / sd)) AS syy FROM train, scale),
    g AS (SELECT pow(2.0, i) AS p, pow(2.0, j) AS v FROM (SELECT unnest(range({PRIORS[0]}, {PRIORS[1] + 1})) AS i), (SELECT unnest(range({NOISES[0]}, {NOISES[1] + 1})) AS j)),
    a AS (SELECT *, n / v + 1 / p AS b11, sx / v AS b12, sxx / v + 1 / p AS b22 FROM s, g),
    b AS (SELECT *, b11 * b22 - b12 * b12 AS det FROM a),
    f AS (SELECT *, (b22 * sy - b12 * sxy) / det / v AS w0, (b11 * sxy - b12 * sy) / det / v AS w1 FROM b),
    e AS (SELECT *, -0.5 * (n * ln(2 * pi() * v) + ln(det * p * p) + greatest(syy - w0 * sy - w1 * sxy, 0) / v) AS evidence FROM f),
    c AS (SELECT * FROM e ORDER BY evidence DESC LIMIT 1)
    SELECT id, round((w0 + w1 * x) * sd + mu, 4) AS y_mean, round((b22 - 2 * b12 * x + b11 * x * x) / det * sd * sd, 4) AS y_var, p AS prior, v AS noise FROM train, scale, c
    """,
)
def single_feature_process_by_evidence(t):
    """Prior variance and noise are the powers of two of most evidence, which SQL finds by trying all of them."""
    model = make_surrogate("gp", evidence=True, refine=0)
    found = _one_feature(t, model)
    return found.withColumns({"prior": F.lit(model.chosen["prior"]), "noise": F.lit(model.chosen["noise"])})


@query(
    "M1 M8",
    """
    WITH train AS (SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS x, CAST(sum(l_extendedprice) AS DOUBLE) / 1000 AS y FROM lineitem GROUP BY 1),
    cuts AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS c FROM (SELECT DISTINCT x FROM train) QUALIFY c IS NOT NULL),
    sides AS (SELECT c, count(*) FILTER (WHERE x <= c) * var_pop(y) FILTER (WHERE x <= c) + count(*) FILTER (WHERE x > c) * var_pop(y) FILTER (WHERE x > c) AS left_over,
              avg(y) FILTER (WHERE x <= c) AS low, avg(y) FILTER (WHERE x > c) AS high FROM train, cuts GROUP BY c),
    best AS (SELECT * FROM sides ORDER BY left_over, c LIMIT 1)
    SELECT id, round(CASE WHEN x <= c THEN low ELSE high END, 4) AS y_mean, 0.0 :: DOUBLE AS y_var FROM train, best
    """,
)
def single_feature_forest(t):
    """One tree of one split over the number of lines: the split that leaves least variance."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array(F.count(F.lit(1)).cast("double")).alias("features"), (F.sum("l_extendedprice").cast("double") / 1000).alias("score")
    )
    model = make_surrogate("rf", trees=1, max_depth=1, bootstrap=False).fit(rows)
    return model.predict(rows.select("id", "features"), False).select("id", F.round("y_mean", 4).alias("y_mean"), F.round("y_var", 4).alias("y_var"))


def _ensemble_sql(members: int = 5, seed: int = 42) -> str:
    bounds, mass, total = [], math.exp(-1.0), 0.0
    for k in range(8):
        total += mass
        bounds.append(total)
        mass /= k + 1
    weight = "CASE " + " ".join(f"WHEN u < {b!r} THEN {k}.0" for k, b in enumerate(bounds)) + " ELSE 8.0 END"
    parts = [
        f"SELECT {i} AS m, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS b, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my "
        f"FROM (SELECT x, y, {weight} AS w FROM (SELECT x, y, {uniform_sql('id', seed + i)} AS u FROM train))"
        for i in range(members)
    ]
    return (
        f"WITH {ONE_FEATURE}, fits AS ({' UNION ALL '.join(parts)}), p AS (SELECT id, my + b * (x - mx) AS f FROM train, fits) "
        "SELECT id, round(avg(f), 4) AS y_mean, round(var_pop(f), 4) AS y_var FROM p GROUP BY id"
    )


@query("M4", _ensemble_sql())
def single_feature_ensemble(t):
    """Each member is a weighted least-squares line, its weights drawn from the hash of the id."""
    return _one_feature(t, make_surrogate("nn", "ensemble", reg=0.0))


@query(
    "M5",
    f"WITH {ONE_FEATURE}, {LINE}, spread AS (SELECT x, ln(greatest((y - a - b * x) * (y - a - b * x), 1e-5)) AS s FROM train, line), "
    "l2 AS (SELECT regr_intercept(s, x) AS a2, regr_slope(s, x) AS b2 FROM spread) "
    f"SELECT id, round(a + b * x, 4) AS y_mean, round(exp(a2 + b2 * x - ({LOG_CHI_MEAN!r})), 4) AS y_var FROM train, line, l2",
)
def single_feature_mean_variance(t):
    return _one_feature(t, make_surrogate("nn", "mve", reg=0.0))


@query(
    "M6",
    f"WITH {ONE_FEATURE}, {LINE}, passes AS (SELECT CASE WHEN {uniform_sql('p', 42)} >= 0.2 THEN 1.25 ELSE 0.0 END AS k FROM (SELECT unnest(range(10)) AS p)), "
    "f AS (SELECT id, a + b * x * k AS f FROM train, line, passes) SELECT id, round(avg(f), 4) AS y_mean, round(var_pop(f), 4) AS y_var FROM f GROUP BY id",
)
def single_feature_dropout(t):
    """With one feature a pass keeps it or leaves it out."""
    return _one_feature(t, make_surrogate("nn", "dropout", reg=0.0))


@query("C1 A4")
def feature_clusters(t):
    return cluster_pool(vector_pool(t), 10).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def _minibatch_sql(rounds: int, size: int, seed: int = 42) -> str:
    """Two centres in one dimension; a batch is the share of an epoch that the hash of the id gives it."""
    text = (
        f"WITH {ONE_FEATURE}, n AS (SELECT count(*) AS n, greatest(1, count(*) // {size}) AS per FROM train), "
        f"start AS (SELECT row_number() OVER (ORDER BY {uniform_sql('id', seed)}, id) AS i, x FROM train QUALIFY i <= 2), "
        "c0 AS MATERIALIZED (SELECT max(CASE WHEN i = 1 THEN x END) AS p, max(CASE WHEN i = 2 THEN x END) AS q, 0.0 :: DOUBLE AS np, 0.0 :: DOUBLE AS nq FROM start)"
    )
    for t in range(rounds):
        epoch = " ".join(f"WHEN {t} // per = {e} THEN CAST(floor({uniform_sql('id', seed + 1 + e)} * per) AS BIGINT)" for e in range(t + 1))
        text += (
            f", b{t} AS (SELECT x, (x - p) * (x - p) <= (x - q) * (x - q) AS on_p FROM train, n, c{t} WHERE CASE {epoch} END = {t} % per), "
            f"s{t} AS (SELECT coalesce(sum(x) FILTER (WHERE on_p), 0) AS sp, coalesce(sum(x) FILTER (WHERE NOT on_p), 0) AS sq, "
            f"CAST(count(*) FILTER (WHERE on_p) AS DOUBLE) AS mp, CAST(count(*) FILTER (WHERE NOT on_p) AS DOUBLE) AS mq FROM b{t}), "
            f"c{t + 1} AS MATERIALIZED (SELECT p + CASE WHEN mp > 0 THEN (sp - mp * p) / (np + mp) ELSE 0 END AS p, q + CASE WHEN mq > 0 THEN (sq - mq * q) / (nq + mq) ELSE 0 END AS q, "
            f"np + mp AS np, nq + mq AS nq FROM c{t}, s{t})"
        )
    return text + f" SELECT id, CASE WHEN (x - p) * (x - p) <= (x - q) * (x - q) THEN 0 ELSE 1 END AS cluster_id FROM train, c{rounds}"


@query("C1", _minibatch_sql(6, 500))
def single_feature_minibatch(t):
    """Six batches of about 500 orders, two centres."""
    rows = _orders_as_rows(t).select("id", "features")
    return assign_clusters(rows, fit_minibatch(rows, 2, MiniBatch(500, 6, starts=0))).select("id", "cluster_id")


@query("C2")
def feature_clusters_bisecting(t):
    return cluster_pool(vector_pool(t), 10, "bisecting").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def explore_vectors(t: Tables, config: RunConfig, model, pool: DataFrame | None = None) -> Exploration:
    return Exploration(
        t.spark, vector_pool(t) if pool is None else pool, lookup_objective(vector_labels(t)), model, config,
        scratch_path(t.spark, "run"),
    )


FLAGSHIP = RunConfig(metric="ucb", init_size=0.05, batch_sizes=(0.05,), k=20, max_iters=3, delta=-1.0)


@query("L2 L3 L4 L9 U1 W6")
def exploration(t):
    """An initial batch and three batches chosen by confidence bound with a Gaussian process."""
    rows = explore_vectors(t, FLAGSHIP, make_surrogate("gp")).run()
    return rows.select("iter", "n_scores", "n_new", r6("batch_mean").alias("batch_mean"), r6("top_k_avg").alias("top_k_avg"))


@query("L2 L7 S16 P8")
def exploration_with_pruning(t):
    """The same with pruning; the retained ids of every round are listed with their number."""
    config = RunConfig(metric="ei", init_size=0.1, batch_sizes=(0.05,), k=20, max_iters=2, delta=-1.0, prune=True)
    run = explore_vectors(t, config, make_surrogate("nn", "ensemble"))
    run.run()
    return run.log.read("retained").groupBy("iter").agg(F.count(F.lit(1)).alias("n_retained"))


@query("L2 T9 C1 W7")
def exploration_by_cluster(t):
    """Batches with annealed shares per feature cluster."""
    pool = cluster_pool(vector_pool(t), 8).select("id", "features", "cluster_id")
    config = RunConfig(init_size=0.05, batch_sizes=(0.05,), k=20, max_iters=2, delta=-1.0, temp_i=2.0)
    rows = explore_vectors(t, config, make_surrogate("nn"), pool).run()
    return rows.select("iter", "n_scores", "n_new")


@query("L2 L3 X2 X6 U2 M2")
def exploration_of_documents(t):
    """Strings to fingerprints to predictions: distinct documents, their whole texts as 2048 bits, looked-up quality.

    The fingerprints are written once, as the pool is read again in every round.
    """
    texts = spread_few_splits(t.documents.select(F.col("doc_id").alias("id"), "text")).filter(has_tokens(F.col("text")))
    bits = texts.select("id", fingerprint(F.col("text"), "pair").alias("bits"), F.md5(F.col("text").cast("binary")).alias("copy"))
    distinct = bits.groupBy("copy").agg(F.min(F.struct("id", "bits")).alias("first"))
    path = scratch_path(t.spark, "fingerprints")
    distinct.select("first.id", "first.bits").write.parquet(path)
    pool = t.spark.read.parquet(path).select("id", dense_bits(F.col("bits"), 2048).alias("features"))
    labels = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    config = RunConfig(init_size=0.3, batch_sizes=(0.1,), k=20, max_iters=2, delta=-1.0)
    run = Exploration(t.spark, pool, lookup_objective(labels), make_surrogate("gp"), config, scratch_path(t.spark, "run"))
    return run.run().select("iter", "n_scores", "n_new", r6("batch_mean").alias("batch_mean"), r6("top_k_avg").alias("top_k_avg"))


@query("L17 L10")
def parameter_sweep(t):
    """Confidence-bound widths compared by their final top-k average."""

    def run(params, trial):
        config = RunConfig(metric="ucb", beta=params["beta"], init_size=0.05, batch_sizes=(0.05,), k=20, max_iters=2, delta=-1.0)
        e = explore_vectors(t, config, make_surrogate("gp"))
        e.run()
        return e.recent_avgs[-1]

    table, _ = sweep(t.spark, [{"beta": 0.0}, {"beta": 2.0}], run)
    return table.select("trial", F.element_at("params", "beta").alias("beta"), r6("top_k_avg").alias("top_k_avg"))


def _random_run_sql(pool: str, share: float, seed: int = 42) -> str:
    """Three batches of random acquisition from ``pool(id, y)``; ``u`` is the utility by which each was drawn."""
    size = f"(SELECT CAST(ceil(CAST({share} AS DOUBLE) * n) AS BIGINT) FROM size)"
    draw = [uniform_sql("id", seed + i) for i in range(3)]
    return f"""
pool AS ({pool}), size AS (SELECT count(*) AS n FROM pool),
    b0 AS (SELECT id, y, {draw[0]} AS u FROM pool ORDER BY {draw[0]} DESC, id DESC LIMIT {size}),
    b1 AS (SELECT id, y, {draw[1]} AS u FROM pool WHERE id NOT IN (SELECT id FROM b0) ORDER BY {draw[1]} DESC, id DESC LIMIT {size}),
    b2 AS (SELECT id, y, {draw[2]} AS u FROM pool WHERE id NOT IN (SELECT id FROM b0) AND id NOT IN (SELECT id FROM b1) ORDER BY {draw[2]} DESC, id DESC LIMIT {size}),
    e AS (SELECT 0 AS iter, * FROM b0 UNION ALL SELECT 1, * FROM b1 UNION ALL SELECT 2, * FROM b2)
"""


RANDOM_RUN = _random_run_sql("SELECT o_orderkey AS id, o_totalprice / 1000 AS y FROM orders", 0.01)
VECTOR_SCORES = (
    "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 3.0 - CAST(embedding[2] AS DOUBLE) * 2.0 + embedding[3] + embedding[4] * embedding[5] + (label - 4.5) * 0.01 AS y FROM embeddings"
)
VECTOR_RUN = RunConfig(metric="random", init_size=0.05, batch_sizes=(0.05,), k=20, max_iters=2, delta=-1.0)


def _random_vector_run(t: Tables, path: str, config: RunConfig = VECTOR_RUN, resume: bool = False) -> Exploration:
    model = make_surrogate("random", seed=config.seed)
    return Exploration(t.spark, vector_pool(t).select("id", "features"), lookup_objective(vector_labels(t)), model, config, path, resume=resume, run_id="vectors")


@query(
    "S13 L9 S14",
    f"""
    WITH {_random_run_sql(VECTOR_SCORES, 0.05)}, it AS (SELECT unnest([0, 1, 2]) AS i)
    SELECT CAST(i AS INTEGER) AS iter, (SELECT count(*) FROM e WHERE iter <= i) AS n_scores, round((SELECT avg(y) FROM e WHERE iter = i), 5) AS batch_mean,
           CASE WHEN (SELECT count(*) FROM e WHERE iter <= i) >= 20 THEN round((SELECT avg(y) FROM (SELECT y FROM e WHERE iter <= i ORDER BY y DESC, id DESC LIMIT 20)), 5) END AS top_k_avg,
           'vectors' AS run_id, 'random' AS metric, '20' AS k FROM it
    """,
)
def resumed_exploration(t):
    """A run that stops after a round and is taken up again by another object, from its log; the options come back from the log too. The rows are those of a run in one go."""
    path = scratch_path(t.spark, "run")
    first = _random_vector_run(t, path)
    first.explore_initial()
    first.explore_batch()
    again = _random_vector_run(t, path, resume=True)
    rows = again.run()
    options = again.log.read_config().where("option IN ('metric', 'k')").groupBy("run_id").pivot("option", ["metric", "k"]).agg(F.first("value"))
    rows = rows.select("iter", "n_scores", F.round("batch_mean", 5).alias("batch_mean"), F.round("top_k_avg", 5).alias("top_k_avg"))
    return rows.join(F.broadcast(options))  # one row


@query("M14 M3", f"WITH {ONE_FEATURE}, {LINE} SELECT id, round(a + b * x, 4) AS y_mean FROM train, line")
def reloaded_model_predictions(t):
    """A saved model, loaded into a new object, predicts the same line."""
    rows, path = _orders_as_rows(t), scratch_path(t.spark, "model")
    options = {"hidden": (1,), "activation": "linear", "epochs": 5}
    make_surrogate("network", **options).fit(rows).save(path)
    model = make_surrogate("network", **options).load(path)
    return model.predict(rows.select("id", "features")).select("id", F.round("y_mean", 4).alias("y_mean"))


SWEPT = (42, 1234)


@query(
    "L17 L10",
    " UNION ALL ".join(
        f"SELECT {i} AS trial, '{seed}' AS seed, round(v, 5) AS top_k_avg FROM (WITH {_random_run_sql(VECTOR_SCORES, 0.05, seed)} SELECT avg(y) AS v FROM (SELECT y FROM e ORDER BY y DESC, id DESC LIMIT 20))"
        for i, seed in enumerate(SWEPT)
    ),
)
def seed_sweep(t):
    """Random runs of several seeds, compared by their final top-k average."""

    def run(params, trial):
        e = _random_vector_run(t, scratch_path(t.spark, "run"), replace(VECTOR_RUN, seed=params["seed"]))
        e.run()
        return e.recent_avgs[-1]

    table, _ = sweep(t.spark, [{"seed": seed} for seed in SWEPT], run)
    return table.select("trial", F.element_at("params", "seed").alias("seed"), F.round("top_k_avg", 5).alias("top_k_avg"))


@query(
    "L1 L2 L3 L4 U2",
    f"""
    WITH {RANDOM_RUN},
    it AS (SELECT unnest([0, 1, 2]) AS i)
    SELECT CAST(i AS INTEGER) AS iter, (SELECT count(*) FROM e WHERE iter <= i) AS n_scores, (SELECT count(*) FROM e WHERE iter = i) AS n_new,
           round((SELECT avg(y) FROM e WHERE iter = i), 6) AS batch_mean,
           CASE WHEN (SELECT count(*) FROM e WHERE iter <= i) >= 50 THEN
           round((SELECT avg(y) FROM (SELECT y, row_number() OVER (ORDER BY y DESC, id DESC) AS place FROM e WHERE iter <= i) WHERE place <= 50), 6) END AS top_k_avg
    FROM it
    """,
)
def random_exploration(t):
    """Random acquisition, the baseline every model has to beat; the whole run has a plain SQL equivalent."""
    rows = _random_run(t).run()
    return rows.select("iter", "n_scores", "n_new", r6("batch_mean").alias("batch_mean"), r6("top_k_avg").alias("top_k_avg"))


def _random_run(t: Tables) -> Exploration:
    pool = preds(t).select("id", F.array("y_mean").alias("features"))
    labels = preds(t).select("id", F.col("y_mean").alias("score"))
    config = RunConfig(metric="random", init_size=0.01, batch_sizes=(0.01,), k=50, max_iters=2, delta=-1.0)
    return Exploration(t.spark, pool, lookup_objective(labels), make_surrogate("random"), config, scratch_path(t.spark, "run"), run_id="random")


@query(
    "S12 L2 L11 W1 W2 W3 W4 T7",
    f"""
    WITH {RANDOM_RUN},
    o AS (SELECT iter, id, y, row_number() OVER (ORDER BY iter, u DESC, id DESC) AS seq FROM e),
    hits AS (SELECT id, y FROM pool ORDER BY y DESC, id DESC LIMIT 50), low AS (SELECT min(y) AS t FROM hits),
    ties AS (SELECT count(*) AS n FROM hits, low WHERE y = t),
    best AS (SELECT s.seq, sum(s.y) / 50.0 AS v FROM (SELECT a.seq, b.y, row_number() OVER (PARTITION BY a.seq ORDER BY b.y DESC, b.id DESC) AS place FROM o a JOIN o b ON b.seq <= a.seq) s WHERE place <= 50 GROUP BY 1)
    SELECT 'random' AS run_id, CAST(iter AS INTEGER) AS iter, o.seq, o.id,
           round(avg(o.y) OVER (ORDER BY o.seq), 4) AS running_mean,
           count(h.id) OVER (ORDER BY o.seq) / 50.0 AS recall,
           (count(*) FILTER (WHERE o.y > t) OVER (ORDER BY o.seq) + least(count(*) FILTER (WHERE o.y = t) OVER (ORDER BY o.seq), ties.n)) / 50.0 AS score_recall,
           round(b.v, 6) AS top_k_avg
    FROM o LEFT JOIN hits h ON h.id = o.id JOIN best b ON b.seq = greatest(o.seq, least(50, (SELECT count(*) FROM o))), low, ties
    """,
)
def curves_of_a_run(t):
    """Recall, running mean and top-k average of a finished run, from its own log."""
    run = _random_run(t)
    run.run()
    log = cut(run.acquisitions())
    hits = curves.true_top(preds(t).select("id", F.col("y_mean").alias("score")), 50)
    key = ["run_id", "iter", "seq", "id"]
    found = curves.recall_by_identity(log, hits, 50).select(*key, "recall")
    by_score = curves.recall_by_score(log, hits, 50).select(*key, F.col("recall").alias("score_recall"))
    means = curves.running_mean(log).select(*key, F.round("running_mean", 4).alias("running_mean"))
    best = curves.running_top_k_average(log, 50)
    best = best.select("run_id", "seq", r6("top_k_avg").alias("top_k_avg"))
    return found.join(by_score, key).join(means, key).join(best, ["run_id", "seq"])
