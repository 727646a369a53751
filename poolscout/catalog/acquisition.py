"""Utilities, batches and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import batch_rows, top_k_rows
from ..functions import scaling
from ..functions.utility import UtilityOptions, with_utility
from ..operators import acquire, prune
from ..operators.ordered import top_n
from ..plans.curves import true_top
from .registry import (
    explored,
    hit_probability_sql,
    normal_sql,
    pdf_sql,
    phi_sql,
    preds,
    pool_scores,
    query,
    r6,
    uniform_sql,
)

THRESHOLD = 300.0
TOP = 100

BEST_SQL = (
    f"(SELECT CASE WHEN count(*) >= {TOP} THEN min(y) ELSE max(y) END FROM "
    f"(SELECT coalesce(score, CAST('-inf' AS DOUBLE)) AS y FROM explored ORDER BY 1 DESC LIMIT {TOP}))"
)


def _utility(t, metric: str, options: UtilityOptions = UtilityOptions(), **scalars):
    return with_utility(preds(t), metric, options, **scalars).select("id", r6("utility").alias("utility"))


def _best(t):
    return acquire.kth_best(explored(t), TOP).scalar()


@query("F1 M7", f"SELECT id, round({uniform_sql('id', 42)}, 6) AS utility FROM preds", ("preds",))
def utility_random(t):
    return _utility(t, "random")


@query(
    "F2",
    f"SELECT id, CASE WHEN y_mean >= {THRESHOLD} THEN round({uniform_sql('id', 42)}, 6) ELSE -1.0 END AS utility FROM preds",
    ("preds",),
)
def utility_threshold(t):
    return _utility(t, "threshold", UtilityOptions(threshold=THRESHOLD))


@query("F3", "SELECT id, round(y_mean, 6) AS utility FROM preds", ("preds",))
def utility_greedy(t):
    return _utility(t, "greedy")


@query(
    "F4",
    f"SELECT id, round(y_mean + (SELECT stddev_pop(y_mean) FROM preds) * {normal_sql('id', 42)}, 6) AS utility FROM preds",
    ("preds",),
)
def utility_noisy(t):
    return _utility(t, "noisy", mean_sd=preds(t).agg(F.stddev_pop("y_mean").alias("s")).scalar())


@query("F5", "SELECT id, round(y_mean + 2.0 * sqrt(y_var), 6) AS utility FROM preds", ("preds",))
def utility_upper_bound(t):
    return _utility(t, "ucb")


@query("F6", "SELECT id, round(y_mean - 2.0 * sqrt(y_var), 6) AS utility FROM preds", ("preds",))
def utility_lower_bound(t):
    return _utility(t, "lcb")


@query("F7", f"SELECT id, round(y_mean + sqrt(y_var) * {normal_sql('id', 42)}, 6) AS utility FROM preds", ("preds",))
def utility_thompson(t):
    return _utility(t, "thompson")


GAIN_SQL = (
    f"SELECT *, gain / nullif(sd, 0) AS z FROM (SELECT *, y_mean - {BEST_SQL} + 0.01 AS gain, sqrt(y_var) AS sd FROM preds)"
)


@query(
    "F8 A3",
    f"SELECT id, round(CASE WHEN sd = 0 THEN gain ELSE gain * {phi_sql('z')} + sd * {pdf_sql('z')} END, 6) AS utility "
    f"FROM ({GAIN_SQL})",
    ("preds", "explored"),
)
def utility_expected_improvement(t):
    return _utility(t, "ei", best=_best(t))


@query(
    "F9 A3",
    f"SELECT id, round(CASE WHEN sd = 0 THEN CAST(gain > 0 AS DOUBLE) ELSE {phi_sql('z')} END, 6) AS utility "
    f"FROM ({GAIN_SQL})",
    ("preds", "explored"),
)
def utility_probability_of_improvement(t):
    return _utility(t, "pi", best=_best(t))


@query(
    "F10",
    f"SELECT id, round(p_hit, 6) AS p_hit FROM ({hit_probability_sql('preds', str(THRESHOLD))})",
    ("preds",),
)
def hit_probability(t):
    return prune.with_hit_probability(preds(t), THRESHOLD).select("id", r6("p_hit").alias("p_hit"))


@query("A3", f"SELECT round({BEST_SQL}, 6) AS best", ("explored",))
def kth_best_label(t):
    return acquire.kth_best(explored(t), TOP).select(r6("best").alias("best"))


# --- batches ----------------------------------------------------------------------------------------------------------

INIT = 0.01
INIT_ROWS_SQL = f"(SELECT CAST(ceil({INIT} * CAST(count(*) AS DOUBLE)) AS BIGINT) FROM preds)"


@query(
    "T2",
    f"SELECT id, round(u, 6) AS utility FROM (SELECT id, {uniform_sql('id', 42)} AS u FROM preds) "
    f"ORDER BY u DESC, id DESC LIMIT {INIT_ROWS_SQL}",
    ("preds",),
)
def initial_batch(t):
    pool = preds(t)
    batch = acquire.initial_batch(pool.select("id"), batch_rows(INIT, pool.count()), 42)
    return batch.select("id", r6("utility").alias("utility"))


@query(
    "T3 W7",
    f"""
    WITH sized AS (SELECT id, cluster_id, {uniform_sql('id', 42)} AS u, count(*) OVER (PARTITION BY cluster_id) AS n,
                          count(*) OVER () AS total FROM preds),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY u DESC, id DESC) AS place,
                      ceil(CAST({INIT_ROWS_SQL} AS DOUBLE) * n / CAST(total AS DOUBLE)) AS quota FROM sized)
    SELECT id, cluster_id, round(u, 6) AS utility FROM ranked WHERE place <= quota
    """,
    ("preds",),
)
def initial_batch_by_cluster(t):
    pool = preds(t).select("id", "cluster_id")
    batch = acquire.initial_batch_by_cluster(pool, batch_rows(INIT, pool.count()), 42)
    return batch.select("id", "cluster_id", r6("utility").alias("utility"))


@query("J2", "SELECT id FROM preds WHERE id NOT IN (SELECT id FROM explored)", ("preds", "explored"))
def unlabelled_candidates(t):
    return acquire.exclude_explored(preds(t).select("id"), explored(t))


@query(
    "T1 J2",
    f"SELECT id, round(u, 6) AS utility FROM (SELECT id, y_mean + 2.0 * sqrt(y_var) AS u FROM preds "
    f"WHERE id NOT IN (SELECT id FROM explored)) ORDER BY u DESC, id DESC LIMIT {INIT_ROWS_SQL}",
    ("preds", "explored"),
)
def acquire_batch(t):
    pool = preds(t)
    scored = with_utility(pool, "ucb").select("id", "utility")
    batch = acquire.acquire_batch(scored, explored(t), batch_rows(INIT, pool.count()))
    return batch.select("id", r6("utility").alias("utility"))


@query(
    "T1",
    "SELECT id, round(y_mean, 6) AS utility FROM preds WHERE id NOT IN (SELECT id FROM explored) "
    "QUALIFY row_number() OVER (ORDER BY y_mean DESC, id DESC) <= (SELECT count(*) // 4 FROM preds)",
    ("preds", "explored"),
)
def acquire_large_batch(t):
    """A quarter of the pool through the distributed ranking that large batches take."""
    pool = preds(t)
    open_rows = acquire.exclude_explored(pool.select("id", F.col("y_mean").alias("utility")), explored(t))
    batch = top_n(open_rows, pool.count() // 4, acquire.best_utility(), "utility", gather_rows=0)
    return batch.select("id", r6("utility").alias("utility"))


@query(
    "T4",
    f"""
    WITH open_rows AS (SELECT id, y_mean AS u, {uniform_sql('id', 7)} AS r FROM preds WHERE id NOT IN (SELECT id FROM explored)),
    drawn AS (SELECT id FROM open_rows ORDER BY r DESC, id DESC LIMIT (SELECT CAST(ceil({INIT_ROWS_SQL} * 0.2) AS BIGINT))),
    flagged AS (SELECT o.id, o.u, d.id IS NOT NULL AS is_random FROM open_rows o LEFT JOIN drawn d USING (id))
    SELECT id, is_random FROM flagged ORDER BY is_random DESC, CASE WHEN is_random THEN 0 ELSE u END DESC, id DESC
    LIMIT {INIT_ROWS_SQL}
    """,
    ("preds", "explored"),
)
def acquire_batch_epsilon(t):
    pool = preds(t)
    scored = pool.select("id", F.col("y_mean").alias("utility"))
    batch = acquire.acquire_batch(scored, explored(t), batch_rows(INIT, pool.count()), epsilon=0.2, seed=7)
    return batch.select("id", (F.col("utility") == float("inf")).alias("is_random"))


@query(
    "T9 F14 W7",
    f"""
    WITH best AS (SELECT max(y_mean) AS g FROM preds),
    sizes AS (SELECT cluster_id, count(*) AS n FROM preds GROUP BY 1),
    open_rows AS (SELECT id, cluster_id, y_mean FROM preds WHERE id NOT IN (SELECT id FROM explored)),
    locals AS (SELECT cluster_id, max(y_mean) AS l FROM open_rows GROUP BY 1),
    quotas AS (SELECT cluster_id, ceil(exp(-((SELECT g FROM best) - l) / ((10.0 - 1.0) * exp(-2) + 1.0))
                 * ceil(CAST({INIT_ROWS_SQL} AS DOUBLE) * n / CAST((SELECT count(*) FROM preds) AS DOUBLE))) AS quota
               FROM sizes JOIN locals USING (cluster_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY y_mean DESC, id DESC) AS place FROM open_rows)
    SELECT id, cluster_id FROM ranked JOIN quotas USING (cluster_id) WHERE place <= quota
    """,
    ("preds", "explored"),
)
def acquire_batch_by_cluster(t):
    pool = preds(t)
    scored = pool.select("id", "cluster_id", "y_mean", F.col("y_mean").alias("utility"))
    n = batch_rows(INIT, pool.count())
    return acquire.acquire_batch_by_cluster(scored, explored(t), n, 2, 10.0, 1.0).select("id", "cluster_id")


@query(
    "F14",
    "SELECT cluster_id, round(exp(-((SELECT max(y_mean) FROM preds) - max(y_mean)) / ((10.0 - 1.0) * exp(-2) + 1.0)), 6) "
    "AS decay FROM preds GROUP BY cluster_id",
    ("preds",),
)
def cluster_decay(t):
    best = preds(t).agg(F.max("y_mean").alias("g")).scalar()
    local = preds(t).groupBy("cluster_id").agg(F.max("y_mean").alias("l"))
    decay = scaling.cluster_decay(best, F.col("l"), scaling.temperature(2, 10.0, 1.0))
    return local.select("cluster_id", r6(decay).alias("decay"))


@query(
    "T5",
    f"SELECT id, round(score, 6) AS score FROM explored ORDER BY score DESC NULLS LAST, id DESC LIMIT {TOP}",
    ("explored",),
)
def top_explored(t):
    return acquire.top_explored(explored(t), TOP).select("id", r6("score").alias("score"))


@query("T6", f"SELECT id, round(y_mean, 6) AS y_mean FROM preds ORDER BY preds.y_mean DESC, id DESC LIMIT {TOP}", ("preds",))
def top_predicted(t):
    return acquire.top_predicted(preds(t), TOP).select("id", r6("y_mean").alias("y_mean"))


@query("T7", "SELECT id, score FROM pool_scores QUALIFY row_number() OVER (ORDER BY score DESC, id DESC) <= (SELECT greatest(1, CAST(floor(0.005 * count(*)) AS BIGINT)) FROM pool_scores)", ("pool_scores",))
def true_top_k(t):
    scores = pool_scores(t)
    return true_top(scores, top_k_rows(0.005, scores.count()))


@query(
    "T8",
    "SELECT id, score FROM (SELECT id, score, row_number() OVER (ORDER BY id) - 1 AS row_idx FROM explored) "
    "WHERE row_idx < 500 AND score IS NOT NULL",
    ("explored",),
)
def first_with_score(t):
    from ..operators.ordered import rank_within

    log = rank_within(explored(t).select("id", "score"), [], [F.col("id").asc()], "n").withColumn("row_idx", F.col("n") - 1)
    return acquire.first_with_score(log, 500).select("id", "score")


@query(
    "T10",
    f"""
    WITH pool AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders),
    size AS (SELECT count(*) AS n, greatest(1, count(*) // 100) AS k FROM orders),
    draws AS (SELECT d // k AS replicate, d % k AS draw, CAST(floor({uniform_sql('d', 3)} * n) AS BIGINT) AS row_idx
              FROM size, LATERAL (SELECT unnest(range(k * 3)) AS d))
    SELECT CAST(replicate AS INTEGER) AS replicate, draw, id FROM draws JOIN pool USING (row_idx)
    """,
)
def sample_with_replacement(t):
    from ..operators.ordered import rank_within

    pool = t.orders.select(F.col("o_orderkey").alias("id"))
    n = pool.count()
    numbered = rank_within(pool, [], [F.col("id").asc()], "n").select("id", (F.col("n") - 1).alias("row_idx"))
    drawn = acquire.draw_with_replacement(numbered, n, max(1, n // 100), 3, 3)
    return drawn.select("replicate", "draw", F.col("id"))


@query(
    "T11",
    "SELECT id, score FROM pool_scores QUALIFY row_number() OVER (ORDER BY score, id) = 251",
    ("pool_scores",),
)
def score_order_statistic(t):
    return acquire.order_statistic(pool_scores(t), "score", "id", 250).select("id", "score")


# --- pruning ----------------------------------------------------------------------------------------------------------

KTH_MEAN_SQL = f"(SELECT min(y_mean) FROM (SELECT y_mean FROM preds ORDER BY y_mean DESC LIMIT {TOP}))"


@query(
    "P7 P8 L7",
    f"SELECT id, cluster_id FROM ({hit_probability_sql('preds', KTH_MEAN_SQL)}) WHERE p_hit >= 0.025",
    ("preds",),
)
def prune_pool(t):
    threshold = acquire.kth_best(preds(t), TOP, "y_mean").scalar()
    return prune.retain(preds(t), threshold).select("id", "cluster_id")


@query(
    "A5 L7",
    f"SELECT round(coalesce(sum(p_hit), 0.0), 6) AS expected_lost, count(*) AS n_pruned "
    f"FROM ({hit_probability_sql('preds', BEST_SQL)}) WHERE NOT p_hit >= 0.025",
    ("preds", "explored"),
)
def expected_positives_pruned(t):
    threshold = acquire.kth_best(explored(t), TOP).first()["best"]
    pool = preds(t)
    kept = prune.retain(pool, threshold)
    lost = prune.expected_positives_pruned(pool, kept, threshold)
    pruned = acquire.exclude_explored(pool, kept).agg(F.count(F.lit(1)).alias("n")).scalar()
    return lost.select(r6("expected_lost").alias("expected_lost"), pruned.alias("n_pruned"))


@query(
    "A5",
    f"SELECT CAST(count(*) AS DOUBLE) AS expected_lost FROM preds WHERE y_mean >= {THRESHOLD} AND y_mean < 400.0",
    ("preds",),
)
def expected_positives_pruned_by_mean(t):
    kept = preds(t).filter("y_mean >= 400.0")
    return prune.expected_positives_pruned(preds(t), kept, THRESHOLD, with_variance=False)


@query("A4", "SELECT cluster_id, count(*) AS count FROM preds GROUP BY 1", ("preds",))
def cluster_sizes(t):
    return preds(t).groupBy("cluster_id").count()


@query(
    "P8",
    f"SELECT cluster_id, count(*) AS count FROM ({hit_probability_sql('preds', KTH_MEAN_SQL)}) WHERE p_hit >= 0.025 GROUP BY 1",
    ("preds",),
)
def cluster_sizes_after_pruning(t):
    threshold = acquire.kth_best(preds(t), TOP, "y_mean").scalar()
    return prune.retain(preds(t), threshold).groupBy("cluster_id").count()
