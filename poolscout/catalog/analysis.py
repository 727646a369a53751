"""Curves, rewards and costs of finished runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import top_k_rows
from ..functions.scaling import PREDICTION_DOLLARS_PER_ROW, TRAINING_DOLLARS_PER_LABEL
from ..operators import prune, stats
from ..operators.acquire import first_with_score
from ..operators.ordered import rank_within, top_n_each
from ..plans import curves, rewards
from .registry import explored, pool_scores, query, r6, retained_sizes, runs, trials

K_SQL = "(SELECT greatest(1, CAST(floor(0.005 * count(*)) AS BIGINT)) FROM pool_scores)"
HITS_SQL = f"hits AS (SELECT id, score FROM pool_scores QUALIFY row_number() OVER (ORDER BY score DESC, id DESC) <= {K_SQL})"


def _hits(t):
    scores = pool_scores(t)
    k = top_k_rows(0.005, scores.count())
    return curves.true_top(scores, k), k


@query(
    "W1",
    f"""
    WITH {HITS_SQL}, low AS (SELECT min(score) AS m FROM hits), ties AS (SELECT count(*) AS n FROM hits, low WHERE score = m),
    marked AS (SELECT run_id, seq, score > m AS above, score = m AS tie, count(CASE WHEN score = m THEN 1 END) OVER (PARTITION BY run_id ORDER BY seq) AS nth
               FROM runs, low)
    SELECT run_id, seq, round(sum(CASE WHEN above OR (tie AND nth <= (SELECT n FROM ties)) THEN 1 ELSE 0 END)
           OVER (PARTITION BY run_id ORDER BY seq) / CAST({K_SQL} AS DOUBLE), 6) AS recall FROM marked
    """,
    ("runs", "pool_scores"),
)
def recall_curve_by_score(t):
    hits, k = _hits(t)
    return curves.recall_by_score(runs(t), hits, k).select("run_id", "seq", r6("recall").alias("recall"))


@query("J3", f"WITH {HITS_SQL} SELECT run_id, seq, id, id IN (SELECT id FROM hits) AS is_hit FROM runs", ("runs", "pool_scores"))
def true_hit_flags(t):
    return curves.with_hits(runs(t), _hits(t)[0]).select("run_id", "seq", "id", "is_hit")


@query(
    "W2",
    f"WITH {HITS_SQL} SELECT run_id, seq, round(count(h.id) OVER (PARTITION BY run_id ORDER BY seq) / CAST({K_SQL} AS DOUBLE), 6) AS recall "
    "FROM runs LEFT JOIN hits h USING (id)",
    ("runs", "pool_scores"),
)
def recall_curve_by_identity(t):
    hits, k = _hits(t)
    return curves.recall_by_identity(runs(t), hits, k).select("run_id", "seq", r6("recall").alias("recall"))


@query(
    "W3",
    """
    WITH lists AS (SELECT run_id, seq, list(score) FILTER (score IS NOT NULL) OVER (PARTITION BY run_id ORDER BY seq) AS ys FROM runs),
    tops AS (SELECT run_id, seq, coalesce(list_sum(list_reverse_sort(ys)[1:20]), 0) / 20 AS a FROM lists),
    firsts AS (SELECT run_id, arg_max(a, seq) AS a FROM tops WHERE seq <= 20 GROUP BY 1)
    SELECT run_id, seq, round(CASE WHEN seq <= 20 THEN firsts.a ELSE tops.a END, 6) AS top_k_avg FROM tops JOIN firsts USING (run_id)
    """,
    ("runs",),
)
def running_top_k_average(t):
    rows = curves.running_top_k_average(runs(t), 20)
    return rows.select("run_id", "seq", r6("top_k_avg").alias("top_k_avg"))


@query(
    "W4",
    "SELECT run_id, seq, round(round(sum(coalesce(score, 0)) OVER (PARTITION BY run_id ORDER BY seq), 2) / seq, 6) AS running_mean FROM runs",
    ("runs",),
)
def running_mean(t):
    """Rounded through the total in cents, so that both engines divide the same number."""
    total = F.round(F.col("running_mean") * F.col("seq"), 2)
    return curves.running_mean(runs(t)).select("run_id", "seq", r6(total / F.col("seq")).alias("running_mean"))


CLASSES_SQL = (
    "classes AS (SELECT event_id AS id, CASE WHEN n = max(n) OVER () THEN 'large' WHEN n = 1 THEN 'singleton' ELSE 'mid' END AS class "
    "FROM (SELECT event_id, count(*) OVER (PARTITION BY value) AS n FROM events))"
)


def _classes(t):
    """Events with equal values are one cluster."""
    from ..operators.similarity import cluster_classes

    return cluster_classes(t.events.select(F.col("event_id").alias("id"), F.col("value").alias("leader")))


@query(
    "W5",
    f"""
    WITH {CLASSES_SQL}, sizes AS (SELECT count(CASE WHEN class = 'singleton' THEN 1 END) AS s, count(CASE WHEN class = 'mid' THEN 1 END) AS m,
                                         count(CASE WHEN class = 'large' THEN 1 END) AS l FROM classes),
    marked AS (SELECT run_id, seq, class FROM runs JOIN classes USING (id))
    SELECT run_id, seq, round(count(CASE WHEN class = 'singleton' THEN 1 END) OVER w / CAST(nullif(s, 0) AS DOUBLE), 6) AS singleton,
           round(count(CASE WHEN class = 'mid' THEN 1 END) OVER w / CAST(nullif(m, 0) AS DOUBLE), 6) AS mid,
           round(count(CASE WHEN class = 'large' THEN 1 END) OVER w / CAST(nullif(l, 0) AS DOUBLE), 6) AS "large"
    FROM marked, sizes WINDOW w AS (PARTITION BY run_id ORDER BY seq)
    UNION ALL SELECT DISTINCT run_id, 0, 0.0 / nullif(s, 0), 0.0 / nullif(m, 0), 0.0 / nullif(l, 0) FROM runs, sizes
    """,
    ("runs",),
)
def cluster_class_curve(t):
    rows = curves.class_curve(runs(t), _classes(t))
    return rows.select("run_id", "seq", *[r6(c).alias(c) for c in ("singleton", "mid", "large")])


ITERATION_SQL = "iterations AS (SELECT run_id, iter, avg(score) AS top_k_avg FROM runs GROUP BY 1, 2)"


@query(
    "W6 L4",
    f"""
    WITH {ITERATION_SQL}, averaged AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(top_k_avg) OVER w END AS sma FROM iterations
        WINDOW w AS (PARTITION BY run_id ORDER BY iter ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT run_id, iter, round(sma, 6) AS sma, coalesce((top_k_avg - sma) / abs(sma) <= 0.01, false) AS stop FROM averaged
    """,
    ("runs",),
)
def stopping_rule(t):
    iterations = runs(t).groupBy("run_id", "iter").agg(F.avg("score").alias("top_k_avg"))
    return curves.moving_average(iterations, 3, 0.01).select("run_id", "iter", r6("sma").alias("sma"), "stop")


@query("W11 L18", "SELECT run_id, iter, n_new, n_acquired, init_size FROM acquired", ("acquired",))
def acquired_by_iteration(t):
    return curves.acquired_by_iteration(runs(t))


def _cost_sql(prune_arm: bool) -> str:
    n = "(SELECT count(*) FROM events)"
    left = f"coalesce(lag(n_retained) OVER (PARTITION BY run_id ORDER BY iter), {n})" if prune_arm else n
    return (
        f"SELECT run_id, iter, n_acquired, sum(n_acquired * {TRAINING_DOLLARS_PER_LABEL!r}::DOUBLE + predicted * {PREDICTION_DOLLARS_PER_ROW!r}::DOUBLE) "
        f"OVER (PARTITION BY run_id ORDER BY iter) AS cost FROM (SELECT *, {left} AS predicted FROM retained_sizes)"
    )


def _cost(t, prune_arm: bool):
    return curves.cost_curve(retained_sizes(t), t.events.count(), prune_arm)


@query(
    "W8 L16",
    f"SELECT 'full' AS arm, run_id, iter, n_acquired, round(cost, 6) AS cost FROM ({_cost_sql(False)}) UNION ALL "
    f"SELECT 'prune', run_id, iter, n_acquired, round(cost, 6) FROM ({_cost_sql(True)})",
    ("retained_sizes",),
)
def cost_curves(t):
    both = _cost(t, False).withColumn("arm", F.lit("full")).unionByName(_cost(t, True).withColumn("arm", F.lit("prune")))
    return both.select("arm", "run_id", "iter", "n_acquired", r6("cost").alias("cost"))


@query(
    "J7 L16",
    f"""
    WITH costs AS ({_cost_sql(True)}), grid AS (SELECT iter, max(n_acquired) AS x FROM costs GROUP BY iter),
    asked AS (SELECT run_id, x FROM grid, (SELECT DISTINCT run_id FROM costs))
    SELECT asked.run_id, asked.x, round(cost, 6) AS cost FROM asked ASOF LEFT JOIN costs ON asked.run_id = costs.run_id AND asked.x >= costs.n_acquired
    """,
    ("retained_sizes",),
)
def aligned_cost_curves(t):
    from ..session import cut

    costs = cut(_cost(t, True))
    grid = costs.groupBy("iter").agg(F.max("n_acquired").alias("x"))
    every = costs.groupBy("iter").agg(F.collect_set("run_id").alias("_r")).agg(F.array_distinct(F.flatten(F.collect_list("_r"))).alias("r"))
    asked = grid.select(F.explode(every.scalar()).alias("run_id"), "x")
    return curves.align_curves(costs, asked, "n_acquired", "cost").select("run_id", "x", r6("y").alias("cost"))


@query(
    "L16",
    f"WITH full_arm AS ({_cost_sql(False)}), pruned AS ({_cost_sql(True)}) "
    "SELECT iter, round(avg(f.cost), 6) AS full_cost, round(avg(p.cost), 6) AS prune_cost FROM full_arm f JOIN pruned p USING (run_id, iter) "
    "WHERE f.n_acquired < (SELECT max(n_acquired) FROM pruned) GROUP BY iter",
    ("retained_sizes",),
)
def cost_comparison(t):
    full, pruned = _cost(t, False), _cost(t, True)
    longest = pruned.agg(F.max("n_acquired").alias("m")).scalar()
    both = full.withColumnRenamed("cost", "full_cost").filter(F.col("n_acquired") < longest).join(
        pruned.select("run_id", "iter", F.col("cost").alias("prune_cost")), ["run_id", "iter"]
    )
    return both.groupBy("iter").agg(r6(F.avg("full_cost")).alias("full_cost"), r6(F.avg("prune_cost")).alias("prune_cost"))


@query(
    "W9 A7",
    """
    WITH curve AS (SELECT run_id, seq, sum(coalesce(score, 0)) OVER (PARTITION BY run_id ORDER BY seq) AS y FROM runs),
    ends AS (SELECT run_id, max(seq) AS e, arg_max(y, seq) AS last FROM curve GROUP BY 1),
    grid AS (SELECT run_id, unnest(range(e + 1, (SELECT max(seq) + 1 FROM curve))) AS seq, last AS y FROM ends)
    SELECT seq, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS sd FROM (SELECT * FROM curve UNION ALL SELECT * FROM grid) GROUP BY seq
    """,
    ("runs",),
)
def padded_curve_stats(t):
    from ..operators.ordered import running_sums_by_seq

    curve = running_sums_by_seq(runs(t), ["run_id"], "seq", {"y": F.coalesce("score", F.lit(0.0))})
    rows = curves.curve_stats(curves.pad_curves(curve, "y", edge=True), ["seq"], "y")
    return rows.select("seq", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query(
    "W9 A7",
    "SELECT seq, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, count(*) AS n_runs FROM runs GROUP BY seq",
    ("runs",),
)
def curve_stats_with_gaps(t):
    padded = curves.pad_curves(runs(t), "score", edge=False)
    real = runs(t).groupBy("seq").agg(F.count(F.lit(1)).alias("n_runs"))
    stats_rows = curves.curve_stats(padded, ["seq"], "score").join(real, "seq")
    return stats_rows.select("seq", r6("mean").alias("mean"), r6("sd").alias("sd"), "n_runs")


@query("W12", "SELECT DISTINCT seq, round(seq / CAST((SELECT count(*) FROM events) AS DOUBLE), 6) AS recall FROM runs", ("runs",))
def random_search_curve(t):
    return curves.random_curve(runs(t), t.events.count()).select("seq", r6("recall").alias("recall"))


@query(
    "A8",
    "SELECT run_id, CAST((SELECT count(*) FROM events) + sum(CASE WHEN iter <= 4 THEN n_retained ELSE 0 END) AS BIGINT) AS calls, "
    "round(((SELECT count(*) FROM events) + sum(CASE WHEN iter <= 4 THEN n_retained ELSE 0 END)) / CAST((SELECT count(*) FROM events) * 5 AS DOUBLE), 6) AS relative_calls "
    "FROM retained_sizes GROUP BY run_id",
    ("retained_sizes",),
)
def inference_calls(t):
    rows = prune.inference_calls(retained_sizes(t), t.events.count(), 5)
    return rows.select("run_id", "calls", r6("relative_calls").alias("relative_calls"))


# --- rewards ----------------------------------------------------------------------------------------------------------

N = 100
RUN_TOP_SQL = (
    f"found AS (SELECT run_id, id, score FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC NULLS LAST, id DESC) <= {N})"
)
TOP_SQL = f"hits AS (SELECT id, score FROM pool_scores QUALIFY row_number() OVER (ORDER BY score DESC, id DESC) <= {N})"


@query(
    "L11 SO4 SO5",
    f"""
    WITH {RUN_TOP_SQL}, {TOP_SQL},
    counts AS (SELECT run_id, score, count(*) AS n FROM found GROUP BY 1, 2),
    truth AS (SELECT score, count(*) AS m FROM hits GROUP BY 1),
    by_score AS (SELECT run_id, sum(least(n, m)) AS c FROM counts JOIN truth USING (score) GROUP BY 1)
    SELECT run_id, round(avg(f.score) / (SELECT avg(score) FROM hits), 6) AS f_avg, round(count(h.id) / {float(N)}, 6) AS f_ids,
           round(coalesce(any_value(c), 0) / {float(N)}, 6) AS f_scores
    FROM found f LEFT JOIN hits h USING (id) LEFT JOIN by_score USING (run_id) GROUP BY run_id
    """,
    ("runs", "pool_scores"),
)
def run_rewards(t):
    rows = rewards.rewards(runs(t), ["run_id"], curves.true_top(pool_scores(t), N), N)
    return rows.select("run_id", *[r6(c).alias(c) for c in ("f_avg", "f_ids", "f_scores")])


TRIAL_N = 50
TRIAL_SQL = f"""
hits AS (SELECT target, id, score FROM trials QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, id DESC) <= {TRIAL_N}),
found AS (SELECT target, arm, rep, id, score FROM trials
          QUALIFY row_number() OVER (PARTITION BY target, arm, rep ORDER BY score DESC, id DESC) <= {TRIAL_N}),
counts AS (SELECT target, arm, rep, score, count(*) AS n FROM found GROUP BY ALL),
truth AS (SELECT target, score, count(*) AS m FROM hits GROUP BY ALL),
by_score AS (SELECT target, arm, rep, sum(least(n, m)) AS c FROM counts JOIN truth USING (target, score) GROUP BY ALL),
true_avg AS (SELECT target, avg(score) AS a FROM hits GROUP BY 1),
by_run AS (SELECT f.target, f.arm, f.rep, avg(f.score) / any_value(a) AS f_avg, count(h.id) / {float(TRIAL_N)} AS f_ids,
           coalesce(any_value(c), 0) / {float(TRIAL_N)} AS f_scores
    FROM found f LEFT JOIN hits h USING (target, id) LEFT JOIN by_score s ON f.target = s.target AND f.arm = s.arm AND f.rep = s.rep
    JOIN true_avg ON true_avg.target = f.target GROUP BY f.target, f.arm, f.rep)
"""


def _trial_rewards(t):
    hits = top_n_each(trials(t), ["target"], TRIAL_N, [F.col("score").desc(), F.col("id").desc()])
    return rewards.rewards(trials(t), ["target", "arm", "rep"], hits.select("target", "id", "score"), TRIAL_N, by=["target"])


@query(
    "L13",
    f"WITH {TRIAL_SQL} SELECT target, arm, rep, round(f_avg, 6) AS f_avg, round(f_ids, 6) AS f_ids, round(f_scores, 6) AS f_scores FROM by_run",
    ("trials",),
)
def trial_rewards(t):
    return _trial_rewards(t).select("target", "arm", "rep", *[r6(c).alias(c) for c in ("f_avg", "f_ids", "f_scores")])


@query(
    "SO8",
    f"WITH {TRIAL_SQL} SELECT target, rep, round(max(CASE WHEN arm = 'full' THEN f_scores END), 6) AS \"full\", "
    "round(max(CASE WHEN arm = 'prune' THEN f_scores END), 6) AS prune FROM by_run GROUP BY 1, 2",
    ("trials",),
)
def collated_rewards(t):
    wide = rewards.collate(_trial_rewards(t), ["full", "prune"], ["target", "rep"], "f_scores")
    return wide.select("target", "rep", r6("full").alias("full"), r6("prune").alias("prune"))


def _trial_calls(t):
    """Rows each trial of the pruned arm still predicts, relative to the target's pool."""
    pool = trials(t).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    left = trials(t).filter("arm = 'prune'").groupBy("target", "rep").agg(F.count(F.lit(1)).alias("m"))
    return left.join(pool, "target").select("target", "rep", (F.col("m") / F.col("n")).alias("relative_calls"))


@query(
    "L14 A6 A8",
    f"""
    WITH {TRIAL_SQL},
    calls AS (SELECT target, count(*) / CAST(any_value(n) AS DOUBLE) AS relative_calls
              FROM trials JOIN (SELECT target, count(*) AS n FROM trials GROUP BY 1) USING (target) WHERE arm = 'prune' GROUP BY target, rep)
    SELECT upper(b.target) AS target, round(avg(f_scores) FILTER (arm = 'full'), 6) AS full_mean, round(stddev_pop(f_scores) FILTER (arm = 'full'), 6) AS full_sd,
           round(avg(f_scores) FILTER (arm = 'prune'), 6) AS prune_mean, round(stddev_pop(f_scores) FILTER (arm = 'prune'), 6) AS prune_sd,
           round((SELECT avg(relative_calls) FROM calls c WHERE c.target = b.target), 6) AS calls_mean,
           round((SELECT stddev_pop(relative_calls) FROM calls c WHERE c.target = b.target), 6) AS calls_sd
    FROM by_run b GROUP BY b.target
    """,
    ("trials",),
)
def arm_comparison(t):
    values = _trial_rewards(t).withColumnRenamed("f_scores", "value")
    table = rewards.compare_arms(values, _trial_calls(t), "full", "prune")
    return table.select("target", *[r6(c).alias(c) for c in table.columns if c != "target"])


@query(
    "A20",
    f"""
    WITH {TRIAL_SQL},
    s AS (SELECT target, avg(f_scores) FILTER (arm = 'full') AS mf, var_samp(f_scores) FILTER (arm = 'full') AS vf, count(*) FILTER (arm = 'full') AS nf,
                 avg(f_scores) FILTER (arm = 'prune') AS mp, var_samp(f_scores) FILTER (arm = 'prune') AS vp, count(*) FILTER (arm = 'prune') AS np
          FROM by_run GROUP BY 1)
    SELECT target, round((mp - mf) / nullif(sqrt((vp * (np - 1) + vf * (nf - 1)) / (np + nf - 2) * (1.0 / np + 1.0 / nf)), 0), 6) AS t,
           np + nf - 2 AS freedom FROM s
    """,
    ("trials",),
)
def arm_t_statistics(t):
    table = rewards.arm_tests(_trial_rewards(t).withColumnRenamed("f_scores", "value"), "full", "prune")
    return table.select("target", r6("t").alias("t"), "freedom")


_ODD, _COS = "freedom % 2 = 1", "(1.0 / (1.0 + t * t / freedom))"
_POWERS = (
    f"list_sum(list_transform(range(0, greatest(CAST((freedom - CASE WHEN {_ODD} THEN 3 ELSE 2 END) // 2 AS BIGINT), 0) + 1), lambda k: coalesce(list_product("
    f"list_transform(range(1, k + 1), lambda j: {_COS} * CASE WHEN {_ODD} THEN 2.0 * j / (2.0 * j + 1) ELSE (2.0 * j - 1) / (2.0 * j) END)), 1.0)))"
)
STUDENT_SQL = (
    f"(0.5 + 0.5 * CASE WHEN freedom = 1 THEN atan(t) * 2 / pi() WHEN {_ODD} THEN (atan(t / sqrt(freedom)) + t / sqrt(freedom) * {_COS} * {_POWERS}) * 2 / pi() "
    f"ELSE t / sqrt(freedom) * sqrt({_COS}) * {_POWERS} END)"
)


@query(
    "A20",
    f"""
    WITH {TRIAL_SQL},
    s AS (SELECT target, avg(f_scores) FILTER (arm = 'full') AS mf, var_samp(f_scores) FILTER (arm = 'full') AS vf, count(*) FILTER (arm = 'full') AS nf,
                 avg(f_scores) FILTER (arm = 'prune') AS mp, var_samp(f_scores) FILTER (arm = 'prune') AS vp, count(*) FILTER (arm = 'prune') AS np
          FROM by_run GROUP BY 1),
    v AS (SELECT target, (mp - mf) / nullif(sqrt((vp * (np - 1) + vf * (nf - 1)) / (np + nf - 2) * (1.0 / np + 1.0 / nf)), 0) AS t, np + nf - 2 AS freedom FROM s),
    p AS (SELECT target, {STUDENT_SQL} AS p FROM v)
    SELECT target, round(p, 6) AS p, round(p * (SELECT count(DISTINCT target) FROM trials), 6) AS p_adjusted FROM p
    """,
    ("trials",),
)
def arm_p_values(t):
    """One-sided p values, multiplied by the number of targets."""
    table = rewards.arm_tests(_trial_rewards(t).withColumnRenamed("f_scores", "value"), "full", "prune")
    p = table.withColumn("p", stats.one_sided_p(F.col("t"), F.col("freedom")))
    targets = trials(t).agg(F.countDistinct("target").alias("n")).scalar()
    return p.select("target", r6("p").alias("p"), r6(F.col("p") * targets).alias("p_adjusted"))


@query(
    "L15 W1",
    f"""
    WITH {TOP_SQL}, low AS (SELECT min(score) AS m FROM hits), ties AS (SELECT count(*) AS n FROM hits, low WHERE score = m),
    per AS (SELECT run_id, iter, count(*) AS n, count(CASE WHEN score > m THEN 1 END) AS gt, count(CASE WHEN score = m THEN 1 END) AS eq FROM runs, low GROUP BY 1, 2)
    SELECT run_id, iter, CAST(sum(n) OVER w AS BIGINT) AS n_acquired, round((sum(gt) OVER w + least(sum(eq) OVER w, (SELECT n FROM ties))) / {float(N)}, 6) AS f_scores
    FROM per WINDOW w AS (PARTITION BY run_id ORDER BY iter)
    """,
    ("runs", "pool_scores"),
)
def rewards_by_iteration(t):
    rows = rewards.score_recall_by_iteration(runs(t), ["run_id"], curves.true_top(pool_scores(t), N), N)
    return rows.select("run_id", "iter", "n_acquired", r6("f_scores").alias("f_scores"))


@query(
    "L12 F19 C5",
    f"""
    WITH {CLASSES_SQL}, {RUN_TOP_SQL},
    sizes AS (SELECT class, count(*) AS n FROM classes GROUP BY 1)
    SELECT run_id, round(count(*) FILTER (class = 'large') / CAST((SELECT n FROM sizes WHERE class = 'large') AS DOUBLE), 6) AS f_large,
           round(count(*) FILTER (class = 'mid') / CAST((SELECT n FROM sizes WHERE class = 'mid') AS DOUBLE), 6) AS f_mid,
           round(count(*) FILTER (class = 'singleton') / CAST((SELECT n FROM sizes WHERE class = 'singleton') AS DOUBLE), 6) AS f_singleton
    FROM found JOIN classes USING (id) GROUP BY run_id
    """,
    ("runs",),
)
def cluster_class_recall(t):
    rows = rewards.class_recall(runs(t), ["run_id"], _classes(t), N)
    return rows.select("run_id", *[r6(f"f_{c}").alias(f"f_{c}") for c in ("large", "mid", "singleton")])


@query(
    "J4 T8 A23",
    "WITH top AS (SELECT id FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, id) - 1 AS row_idx FROM explored) "
    "WHERE row_idx < 500 AND score IS NOT NULL) "
    "SELECT o_orderpriority AS node_id, count(*) AS n, string_agg(concat('n', o_orderkey), ',' ORDER BY concat('n', o_orderkey)) AS names "
    "FROM orders JOIN top ON id = o_orderkey GROUP BY 1",
    ("explored",),
)
def names_by_node(t):
    """At most 500 names are gathered, because the semi join keeps the top rows only."""
    ranked = rank_within(explored(t).select("id", "score"), [], [F.col("score").desc_nulls_last(), F.col("id").asc()], "n")
    best = first_with_score(ranked.withColumn("row_idx", F.col("n") - 1), 500)
    log = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("n"), "o_orderkey").alias("name"), F.col("o_orderpriority").alias("node_id"))
    kept = log.join(best.select("id"), "id", "left_semi")
    return kept.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("name"))).alias("names")
    )


@query(
    "J10",
    "SELECT run_id, iter, r.id, round(value / 10, 6) AS x, event_type AS y FROM runs r JOIN events ON event_id = r.id",
    ("runs",),
)
def acquired_coordinates(t):
    coordinates = t.events.select(F.col("event_id").alias("id"), r6(F.col("value") / 10).alias("x"), F.col("event_type").alias("y"))
    return runs(t).select("run_id", "iter", "id").join(coordinates, "id")
