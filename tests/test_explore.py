"""The loop: order of its log, stopping, warm starts, failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscout.config import RunConfig
from poolscout.operators import graph, ordered, similarity
from poolscout.operators.objectives import lookup_objective
from poolscout.plans import curves
from poolscout.plans.explore import Exploration
from poolscout.sources.library import read_library
from poolscout.sources.scores import read_label_table
from poolscout.surrogate.ensembles import DropoutSurrogate, EnsembleSurrogate, MeanVarianceSurrogate, member_stats
from poolscout.surrogate.factory import make_surrogate
from poolscout.surrogate.forest import ForestSurrogate


def pool_of(spark, n, clusters=None):
    rows = spark.range(n).select("id", F.array((F.col("id") % 17).cast("double"), (F.col("id") / n)).alias("features"))
    return rows if clusters is None else rows.withColumn("cluster_id", (F.col("id") % clusters).cast("int"))


def labels_of(spark, n):
    return spark.range(n).select("id", (F.col("id") % 17 + F.col("id") / n).alias("score"))


def test_the_log_has_the_order_of_acquisition(spark, tmp_path):
    pool, labels = pool_of(spark, 300), labels_of(spark, 300)
    config = RunConfig(metric="greedy", init_size=20, batch_sizes=(10,), k=5, max_iters=2, delta=-1.0)
    run = Exploration(spark, pool, lookup_objective(labels), make_surrogate("nn"), config, str(tmp_path / "run"), run_id="a")
    assert [r["iter"] for r in run.run().collect()] == [0, 1, 2]
    log = run.acquisitions().orderBy("seq").collect()
    assert [r["seq"] for r in log] == list(range(1, 41)) and {r["run_id"] for r in log} == {"a"}
    assert [r["iter"] for r in log] == [0] * 20 + [1] * 10 + [2] * 10
    preds = {(r["iter"], r["id"]): r["y_mean"] for r in run.log.read("preds").collect()}
    for i in (1, 2):
        batch = [(preds[i, r["id"]], r["id"]) for r in log if r["iter"] == i]
        assert batch == sorted(batch, reverse=True)
    means = [r["running_mean"] for r in curves.running_mean(run.acquisitions()).orderBy("seq").collect()]
    assert means[-1] == pytest.approx(np.mean([r["score"] for r in log]))
    again = Exploration(spark, pool, lookup_objective(labels), make_surrogate("nn"), config, str(tmp_path / "run"), resume=True)
    assert again.acquisitions().count() == 40


def test_annealed_batches_do_not_end_a_run(spark, tmp_path):
    pool, labels = pool_of(spark, 400, clusters=8), labels_of(spark, 400)
    config = RunConfig(init_size=40, batch_sizes=(40,), k=5, max_iters=4, delta=-1.0, temp_i=0.05, temp_f=0.01)
    run = Exploration(spark, pool, lookup_objective(labels), make_surrogate("nn"), config, str(tmp_path / "run"))
    assert run.run().count() == 5 and not run.exhausted
    assert any(r["n_new"] < 40 for r in run.iterations().collect())


def test_a_run_ends_with_its_pool(spark, tmp_path):
    pool, labels = pool_of(spark, 50), labels_of(spark, 50)
    config = RunConfig(init_size=20, batch_sizes=(20,), k=5, max_iters=9, delta=-1.0, budget=1000)
    run = Exploration(spark, pool, lookup_objective(labels), make_surrogate("nn"), config, str(tmp_path / "run"))
    assert [r["n_new"] for r in run.run().collect()] == [20, 20, 10] and run.exhausted


@pytest.mark.parametrize("model", ["gp", "nn"])
def test_warm_start_with_labels_from_elsewhere(spark, tmp_path, model):
    pool, labels = pool_of(spark, 100), labels_of(spark, 100)
    previous = labels.where("id < 30").union(spark.createDataFrame([(1000, 99.0), (1001, None)], "id long, score double"))
    config = RunConfig(init_size=5, batch_sizes=(5,), k=5, max_iters=1, delta=-1.0)
    run = Exploration(spark, pool, lookup_objective(labels), make_surrogate(model), config, str(tmp_path / "a"), previous=previous)
    run.run()
    first = run.acquisitions().orderBy("seq").first()
    assert (first["id"], first["score"], first["seq"]) == (1000, 99.0, 1) and run.labels_used == 5
    known = previous.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    run = Exploration(spark, pool, lookup_objective(labels), make_surrogate(model), config, str(tmp_path / "b"), previous=known)
    run.run()
    assert run.explored().where("id = 1000").first()["features"] == [1.0, 2.0]


class Counting(EnsembleSurrogate):
    fits = 0

    def fit(self, rows):
        self.fits += 1
        return super().fit(rows)


def test_a_round_of_failures_changes_no_prediction(spark, tmp_path):
    pool = pool_of(spark, 120)
    tried = labels_of(spark, 120).withColumn("score", F.when(F.col("id") % 17 < 16, F.col("score")))
    config = RunConfig(metric="greedy", init_size=60, batch_sizes=(1,), k=5, max_iters=3, delta=-1.0)
    model = Counting(members=2)
    run = Exploration(spark, pool, lookup_objective(tried), model, config, str(tmp_path / "run"))
    run.run()
    failed = [r["n"] == 0 for r in run.acquisitions().where("iter > 0").groupBy("iter").agg(F.count("score").alias("n")).orderBy("iter").collect()]
    assert model.fits == 1 + sum(not f for f in failed[:-1])
    assert run.log.read("preds").select("iter").distinct().count() == 3


def test_dropout_draws_anew_in_every_round(spark):
    rows = spark.range(200).select("id", F.array(*[F.rand(i) for i in range(8)]).alias("features")).withColumn("score", F.col("features")[0] * 3 + F.col("features")[1])
    rows = rows.cache()
    model = DropoutSurrogate().fit(rows)
    means = lambda: [r["y_mean"] for r in model.predict(rows.select("id", "features")).orderBy("id").collect()]
    still = means()
    model.start_round(1, False)
    assert means() == still
    model.start_round(1, True)
    one = means()
    model.start_round(2, True)
    two = means()
    assert one != two and one != still and model.masks(8).shape == (1, 8)


def test_mean_variance_gives_the_variance_of_normal_residuals(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 4000)
    rows = spark.createDataFrame([(i, [float(v)], float(2 * v + e)) for i, (v, e) in enumerate(zip(x, rng.normal(0, 0.5, 4000)))], "id long, features array<double>, score double")
    got = MeanVarianceSurrogate().fit(rows).predict(rows.select("id", "features"), False).agg(F.avg("y_var")).first()[0]
    assert got == pytest.approx(0.25, rel=0.1)


def test_ensemble_variance_of_large_means(spark):
    row = spark.range(1).select(*[(F.lit(1e9) + F.lit(d)).alias(f"m{i}") for i, d in enumerate((0.001, 0.002, 0.003))])
    mean, var = member_stats([F.col(c) for c in row.columns])
    got = row.select(mean.alias("m"), var.alias("v")).first()
    assert got["v"] == pytest.approx(np.var([0.001, 0.002, 0.003]), rel=1e-3)


def test_models_that_cannot_be_are_refused():
    with pytest.raises(ValueError, match="bootstrap"):
        EnsembleSurrogate(bootstrap=False)
    with pytest.raises(ValueError, match="depth 30"):
        ForestSurrogate(max_depth=31)
    assert ForestSurrogate(max_depth=None).max_depth == 30


def test_quoted_fields(spark, tmp_path):
    path = str(tmp_path / "quoted.csv")
    with open(path, "w") as f:
        f.write('id,score\n"F/C=C\\F ""a,b""",1.5\n"x ""y""",2\n')
    assert sorted(r["id"] for r in read_library(spark, [path]).collect()) == ['F/C=C\\F "a,b"', 'x "y"']
    assert {r["id"]: r["score"] for r in read_label_table(spark, path).collect()} == {'F/C=C\\F "a,b"': 1.5, 'x "y"': 2.0}


def test_top_n_keeps_its_order_on_both_sides_of_its_limit(spark):
    rows = spark.range(5000).select("id", F.pmod(F.hash("id"), F.lit(97)).cast("double").alias("y")).repartition(7)
    order = [F.col("y").desc(), F.col("id").desc()]
    small = [r["id"] for r in ordered.top_n(rows, 700, order, "y").collect()]
    assert small == [r["id"] for r in ordered.top_n(rows, 700, order, "y", gather_rows=10).collect()] and len(small) == 700


def bits(*sets):
    return [(i, sorted(s)) for i, s in sets]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_an_item_at_the_distance_is_no_leader(spark, kind):
    # 7 shared bits of 20: a distance of exactly 0.65
    rows = bits((1, range(14)), (2, range(7, 20)), (3, [40, 41]))
    items = spark.createDataFrame(rows, "id long, bits array<int>").withColumn("id", F.col("id").cast(kind))
    leaders = similarity.pick_leaders(items, 64, 0.65)
    one = (lambda v: v) if kind == "long" else str
    assert sorted(r["id"] for r in leaders.collect()) == [one(1), one(3)]
    got = {r["id"]: (r["leader"], r["similarity"]) for r in similarity.assign_to_leaders(items, leaders, 64).collect()}
    assert got == {one(1): (one(1), 1.0), one(2): (one(1), 0.35), one(3): (one(3), 1.0)}
    near = {(r["leader"], r["id"]) for r in similarity.within_distance(items, leaders, 64, 0.65).collect()}
    assert near == {(one(1), one(1)), (one(1), one(2)), (one(3), one(3))}
    assert [r["id"] for r in similarity.pick_leaders(items, 64, 0.65, max_picks=1).collect()] == [one(1)]


@pytest.mark.parametrize("undirected", [False, True])
def test_graph_sums_are_the_same_for_large_graphs(spark, undirected):
    pairs = [(g, f"e{g}-{i}", f"n{i}", f"n{(i * 7 + g) % 9}") for g in range(4) for i in range(8)]
    edges = [(g, f"{e}f", a, b, f"{e}b", float(len(e) + g)) for g, e, a, b in pairs] + [(g, f"{e}b", b, a, f"{e}f", 0.5) for g, e, a, b in pairs]
    edge_rows = spark.createDataFrame(edges, "graph_id long, edge_id string, src string, dst string, rev_id string, x double")
    nodes = spark.createDataFrame([(g, f"n{i}", float(i)) for g in range(4) for i in range(9)], "graph_id long, node_id string, x double")
    got = [
        sorted((r["graph_id"], r["node_id"], round(r["x"], 6)) for r in graph.propagate(nodes, edge_rows, ["x"], 4, undirected=undirected, largest_in_task=n).collect())
        for n in (0, 100)
    ]
    assert got[0] == got[1] and len(got[0]) == 36


def node_sums(nodes, edges, depth):
    """Mode ``node`` row by row, as joins give it: a node that is there twice sends twice."""
    state = [(g, v, x) for g, v, x in nodes]
    for i in range(depth):
        sums = {}
        for g, _, a, b, _, x in edges:
            for h, v, m in state:
                if None not in (g, a, b, h, v, m, 0.0 if i == depth - 1 else x) and (g, a) == (h, v):
                    sums[g, b] = sums.get((g, b), 0.0) + m + (0.0 if i == depth - 1 else x)
        state = [(g, v, None if x is None else x + sums.get((g, v), 0.0)) for g, v, x in nodes]
    return sorted(((str(g), str(v), None if m is None else round(m, 6)) for g, v, m in state), key=str)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_node_messages_inside_a_graph_are_those_of_joins(spark, depth):
    nodes = [(g, f"n{i}", float(i + g)) for g in range(3) for i in range(6)]
    nodes += [(0, "n1", 7.0), (0, "n2", None), (None, "n0", 3.0), (1, None, 4.0)]
    pairs = [(g, f"e{g}-{i}", f"n{i}", f"n{(i * 5 + g) % 8}") for g in range(3) for i in range(6)]
    edges = [(g, f"{e}f", a, b, f"{e}b", float(i)) for i, (g, e, a, b) in enumerate(pairs)] + [(g, f"{e}b", b, a, f"{e}f", 0.5) for g, e, a, b in pairs]
    edges += [(0, "x", "n0", "n3", "y", None), (None, "x", "n0", "n0", "y", 1.0), (1, "x", None, "n1", "y", 1.0), (1, "y", "n1", None, "x", 1.0)]
    node_rows = spark.createDataFrame(nodes, "graph_id long, node_id string, x double")
    edge_rows = spark.createDataFrame(edges, "graph_id long, edge_id string, src string, dst string, rev_id string, x double")
    for options in ({}, {"largest_in_task": 0}, {"largest": 16}):
        got = graph.propagate(node_rows, edge_rows, ["x"], depth, "node", **options).collect()
        found = [(str(r["graph_id"]), str(r["node_id"]), None if r["x"] is None else round(r["x"], 6)) for r in got]
        assert sorted(found, key=str) == node_sums(nodes, edges, depth)


def test_node_messages_of_dealt_graphs_move_no_rows(spark):
    nodes = graph.by_graph(spark.range(20).selectExpr("id % 2 AS graph_id", "id AS node_id", "1D AS x"))
    edges = graph.by_graph(spark.range(20).selectExpr("id % 2 AS graph_id", "id AS edge_id", "id AS src", "(id + 2) % 20 AS dst", "-id AS rev_id", "0.5D AS x"))
    got = graph.propagate(nodes, edges, ["x"], 2, "node", dealt=True, largest=20)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert [r["x"] for r in got.collect()] == [3.5] * 20


def test_a_scope_leaves_nothing_behind(spark, tmp_path):
    from poolscout.session import cut, scratch_path, scratch_scope, shared_dir

    before = shared_dir(spark)
    with scratch_scope(spark) as folder:
        path = scratch_path(spark, "t")
        spark.range(5).write.parquet(path)
        assert path.startswith(folder) and cut(spark.range(3)).count() == 3
        spark.read.parquet(path).write.parquet(str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    with scratch_scope(spark), scratch_scope(spark):
        assert cut(spark.range(3)).count() == 3
    assert shared_dir(spark).rsplit("/", 1)[0] == before.rsplit("/", 1)[0]


def test_pruned_pools_are_ids(spark, tmp_path):
    import os

    pool, labels = pool_of(spark, 200), labels_of(spark, 200)
    config = RunConfig(metric="ei", init_size=40, batch_sizes=(10,), k=5, max_iters=2, delta=-1.0, prune=True)
    run = Exploration(spark, pool, lookup_objective(labels), make_surrogate("nn", "ensemble"), config, str(tmp_path / "run"))
    run.run()
    assert not os.path.exists(tmp_path / "run" / "pool")
    again = Exploration(spark, pool, lookup_objective(labels), make_surrogate("nn", "ensemble"), config, str(tmp_path / "run"), resume=True)
    kept = {r["iter"]: r["count"] for r in run.log.read("retained").groupBy("iter").count().collect()}
    assert again.generation == run.generation == max(kept)
    assert again.pool.count() == run.pool.count() == kept[run.generation] < 200


def test_quotas_are_the_same_on_both_sides_of_the_group_limit(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("k"), F.pmod(F.hash("id"), F.lit(50)).cast("double").alias("y"))
    rows = rows.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    quotas = spark.createDataFrame([(None, 3), (1, 0), (2, 20), (3, 900), (9, 5)], "k long, quota long")
    order = [F.col("y").desc(), F.col("id").desc()]
    got = [sorted((str(r["k"]), r["id"]) for r in ordered.top_per_group(rows, "k", order, quotas, how, limit).collect()) for how, limit in ((None, 1000), (None, 10), ("y", 10))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3 + 20 + 429


def test_one_read_out_of_several_ways(spark):
    nodes = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "a", 5.0)], "graph_id long, node_id string, x double")
    graphs = spark.createDataFrame([(1,), (2,), (3,)], "graph_id long")
    got = graph.read_out(graphs, nodes, ["x"], ("mean", "sum", "norm")).orderBy("graph_id").select("x_mean", "x_sum", "x_norm").collect()
    assert [tuple(r) for r in got] == [(3.0, 6.0, 0.06), (5.0, 5.0, 0.05), (0.0, 0.0, 0.0)]
    for how in ("mean", "sum", "norm"):
        one = graph.read_out(graphs, nodes, ["x"], how).orderBy("graph_id").collect()
        assert [r["x"] for r in one] == [r[("mean", "sum", "norm").index(how)] for r in got]
