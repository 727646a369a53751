"""The feed-forward surrogate: gradients, both ways of training, and what it learns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolscout.session import scratch_path
from poolscout.surrogate import network
from poolscout.surrogate.factory import make_surrogate
from poolscout.surrogate.network import Network


@pytest.mark.parametrize("options", [{}, {"activation": "tanh", "variance": True}, {"variance": True, "dropout": 0.3}])
def test_gradient_is_the_slope_of_the_loss(options):
    net = Network(hidden=(5, 4), **options)
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((30, 3)), rng.standard_normal(30)
    flat = network.first_weights(3, net, 1) + 0.1 * rng.standard_normal(len(network.first_weights(3, net, 1)))
    masks = network.unit_masks(net, 3, 7) if net.dropout else None
    found = network.loss_and_gradient(flat, x, y, net, masks)
    for i in rng.choice(len(flat), 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (network.loss_and_gradient(up, x, y, net, masks)[-2] - network.loss_and_gradient(down, x, y, net, masks)[-2]) / 2e-6
        assert found[i] == pytest.approx(slope, abs=1e-4)
    assert found[-1] == 30


@pytest.fixture(scope="module")
def pool(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


@pytest.fixture(scope="module")
def bent(pool):
    """A score that no line fits."""
    x = F.col("features")
    return pool.withColumn("score", 5 * F.abs(x[0]) + 3 * F.abs(x[1]) - 4 * F.abs(x[2]) + x[3])


def error(frame):
    return frame.agg(F.avg((F.col("y_mean") - F.col("score")) ** 2)).first()[0]


def test_held_out_error_is_below_that_of_a_linear_model(bent):
    train, rest = bent.where("id % 5 <> 0"), bent.where("id % 5 = 0")
    linear = error(make_surrogate("nn").fit(train).predict(rest))
    assert error(make_surrogate("network").fit(train).predict(rest)) < 0.85 * linear


@pytest.mark.parametrize("conf", [None, "mve", "dropout"])
def test_jobs_train_as_one_task_does(bent, conf):
    rows = bent.where("id < 600")
    options = {"hidden": (8,), "epochs": 3}
    one = make_surrogate("network", conf, **options).fit(rows.repartition(3))
    jobs = make_surrogate("network", conf, local_cells=0, **options).fit(rows.repartition(5, "id"))
    assert np.allclose(one.flat, jobs.flat, atol=1e-8) and one.scale == pytest.approx(jobs.scale) and one.shift == pytest.approx(jobs.shift, abs=1e-9)


def test_variance_follows_the_noise(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, 4000)
    y = 2 * x + rng.standard_normal(4000) * np.where(x > 0, 1.0, 0.1)
    rows = spark.createDataFrame([(i, [float(a)], float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, features array<double>, score double")
    model = make_surrogate("network", "mve", hidden=(32,)).fit(rows)
    low, high = (model.predict(spark.createDataFrame([(1, [v])], "id long, features array<double>"), False).first()["y_var"] for v in (-0.6, 0.6))
    assert low < 0.1 and 0.5 < high < 2.0


@pytest.mark.parametrize("conf", [None, "ensemble", "mve", "dropout"])
def test_saved_models_predict_the_same(spark, bent, conf):
    rows = bent.where("id < 400")
    options = {"hidden": (8,), "epochs": 4}
    model = make_surrogate("network", conf, **options).fit(rows)
    path = scratch_path(spark, "network")
    model.save(path)
    again = make_surrogate("network", conf, **options).load(path)
    want, got = (sorted(tuple(r) for r in m.predict(rows.select("id", "features"), False).select("id", "y_mean", "y_var").collect()) for m in (model, again))
    assert want == got
    if "vars" in model.provides:
        assert all(v >= 0 for _, _, v in got) and max(v for _, _, v in got) > 0


def test_draws_differ_by_round(bent):
    rows = bent.where("id < 300")
    model = make_surrogate("network", "dropout", hidden=(16,), epochs=3).fit(rows)
    drawn = []
    for turn in (1, 2, 1):
        model.start_round(turn, draw=True)
        drawn.append([r["y_mean"] for r in model.predict(rows).orderBy("id").collect()])
    assert drawn[0] == drawn[2] and drawn[0] != drawn[1]


def test_no_rows(bent):
    with pytest.raises(ValueError):
        make_surrogate("network").fit(bent.where("id < 0"))


def test_a_step_reads_the_rows_of_its_batch_only(spark, monkeypatch):
    rows = spark.range(1000).select("id", F.array(F.col("id") % 17 * 1.0).alias("features"), (F.col("id") % 17 * 2.0 + F.col("id") % 3).alias("score"))
    seen, frame = [], type(rows)
    inner = frame.mapInArrow

    def recorded(self, *args, **kwargs):
        if self.columns == ["x", "y"]:
            seen.append(self.agg(F.sum(F.length("y")) / 8).first()[0])
        return inner(self, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", recorded)
    model = make_surrogate("network", hidden=(1,), activation="linear", epochs=2, held_out=0.0, local_cells=0).fit(rows)
    assert len(seen) == 2 * 7 + 1 and max(seen[:-1]) < 250 and sum(seen) == 3 * 1000
    line = rows.selectExpr("regr_slope(score, features[0]) AS b", "regr_intercept(score, features[0]) AS a").first()
    got = model.predict(rows.where("id < 17"), True).orderBy("id").collect()
    assert np.allclose([r["y_mean"] for r in got], [line["a"] + line["b"] * i for i in range(17)])


@pytest.mark.parametrize("conf", [None, "mve"])
def test_few_rows_at_once_train_as_all_do(bent, monkeypatch, conf):
    rows, options = bent.where("id < 600"), {"hidden": (8,), "epochs": 3}
    one = make_surrogate("network", conf, **options).fit(rows)
    chunk = network.chunk_rows
    assert chunk(64) == 4096 and chunk(8192) == 64 and chunk(1 << 30) == 1
    x = np.array([r["features"] for r in rows.collect()])
    want = one.outputs(x)
    monkeypatch.setattr(network, "CHUNK_ROWS", 50)
    assert np.allclose(one.outputs(x), want, equal_nan=True)
    summed = network.in_chunks(lambda p, q: network.loss_and_gradient(one.flat, p, q, one.net), x, x[:, 0])
    assert np.allclose(summed, network.loss_and_gradient(one.flat, x, x[:, 0], one.net))


def test_jobs_give_mean_and_variance_of_rows_that_look_alike(spark):
    rows = spark.range(700).select("id", F.array(F.lit(1.0)).alias("features"), (F.col("id") % 13 * 1.5).alias("score"))
    model = make_surrogate("network", "mve", hidden=(4,), held_out=0.0, epochs=2, local_cells=0).fit(rows)
    got = model.predict(rows.limit(1), False).first()
    want = rows.agg(F.avg("score"), F.var_pop("score")).first()
    assert (got["y_mean"], got["y_var"]) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_a_model_trained_in_jobs_is_the_same_after_loading(spark):
    rows = spark.range(500).select("id", F.array(F.col("id") * 1.0).alias("features"), (F.col("id") * 0.5 - 3.0).alias("score"))
    options, path = {"hidden": (1,), "activation": "linear", "epochs": 1, "local_cells": 0}, scratch_path(spark, "network")
    make_surrogate("network", **options).fit(rows).save(path)
    got = make_surrogate("network", **options).load(path).predict(rows).orderBy("id").collect()
    assert np.allclose([r["y_mean"] for r in got], [i * 0.5 - 3.0 for i in range(500)])


@pytest.mark.parametrize("local_cells", [0, 1 << 20])
def test_rows_of_other_lengths_are_an_error(spark, local_cells):
    rows = spark.createDataFrame([(i, [1.0, 2.0, 3.0 * i], 1.0 * i) for i in range(20)], "id long, features array<double>, score double")
    model = make_surrogate("network", hidden=(2,), epochs=1, local_cells=local_cells).fit(rows)
    reader = model._reader()
    batch = pa.record_batch([pa.array([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]), pa.array([1.0, 2.0]), pa.array([0, 0], pa.int32())], names=["features", "score", "batch"])
    with pytest.raises(ValueError, match="3 features"):
        reader(batch)


def test_members_trained_in_jobs_are_those_of_one_task(bent):
    rows, options = bent.where("id < 300"), {"members": 2, "hidden": (4,), "epochs": 2}
    one, jobs = (make_surrogate("network", "ensemble", local_cells=cells, **options).fit(rows) for cells in (1 << 20, 0))
    assert all(np.allclose(a.flat, b.flat, atol=1e-8) for a, b in zip(one.models, jobs.models))


@pytest.mark.parametrize("few", [0, 16])
def test_sums_of_few_tasks_need_no_shuffle(spark, monkeypatch, few):
    """Steps of few tasks are added up by the driver, of more tasks in the JVM, to the same weights."""
    rows = spark.range(600).select("id", F.array(F.col("id") % 7 * 1.0).alias("features"), (F.col("id") % 5 * 1.5).alias("score"))
    monkeypatch.setattr(network, "FEW_TASKS", few, raising=False)
    shuffled, frame = [], type(rows)
    inner = frame.agg
    monkeypatch.setattr(frame, "agg", lambda self, *a, **k: shuffled.append(self.columns) or inner(self, *a, **k))
    options = {"hidden": (3,), "epochs": 2, "held_out": 0.0, "variance": True}
    jobs = make_surrogate("network", local_cells=0, **options).fit(rows)
    steps = shuffled.count(["s"])
    assert steps == (1 if few else 2 * 4 + 1)  # the sums at the end are of all batches
    assert np.allclose(jobs.flat, make_surrogate("network", **options).fit(rows).flat, atol=1e-8)
