"""Evidence of prior, noise and scale of the Gaussian process."""

import numpy as np
import pandas as pd
import pytest

from poolscout.surrogate import linear
from poolscout.surrogate.factory import make_surrogate

SCHEMA = "id long, features array<double>, score double"


def gram_of(x, y):
    both = np.hstack([x, y[:, None]])
    return both.T @ both


def test_evidence_is_that_of_the_targets_covariance():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((12, 4)), rng.standard_normal(12)
    values, vectors = np.linalg.eigh(x.T @ x)
    for prior, noise in ((0.3, 0.5), (4.0, 0.01)):
        cover = prior * x @ x.T + noise * np.eye(12)
        want = -0.5 * (12 * np.log(2 * np.pi) + np.linalg.slogdet(cover)[1] + y @ np.linalg.solve(cover, y))
        assert linear.log_evidence(values, vectors.T @ (x.T @ y), y @ y, 12, np.array([prior]), np.array([noise]))[0] == pytest.approx(want)


def test_the_best_is_not_beaten_by_any_near_it():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 5))
    y = x @ rng.standard_normal(5) * 0.5 + 0.3 * rng.standard_normal(400)
    gram = gram_of(x, y)
    prior, noise, best = linear.best_evidence(gram, 400, 10)
    values, vectors = np.linalg.eigh(gram[:-1, :-1])
    grid = np.array([(prior * a, noise * b) for a in (0.9, 0.99, 1.01, 1.1) for b in (0.9, 0.99, 1.01, 1.1)])
    assert (linear.log_evidence(values, vectors.T @ gram[:-1, -1], gram[-1, -1], 400, *grid.T) < best).all()
    assert noise == pytest.approx(0.09, rel=0.2)


def test_the_length_scale_follows_the_data(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, 600)
    chosen, error = {}, {}
    for name, speed in (("slow", 0.5), ("fast", 6.0)):
        y = np.sin(speed * x) + 0.05 * rng.standard_normal(600)
        rows = spark.createDataFrame([(i, [float(a)], float(b)) for i, (a, b) in enumerate(zip(x, y))], SCHEMA)
        train, rest = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
        model = make_surrogate("gp", kernel="rbf", evidence=True).fit(train)
        fixed = make_surrogate("gp", kernel="rbf", scale=1.0, evidence=False).fit(train)
        chosen[name] = model.scale
        got = [np.array([(r["y_mean"] - r["score"]) ** 2 for r in m.predict(rest).collect()]).mean() for m in (model, fixed)]
        error[name] = got
        assert model.chosen["noise"] * model.sd**2 == pytest.approx(0.0025, rel=0.5)
    assert chosen["fast"] < chosen["slow"] and error["fast"][0] < 0.5 * error["fast"][1]


def test_a_saved_process_knows_what_was_chosen(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], float(i % 7)) for i in range(60)], SCHEMA)
    model = make_surrogate("gp", kernel="matern", evidence=True).fit(rows)
    model.save(str(tmp_path / "gp"))
    again = make_surrogate("gp", kernel="matern", evidence=True).load(str(tmp_path / "gp"))
    assert again.chosen == model.chosen and again.scale == model.scale
    assert [tuple(r) for r in again.predict(rows, False).collect()] == [tuple(r) for r in model.predict(rows, False).collect()]


@pytest.mark.parametrize("kernel", ["dot", "rbf"])
def test_few_rows_at_once_fit_and_predict_the_same(spark, kernel):
    parts = list(linear.chunks_of(pd.Series([np.ones(2048, np.float32)] * 1200), 2049))
    assert max(len(x) for _, x in parts) == linear.CHUNK_CELLS // 2049 and sum(len(x) for _, x in parts) == 1200
    rows = spark.range(300).selectExpr("id", "array(cast(id % 7 as double), cast(id % 11 as double)) AS features", "cast(id % 7 * 2 - id % 11 as double) AS score")
    model = linear.GaussianProcessSurrogate(kernel, 16)
    x = np.array([r["features"] for r in rows.orderBy("id").collect()])
    got = np.array([tuple(r) for r in model.fit(rows).predict(rows, False).orderBy("id").select("y_mean", "y_var").collect()])
    wide = model._expand()(x)
    assert np.allclose(got[:, 0], wide @ model.weights * model.sd + model.mu)
    assert np.allclose(got[:, 1], ((wide @ model.factor.T) ** 2).sum(1) * model.sd**2)
