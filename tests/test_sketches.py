"""Student's distribution as a Column, quantile sketches, and variants from a table function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscout.operators import pool as ops
from poolscout.operators import stats


def test_student_column(spark):
    values = [-40.0, -6.3, -2.0, -1.0, -0.3, 0.0, 0.2, 1.5, 3.0, 25.0]
    pairs = [(t, n) for n in [*range(1, 32), 57, 199, 200, 201, 202, 500, 4001, 1_000_000] for t in values]
    frame = spark.createDataFrame(pairs, "t double, n long")
    for r in frame.withColumn("p", stats.student_column(F.col("t"), F.col("n"))).collect():
        if r["n"] <= 500:
            assert r["p"] == pytest.approx(stats.student_cdf(r["t"], r["n"]), abs=1e-8), (r["t"], r["n"])
        assert 0.0 <= r["p"] <= 1.0
    odd = spark.createDataFrame([(None, 3), (1.0, None), (1.0, 0)], "t double, n long")
    assert [r["p"] for r in odd.select(stats.one_sided_p(F.col("t"), F.col("n")).alias("p")).collect()] == [None] * 3


def test_sketches_of_a_heavy_key_merge(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 40_000), np.full(10_000, 0.25)])
    keys = np.where(np.arange(50_000) % 3 == 0, 0, np.arange(50_000) % 7)
    frame = spark.createDataFrame([(int(k), int(k) // 3, float(v)) for k, v in zip(keys, values)] + [(9, 9, None)], "k int, top int, v double").repartition(6)
    stats.quantile_sketches(frame, ["k", "top"], "v").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert {r["k"] for r in stored.collect()} == set(range(7))
    for keyed, of in ((["k"], keys), (["top"], keys // 3), ([], np.zeros(len(keys)))):
        merged = stats.merged_sketches(stored, keyed)
        for r in stats.sketch_quantiles(merged, (0.01, 0.5, 0.6, 0.99)).collect():
            own = values[of == (r[keyed[0]] if keyed else 0)]
            assert r["n"] == len(own)
            assert (own < r["estimate"]).mean() <= r["q"] + 0.02 and (own <= r["estimate"]).mean() >= r["q"] - 0.02


def test_a_generator_streams_its_variants(spark):
    def generate(name):
        if name.startswith("long"):
            for i in range(50_000):
                yield f"{name}{i}"
        elif name != "none":
            yield name.upper()
            yield name.upper()

    rows = spark.createDataFrame([("a", 1), ("none", 2), (None, 3), ("long", 4), ("a", 5)], "id string, variant int")
    counts = {r["id"]: r["count"] for r in ops.generated_variants(rows, generate).groupBy("id").count().collect()}
    assert counts == {"a": 4, "long": 50_000}
    small = rows.where("id <> 'long' OR id IS NULL")
    assert sorted((r["id"] or "" for r in ops.append_generated(small, generate).collect())) == ["", "A", "a", "none"]
