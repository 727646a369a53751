"""Ranks, running values and top-n, with one heavy key and many ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolscout.operators import ordered


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 6000
    return pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)),
            "v": rng.integers(0, 25, n).astype(float),
            "id": rng.permutation(n),
        }
    )


@pytest.fixture(scope="module")
def frame(spark, data):
    # Several partitions per key, even after adaptive coalescing.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(data).repartition(6).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


ORDER = lambda: [F.col("v").desc(), F.col("id").asc()]


def test_rank_within(frame, data):
    got = ordered.rank_within(frame, ["k"], ORDER(), "r", total="n").toPandas().sort_values("id").reset_index(drop=True)
    want = data.sort_values(["v", "id"], ascending=[False, True])
    want = want.assign(r=want.groupby("k").cumcount() + 1, n=want.groupby("k")["id"].transform("size")).sort_values("id").reset_index(drop=True)
    assert (got["r"] == want["r"]).all() and (got["n"] == want["n"]).all()


def test_rank_without_keys(frame, data):
    got = ordered.rank_within(frame, [], ORDER(), "r").toPandas().sort_values("r")
    want = data.sort_values(["v", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["r"].tolist() == list(range(1, len(data) + 1))


def test_heavy_key_spreads_over_chunks(frame):
    chunks = ordered.range_chunks(frame, ["k"], ORDER())
    assert chunks.rows.filter("k = 0").select("_chunk").distinct().count() > 2
    assert chunks.totals_rows >= chunks.rows.select("k", "_chunk").distinct().count()


def test_null_keys_are_a_key(spark):
    rows = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2), (1, 5.0, 3)], "k INT, v DOUBLE, id INT")
    got = {(r["k"], r["id"]): r["r"] for r in ordered.rank_within(rows, ["k"], ORDER(), "r").collect()}
    assert got == {(None, 2): 1, (None, 1): 2, (1, 3): 1}


def test_empty_input(spark):
    rows = spark.createDataFrame([], "k INT, v DOUBLE, id INT")
    assert ordered.rank_within(rows, ["k"], ORDER()).count() == 0
    assert ordered.top_n(rows, 5, ORDER(), "v", gather_rows=0).count() == 0
    assert ordered.running_sums(rows, ["k"], ORDER(), {"s": F.col("v")}).count() == 0


def test_running_sums(frame, data):
    got = ordered.running_sums(frame, ["k"], ORDER(), {"s": F.col("v"), "n": F.lit(1)}).toPandas().sort_values("id").reset_index(drop=True)
    want = data.sort_values(["v", "id"], ascending=[False, True])
    want = want.assign(s=want.groupby("k")["v"].cumsum(), n=want.groupby("k").cumcount() + 1).sort_values("id").reset_index(drop=True)
    assert np.allclose(got["s"], want["s"]) and (got["n"] == want["n"]).all()


def test_running_sums_by_seq_across_chunks(spark):
    rows = pd.DataFrame({"k": np.repeat([1, 2], [950, 37])})
    rows["seq"] = rows.groupby("k").cumcount() + 1
    rows["v"] = rows["seq"] % 7
    got = ordered.running_sums_by_seq(spark.createDataFrame(rows), ["k"], "seq", {"s": F.col("v")}, chunk_rows=100)
    got = got.toPandas().sort_values(["k", "seq"])
    assert got["s"].tolist() == rows.groupby("k")["v"].cumsum().tolist()


def test_last_known(frame, data):
    holes = frame.withColumn("w", F.when(F.col("id") % 11 == 0, F.col("v") + F.col("id")))
    got = ordered.last_known(holes, ["k"], [F.col("id").asc()], ["w"]).toPandas().sort_values("id").reset_index(drop=True)
    want = data.sort_values("id").assign(w=lambda d: (d["v"] + d["id"]).where(d["id"] % 11 == 0))
    want["w"] = want.groupby("k")["w"].ffill()
    want = want.reset_index(drop=True)
    assert got["w"].fillna(-1).tolist() == want["w"].fillna(-1).tolist()


@pytest.mark.parametrize("n", [1, 77, 2500, 10_000])
@pytest.mark.parametrize("largest", [None, "v"])
def test_large_top_n_equals_sorting(frame, data, n, largest):
    got = ordered.top_n(frame, n, ORDER(), largest, gather_rows=0)
    want = data.sort_values(["v", "id"], ascending=[False, True]).head(n)
    assert sorted(r["id"] for r in got.collect()) == sorted(want["id"])


def test_narrow_top_drops_rows(spark):
    rows = spark.range(20_000).select(F.col("id"), F.col("id").cast("double").alias("v"))
    kept = ordered.narrow_top(rows, 200, "v")
    assert 200 <= kept.count() < 1000


@pytest.mark.parametrize("largest", [None, "v"])
def test_top_per_group(spark, frame, data, largest):
    quotas = data.groupby("k").size().rename("n").reset_index().assign(quota=lambda d: (d["n"] * 0.03).astype(int) + d["k"] % 2)
    got = ordered.top_per_group(frame, "k", ORDER(), spark.createDataFrame(quotas[["k", "quota"]]), largest)
    want = data.sort_values(["v", "id"], ascending=[False, True])
    want = want.assign(r=want.groupby("k").cumcount() + 1).merge(quotas, on="k").query("r <= quota")
    assert sorted(r["id"] for r in got.collect()) == sorted(want["id"])


@pytest.mark.parametrize("n", [4, 1500])
def test_top_n_each(frame, data, n):
    got = ordered.top_n_each(frame, ["k"], n, ORDER())
    want = data.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(n)
    assert sorted(r["id"] for r in got.collect()) == sorted(want["id"])


def test_number_range(spark):
    rows = spark.createDataFrame([(1, 3, 12), (2, 5, 4), (3, 7, 7)], "k INT, a INT, b INT")
    got = ordered.number_range(rows, F.col("a"), F.col("b"), "x", block=4)
    assert sorted((r["k"], r["x"]) for r in got.collect()) == [(1, x) for x in range(3, 13)] + [(3, 7)]
