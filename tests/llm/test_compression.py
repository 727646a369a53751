import numpy as np
from pyspark.sql import functions as F

from poolscout.llm import compression

from .helpers import edge_documents, edge_rows, no_documents

SF = "/root/testdata/sf0.1"


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = compression.fit(docs, labels).score(docs).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    held = got.where("held").join(labels.where("quality IS NOT NULL"), "doc_id").toPandas()
    good, bad = held.loc[held["quality"] == 1, "score"], held.loc[held["quality"] == 0, "score"]
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.93
    assert (good >= 0.3).mean() > 0.98 and (bad >= 0.3).mean() < 0.4
    # calibrated: the mean score is the share of good rows
    assert abs(held["score"].mean() - len(good) / len(held)) < 0.05


def test_fold_0_is_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (compression.fit(docs, x) for x in (labels, turned))
    assert (a.good, a.bad, a.slope, a.offset) == (b.good, b.bad, b.slope, b.offset)


def test_edge_rows(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, 0), (33, 1, None), (41, None, 1), (None, 1, 1), (99, 0, 0), (20, 5, 0)], "doc_id long, quality int, toxic int")
    rows = compression.fit(docs, labels).score(docs).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["difference"] for r in rows if r["doc_id"] in (30, 31)} == {0.0}


def test_no_labels_and_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in compression.fit(edge_documents(spark), labels).score(edge_documents(spark)).collect()} == {0.5}
    assert compression.fit(no_documents(spark), labels).score(no_documents(spark)).collect() == []


def test_long_texts_are_compressed_whole():
    good, bad = (compression._compressor(t * 40, 3) for t in (b"alpha beta gamma ", b"### *** %%% "))
    head, tail = b"alpha beta gamma " * 500, b"### *** %%% " * 500
    whole = compression.difference(head + tail, good, bad, 256)
    assert compression.difference(head, good, bad, 256) > whole > compression.difference(tail, good, bad, 256)


def test_calibration():
    x = np.linspace(-1, 1, 2001)
    y = (np.random.default_rng(1).random(2001) < 1 / (1 + np.exp(-(4 * x + 1)))).astype(float)
    slope, offset = compression.calibrate(x, y)
    assert abs(slope - 4) < 0.6 and abs(offset - 1) < 0.3
    assert compression.calibrate(np.empty(0), np.empty(0)) == (0.0, 0.0)
