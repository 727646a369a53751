"""Readers, label tables, multi-target tables and run logs."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscout.operators import objectives, pool
from poolscout.session import scratch_path, shared_dir
from poolscout.sources import library, scores, tables
from poolscout.sources.runlog import RunLog


def write(path, text):
    path.write_text(text)
    return str(path)


def test_checkpoint_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured in shared_dir(spark) and scratch_path(spark, "x").startswith(shared_dir(spark))


def test_library_order_over_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("smiles,n\n" + "".join(f"a{i},{i}\n" for i in range(20)))
    b = write(tmp_path / "b.csv", "smiles,n\nb0,0\nb1,1\n")
    got = library.read_library(spark, [str(tmp_path / "a.csv.gz"), b]).orderBy("row_idx").collect()
    assert [r["id"] for r in got] == [f"a{i}" for i in range(20)] + ["b0", "b1"]
    assert [r["row_idx"] for r in got] == list(range(22))


def test_library_split_into_blocks(spark, tmp_path):
    path = write(tmp_path / "big.csv", "".join(f"x;id{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = library.read_library(spark, [path], id_column=1, header=False, sep=";").orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["id"] for r in got] == [f"id{i}" for i in range(5000)]
    assert [r["row_idx"] for r in got] == list(range(5000))


def test_suffix_and_invalid_rows(spark, tmp_path):
    path = write(tmp_path / "c.csv", "smiles\nCC |x| y |z|\nC C\nN\n")
    got = library.read_library(spark, [path], suffix=True)
    assert [r["id"] for r in got.orderBy("row_idx").collect()] == ["CC", "C C", "N"]
    bad = pool.invalid_rows(got, F.length("id") < 3)
    assert [r["row_idx"] for r in bad.collect()] == [1]
    assert [r["row_idx"] for r in library.skip_rows(got, bad).orderBy("row_idx").collect()] == [0, 2]
    assert [r["id"] for r in pool.mark_valid(got, F.length("id") < 3).orderBy("row_idx").collect()] == ["CC", None, "N"]


@pytest.mark.parametrize("n", [0, 1, 26])
@pytest.mark.parametrize("minimize", [True, False])
def test_lookup(spark, tmp_path, n, minimize):
    table = {chr(97 + i): i * 1.5 for i in range(n)}
    path = write(tmp_path / "t.csv", "id,score\n" + "".join(f"{k},{v}\n" for k, v in table.items()))
    objective = objectives.lookup_objective(scores.read_label_table(spark, path), minimize)
    batch = spark.createDataFrame([("a",), ("z",), ("missing",)], "id STRING")
    got = {r["id"]: r["score"] for r in objective(batch).collect()}
    sign = -1 if minimize else 1
    assert got == {k: sign * table[k] if k in table else None for k in ("a", "z", "missing")}


def test_lookup_columns_and_last_row_wins(spark, tmp_path):
    path = write(tmp_path / "s.csv", "_\ta\t_\t_\t1\n_\tb\t_\t_\tx\n_\ta\t_\t_\t2.5\n_\tc\t_\t_\tnan\n_\td\t_\t_\t1_000\n")
    got = scores.read_label_table(spark, path, id_column=1, score_column=4, header=False, sep="\t").collect()
    assert {r["id"]: r["score"] for r in got} == {"a": 2.5}


def test_scores_split_and_sign(spark, tmp_path):
    path = write(tmp_path / "p.csv", "id,score\na,1\nb,\nc,bad\nd,-2\n")
    done, failed = scores.split_scores(scores.read_scores(spark, path))
    assert {r["id"]: r["score"] for r in done.collect()} == {"a": 1.0, "d": -2.0}
    assert {r["id"] for r in failed.collect()} == {"b", "c"}
    flipped = scores.true_scores(spark, path, maximize=False).collect()
    assert {r["id"]: r["score"] for r in flipped} == {"a": -1.0, "d": 2.0}


def test_computed_objective_turns_nan_into_failure(spark):
    batch = spark.createDataFrame([(1, 4.0), (2, -1.0)], "id INT, x DOUBLE")
    got = objectives.computed_objective(lambda rows: F.sqrt("x"), minimize=True, tasks=3)(batch).collect()
    assert {r["id"]: r["score"] for r in got} == {1: -2.0, 2: None}


def test_multitask(spark):
    rows = spark.createDataFrame([("a", "1", "", "9"), ("b", " ", "0.5", "9"), ("c", "", "", "9")], "id STRING, t1 STRING, t2 STRING, note STRING")
    got = tables.read_multitask(rows, ignore_columns=["note"])
    assert got.columns == ["id", "t1", "t2"] and [tuple(r) for r in got.orderBy("id").collect()][0] == ("a", 1.0, None)
    assert tables.read_multitask(rows, ignore_columns=["note"], skip_all_missing=True).count() == 2
    with pytest.raises(ValueError, match="row_idx"):
        tables.read_multitask(rows, target_columns=["t2"], max_rows=1)
    numbered = rows.withColumn("row_idx", F.when(F.col("id") == "b", 0).when(F.col("id") == "c", 1).otherwise(2)).repartition(3)
    assert sorted(r["id"] for r in tables.read_multitask(numbered, max_rows=2).collect()) == ["b", "c"]
    assert tables.read_multitask(numbered, max_rows=2).columns == ["id", "t1", "t2", "note"]
    assert [r["score"] for r in tables.target_scores(rows, "t2").collect()] == [0.5]


def test_table_errors(spark):
    good = spark.createDataFrame([("ab", "1", "0")], "id STRING, x STRING, y STRING")
    assert tables.table_errors(good, "id", ["x", "y"], "length(id) > 1", good.columns).count() == 0
    bad = spark.createDataFrame([("a", "u", None), ("bc", "", "")], "id STRING, x STRING, `3.5` STRING")
    got = {r["message"] for r in tables.table_errors(bad.withColumnRenamed("3.5", "y"), "id", ["x", "y"], "length(id) > 1", bad.columns).collect()}
    assert got == {
        "an identifier is not valid", "a row has fewer fields than the header", "a row has no target",
        "a target is not a number", "the header looks like data",
    }
    none = {r["message"] for r in tables.table_errors(good, "id", [], "true", []).collect()}
    assert {"the header is empty", "there are no task columns"} <= none


def test_task_types(spark):
    rows = spark.createDataFrame([(0.0, 0.3), (1.0, 1.0), (None, 0.0)], "a DOUBLE, b DOUBLE")
    classes = {r["task"]: r["ok"] for r in tables.task_type_ok(rows, ["a", "b"], True).collect()}
    values = {r["task"]: r["ok"] for r in tables.task_type_ok(rows, ["a", "b"], False).collect()}
    assert classes == {"a": True, "b": False} and values == {"a": False, "b": True}


def test_config_round_trip(spark):
    log = RunLog(spark, scratch_path(spark, "log"))
    log.write_config("r1", {"metric": "ucb", "sizes": [0.1, 5], "prune": False, "budget": None, "k": 3})
    got = {r["option"]: r["value"] for r in log.read_config().collect()}
    assert got == {"metric": "ucb", "sizes": "[0.1, 5]", "k": "3"}


def test_repeated_round_replaces_its_partition(spark):
    log = RunLog(spark, scratch_path(spark, "log"))
    for values in ([1, 2, 3], [7]):
        log.write("explored", 0, spark.createDataFrame([(v, 1.0) for v in values], "id INT, score DOUBLE"))
    log.write("explored", 1, spark.createDataFrame([(8, None)], "id INT, score DOUBLE"))
    assert sorted(r["id"] for r in log.read("explored").collect()) == [7, 8]
    assert [r["id"] for r in RunLog(spark, log.path).read("explored", last=0).collect()] == [7]
    with pytest.raises(IndexError):
        log.predictions(0, 3)
    with pytest.raises(IndexError):
        log.predictions(3, 3)


def test_fetch_rows(spark):
    rows = spark.range(30).select(F.col("id").alias("row_idx"), F.col("id").alias("id"))
    fetch = lambda i: [r["id"] for r in pool.fetch_rows(rows, i, 30).collect()]
    assert fetch(4) == [4] and fetch(-1) == [29]
    assert fetch(slice(5, 12, 3)) == list(range(30))[5:12:3]
    assert fetch(slice(-4, None)) == [26, 27, 28, 29]
    assert fetch((7, slice(0, 2), -2, 7)) == [7, 0, 1, 28, 7]  # in the order asked
    with pytest.raises(IndexError):
        fetch(30)
    with pytest.raises(IndexError):
        fetch(slice(5, 0, -1))


def test_batches(spark):
    rows = spark.range(10).select(F.col("id").alias("row_idx"))
    assert [r["batch"] for r in pool.number_batches(rows, 4).orderBy("row_idx").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    assert [r["batch"] for r in pool.number_batches(rows, [1, 2, 3]).orderBy("row_idx").collect()] == [0, 1, 1] + [2] * 7


def test_small_operators(spark):
    rows = spark.createDataFrame([("x", [1, 2]), ("y", [])], "id STRING, ys ARRAY<INT>")
    assert [tuple(r) for r in pool.distribute(rows, "ys", "y").collect()] == [("x", 1), ("x", 2)]
    ids = spark.createDataFrame([("a",), ("b",)], "id STRING")
    assert pool.contains(ids, "b").first()["found"] and not pool.contains(ids, "q").first()["found"]
    merged = pool.merge_scores(spark.createDataFrame([("a", 1.0, 0), ("a", None, 1), ("b", 2.0, 0)], "id STRING, score DOUBLE, iter INT"))
    assert {r["id"]: r["score"] for r in merged.collect()} == {"a": None, "b": 2.0}
    variants = pool.append_variants(ids, F.array(F.upper("id"), F.lit("a")))
    assert sorted(r["id"] for r in variants.collect()) == ["A", "B", "a", "b"]
    left = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "score DOUBLE")
    assert {r["score"]: r["n"] for r in pool.multiset_difference(left, left.limit(1)).collect()} == {1.0: 1, 2.0: 1}
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["a", ""]), (4, ["a", None])], "k INT, ids ARRAY<STRING>")
    assert [r["k"] for r in pool.drop_invalid(lists, "ids", lambda x: x != "q").collect()] == [1]


def test_number_parsing(spark):
    texts = spark.createDataFrame([("1e3",), ("inf",), ("nan",), ("",), ("x",)], "t STRING")
    got = [r["s"] for r in texts.select(scores.to_score(F.col("t")).alias("s")).collect()]
    assert got == [1000.0, math.inf, None, None, None]
    assert np.isinf(got[1])
