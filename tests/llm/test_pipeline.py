"""The pipeline against brute force, stage by stage on each stage's own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolscout.llm import language_id

from .helpers import byte_removal, edge_documents, lower, near_components, no_documents

SF = "/root/testdata/sf0.01"


GREEK = "ωμγδφσ ξζψχθ " * 40


def turned(docs, i: int) -> str:
    """The words of a document backwards: a clean text that no other is like."""
    return " ".join(docs.where(F.col("doc_id") == i).first()["text"].split()[::-1])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage on a folder whose documents have odd rows too."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    given = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    odd = edge_documents(spark).select(*corpus_pipeline.COLUMNS).withColumn("doc_id", F.col("doc_id") + 10_000)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = benchmark.where("text IS NOT NULL").orderBy(F.length("text").desc()).first()["text"]
    own = spark.createDataFrame([(20_001, GREEK, "en", "s", 1), (20_001, turned(given, 5), "en", "s", 1), (None, turned(given, 6), None, "s", 1), (None, GREEK, None, "s", 1), (None, f"{turned(given, 7)} {item} {turned(given, 7)}", "en", "s", 1)], given.select(*corpus_pipeline.COLUMNS).schema)
    docs = given.select(*corpus_pipeline.COLUMNS).union(odd).union(given.select(*corpus_pipeline.COLUMNS).where("doc_id = 3")).union(own)
    for name in ("fp", "of_id", "no_fp", "kept", "rejected", "lang_pred", "n", "row", "hits", "matches"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("doc_id", "matches", "sim", "words", "fp"):
        benchmark = benchmark.withColumn(name, F.lit("x"))
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, folder).write.parquet(f"{folder}/out-{number}")
        made = spark.read.parquet(f"{folder}/out-{number}")
        out.append((docs, made))
        docs = made
    return folder, out


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def apart(rows):
    """The rows with an id, and the texts of those without one."""
    return [r for r in rows if r[0] is not None], sorted(t or "" for i, t in rows if i is None)


def test_columns(stages):
    _, out = stages
    for docs, made in out[:-1]:
        assert made.columns == list(corpus_pipeline.COLUMNS) and [t for _, t in made.dtypes] == ["bigint", "string", "string", "string", "bigint"]


def test_language(stages):
    docs, made = stages[1][0]
    hashed = docs.select("doc_id", "text").withColumn("of_fp", F.xxhash64(F.coalesce("text", F.lit(""))))
    verdicts = language_id.identify(docs).select(F.col("doc_id").alias("of_id"), F.col("fp").alias("of"), "rejected").distinct()
    judged = hashed.join(verdicts, hashed["doc_id"].eqNullSafe(verdicts["of_id"]) & (hashed["of_fp"] == verdicts["of"])).collect()
    kept = texts(made)
    assert len(judged) == docs.count()
    assert in_order(kept) == in_order([(r["doc_id"], r["text"]) for r in judged if not r["rejected"]])
    ids = {i for i, _ in kept}
    assert not ids & {10_030, 10_031, 10_032, 10_042}
    assert len(kept) > 0.95 * len(judged)
    assert made.where("lang IS NULL").isEmpty()
    assert made.where("doc_id = 3").count() == 2
    # rows are judged by their text, not by their id
    assert made.where("doc_id = 20001").count() == 1 and GREEK not in {t for _, t in kept}
    assert made.where("doc_id IS NULL AND source = 's'").count() == 2


def test_near_duplicates(stages):
    docs, made = stages[1][1]
    (rows, unnumbered), (got, rest) = apart(texts(docs)), apart(texts(made))
    want = {i for i, root in near_components(rows).items() if i == root}
    assert sorted(i for i, _ in got) == sorted(want) and set(got) <= set(rows)
    assert rest == unnumbered and len(rest) > 1


def test_suffix_array(stages):
    docs, made = stages[1][2]
    (rows, unnumbered), (left, rest) = apart(texts(docs)), apart(texts(made))
    want = {r[0]: r for r in byte_removal(rows, 50)}
    got, given = dict(left), dict(rows)
    assert rest == unnumbered
    for i, (_, size, removed, _, _) in want.items():
        if not removed:
            assert got[i] == given[i]
        elif i in got:
            assert size - removed - 6 <= len(got[i].encode()) <= size - removed
        else:
            assert size - removed < 60
    assert all(r["n_chars"] == len(r["text"]) for r in made.join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").where("text <> before").collect())


def test_benchmark(spark, stages):
    folder, out = stages
    docs, made = out[3]
    items = [lower(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows, kept = set(texts(docs)), set(texts(made))
    inside = {(i, t) for i, t in rows if any(x in lower(t) for x in items)}
    assert inside and not inside & kept
    assert kept <= rows and len(kept) > 0.95 * len(rows)
    assert {i for i, _ in inside} >= {None} and len([i for i, _ in kept if i is None]) == len([i for i, _ in rows if i is None]) - 1


def test_tokens(stages):
    docs, made = stages[1][4]
    assert in_order(texts(made)) == in_order(texts(docs))
    assert made.where("NOT restored OR n_tokens <> size(token_ids)").isEmpty()


def test_the_whole_run_is_its_stages(spark, stages):
    folder, out = stages
    assert in_order(texts(corpus_pipeline.run(spark, folder))) == in_order(texts(out[-1][1]))


def test_no_documents(spark, tmp_path):
    no_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
