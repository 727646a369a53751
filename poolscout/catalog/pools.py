"""Reading, validating and combining pools, label tables and run logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..operators import pool as ops
from ..operators import splits
from ..operators.objectives import computed_objective, lookup_objective
from ..operators.ordered import rank_within
from ..operators.stats import scaler, top_k_average
from ..functions.scaling import standardise
from ..operators.acquire import initial_batch
from ..session import scratch_path
from ..sources import library, runlog, scores, tables
from ..surrogate.base import training_rows
from .registry import explored, pool_scores, preds, query, r6, run_rows, runs, uniform_sql

LIBRARY_SQL = (
    "library AS (SELECT row_number() OVER (ORDER BY p_size > 25, p_partkey) - 1 AS row_idx, p_name AS id FROM part)"
)


def _library(t):
    """The parts as two compressed library files with a header, scanned in that order."""
    paths = []
    for name, kept in (("small", "p_size <= 25"), ("large", "p_size > 25")):
        path = scratch_path(t.spark, f"library-{name}")
        rows = t.part.filter(kept).orderBy("p_partkey").select("p_partkey", "p_name")
        rows.write.csv(path, header=True, sep="|", compression="gzip")
        paths.append(path)
    return library.read_library(t.spark, paths, id_column=1, sep="|")


@query("S1 SO2", f"WITH {LIBRARY_SQL} SELECT row_idx, id FROM library")
def library_scan(t):
    return _library(t)


@query("S2 P2", f"WITH {LIBRARY_SQL} SELECT row_idx, id FROM library WHERE id NOT LIKE '%ring%'")
def library_without_invalid_rows(t):
    pool = _library(t)
    return library.skip_rows(pool, ops.invalid_rows(pool, ~F.col("id").contains("ring")))


@query("SO1", f"WITH {LIBRARY_SQL} SELECT min(row_idx) AS row_idx, id FROM library GROUP BY id")
def library_without_repeats(t):
    return library.deduplicate(_library(t))


@query("SO1", "SELECT min(doc_id) AS row_idx, md5(text) AS id FROM documents GROUP BY text")
def documents_without_repeats(t):
    """Copies meet by the hash of the whole text, so the shuffle carries 32 characters and not the text."""
    pool = t.documents.select(F.col("doc_id").alias("row_idx"), F.md5(F.col("text").cast("binary")).alias("id"))
    return library.deduplicate(pool)


@query("S7", "SELECT c_name AS id FROM customer")
def library_ids(t):
    path = scratch_path(t.spark, "customers")
    t.customer.select("c_name", "c_acctbal").write.csv(path, header=True)
    return library.read_library(t.spark, [path]).select("id")


@query(
    "S3",
    "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(CASE WHEN toxic = 1 THEN -1 ELSE quality END AS DOUBLE) AS score "
    "FROM documents JOIN labels USING (doc_id)",
)
def label_table_read(t):
    """No header, tabs, id in column 1 and score in column 4; later rows replace earlier ones."""
    rows = t.documents.join(t.labels, "doc_id").select("lang", "doc_id", "source", "n_chars", "quality", "toxic")
    first = rows.select(F.lit(0).alias("pass"), "lang", "doc_id", "source", "n_chars", F.col("quality").cast("string").alias("score"))
    again = rows.filter("toxic = 1").select(F.lit(1).alias("pass"), "lang", "doc_id", "source", "n_chars", F.lit("-1").alias("score"))
    junk = rows.select(F.lit(2).alias("pass"), "lang", "doc_id", "source", "n_chars", F.lit("n/a").alias("score"))
    path = scratch_path(t.spark, "labels")
    first.union(again).union(junk).orderBy("pass", "doc_id").drop("pass").write.csv(path, sep="\t")
    return scores.read_label_table(t.spark, path, id_column=1, score_column=4, header=False, sep="\t")


def _score_file(t):
    path = scratch_path(t.spark, "scores")
    text = F.when(F.col("event_type") == "error", "failed").otherwise(F.col("value").cast("string"))
    t.events.select(F.col("event_id").alias("id"), text.alias("score")).write.csv(path, header=True)
    return path


@query("S4", "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type <> 'error' THEN value END AS score FROM events")
def previous_scores(t):
    return scores.read_scores(t.spark, _score_file(t))


@query("S5", "SELECT event_type <> 'error' AS success, count(*) AS n, round(sum(CASE WHEN event_type <> 'error' THEN value END), 6) AS total FROM events GROUP BY 1")
def scores_split(t):
    done, failed = scores.split_scores(scores.read_scores(t.spark, _score_file(t)))
    both = done.withColumn("success", F.lit(True)).union(failed.withColumn("success", F.lit(False)))
    return both.groupBy("success").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score")).alias("total"))


@query("S6 P6", "SELECT CAST(event_id AS VARCHAR) AS id, -value AS score FROM events WHERE event_type <> 'error'")
def true_scores_minimised(t):
    return scores.true_scores(t.spark, _score_file(t), maximize=False)


def _wide(t):
    """One text column per event type, blank where it is another type's event."""
    kinds = ("view", "click", "signup", "purchase")
    cells = [F.when(F.col("event_type") == k, F.col("value").cast("string")).otherwise("").alias(k) for k in kinds]
    return t.events.select(F.col("event_id").cast("string").alias("id"), "props", *cells)


@query("S8", "SELECT value AS score FROM events WHERE event_type = 'purchase'")
def target_scores(t):
    return tables.target_scores(_wide(t), "purchase")


@query(
    "S9",
    "SELECT CAST(event_id AS VARCHAR) AS id, "
    + ", ".join(f"CASE WHEN event_type = '{k}' THEN value END AS \"{k}\"" for k in ("view", "click", "signup", "purchase"))
    + " FROM events WHERE event_type <> 'error'",
)
def multitask_table(t):
    return tables.read_multitask(_wide(t), ignore_columns=["props"], skip_all_missing=True)


@query("S10 S11 X6", "SELECT p_partkey AS id, len(list_distinct(regexp_extract_all(p_name, '[^ ]+'))) AS n_bits FROM part WHERE len(p_name) > 0")
def stored_features(t):
    """Features are written once and joined by id when they are used again."""
    path = scratch_path(t.spark, "features")
    t.part.select(F.col("p_partkey").alias("id"), fingerprint(F.col("p_name"), "rdkit", 0, 1 << 24).alias("bits")).write.parquet(path)
    pool = t.part.select(F.col("p_partkey").alias("id"))
    return pool.join(t.spark.read.parquet(path), "id").select("id", F.size("bits").cast("long").alias("n_bits"))


@query(
    "S12 S14",
    "SELECT iter, count(*) AS n, count(score) AS n_ok, round(sum(score), 6) AS total FROM explored GROUP BY 1",
    ("explored",),
)
def explored_log(t):
    """One partition per iteration, read back as one table."""
    path = scratch_path(t.spark, "explored")
    explored(t).write.partitionBy("iter").parquet(f"{path}/explored")
    log = runlog.RunLog(t.spark, path).read("explored")
    return log.groupBy("iter").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_ok"), r6(F.sum("score")).alias("total")
    )


@query("S12", "SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS place FROM explored", ("explored",))
def final_log(t):
    """The written order, best first and failures last, survives in the order of the files."""
    path = scratch_path(t.spark, "final")
    log = runlog.RunLog(t.spark, path)
    log.write_final(explored(t).select("id", "score"))
    lines = t.spark.read.parquet(f"{path}/final").select(
        "id", "score", F.lit(0).alias("_lib"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos"),
    )
    return library.number_lines(lines).select("id", r6("score").alias("score"), (F.col("row_idx") + 1).alias("place"))


@query("S15", "SELECT id, round(y_mean + 3, 6) AS y_mean FROM preds", ("preds",))
def predictions_of_iteration(t):
    log = runlog.RunLog(t.spark, scratch_path(t.spark, "run"))
    for i in (1, 2, 3):
        log.write("preds", i, preds(t).select("id", (F.col("y_mean") + i).alias("y_mean")))
    return log.predictions(3, 4).select("id", r6("y_mean").alias("y_mean"))


@query(
    "S16",
    "SELECT i AS iter, count(*) AS n_retained FROM preds, (VALUES (1, 100.0), (2, 200.0), (3, 300.0)) v(i, low) WHERE y_mean >= low GROUP BY 1",
    ("preds",),
)
def retained_log(t):
    log = runlog.RunLog(t.spark, scratch_path(t.spark, "run"))
    pool = preds(t)
    for i in (1, 2, 3):
        pool = pool.filter(F.col("y_mean") >= 100.0 * i)
        log.write("retained", i, pool.select("id"))
    return log.read("retained").groupBy("iter").agg(F.count(F.lit(1)).alias("n_retained"))


@query(
    "S17 U3",
    "SELECT o_orderkey AS id, concat('n', o_custkey) AS name, o_orderpriority AS node_id, -o_totalprice AS score FROM orders",
)
def extended_log(t):
    """Results of a computed objective with the node that produced them."""
    pool = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", "o_totalprice")
    labels = computed_objective(lambda rows: F.col("o_totalprice"), minimize=True)(pool)
    log = runlog.RunLog(t.spark, scratch_path(t.spark, "run"))
    rows = pool.join(labels, "id").select(
        "id", F.concat(F.lit("n"), "o_custkey").alias("name"), F.col("o_orderpriority").alias("node_id"), "score"
    )
    return log.write("extended", 0, rows)


SPLIT_SQL = f"""
WITH ranked AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY {uniform_sql('o_orderkey', 0)}, o_orderkey) AS place,
                       count(*) OVER () AS n FROM orders)
SELECT id, CASE WHEN place <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' WHEN place <= floor(CAST(0.9 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS split
FROM ranked
"""


@query("M10 S18", SPLIT_SQL)
def random_split(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"))
    path = scratch_path(t.spark, "split")
    runlog.write_splits(splits.random_split(rows, rows.count()), path)
    return t.spark.read.parquet(path)


@query(
    "M10",
    f"SELECT id, fold, CASE fold WHEN 2 THEN 'test' WHEN 3 THEN 'val' ELSE 'train' END AS split "
    f"FROM (SELECT o_orderkey AS id, CAST(floor({uniform_sql('o_orderkey', 0)} * 5) AS INTEGER) AS fold FROM orders)",
)
def fold_split(t):
    return splits.fold_split(t.orders.select(F.col("o_orderkey").alias("id")), 5, 7)


@query(
    "M10",
    "SELECT row_idx, id, CASE WHEN id LIKE '%ring' THEN 'test' WHEN id LIKE '%gear' THEN 'val' ELSE 'train' END AS split "
    "FROM (SELECT p_partkey AS row_idx, p_name AS id FROM part)",
)
def indexed_split(t):
    rows = t.part.select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("id"))
    index = rows.filter("id LIKE '%ring' OR id LIKE '%gear'").select(
        "row_idx", F.when(F.col("id").endswith("ring"), "test").otherwise("val").alias("split")
    )
    return splits.indexed_split(rows, index)


@query(
    "M11",
    f"""
    WITH ranked AS (SELECT doc_id AS id, quality AS label,
        row_number() OVER (PARTITION BY quality ORDER BY {uniform_sql('doc_id', 0)}, doc_id) AS place FROM labels)
    SELECT id, label FROM ranked WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))
    """,
)
def balanced_sample(t):
    return splits.balanced_sample(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "label")


@query(
    "M12 A14 F12",
    "SELECT id, round((y_mean - (SELECT avg(y_mean) FROM preds WHERE cluster_id < 2000)) "
    "/ (SELECT stddev_pop(y_mean) FROM preds WHERE cluster_id < 2000), 6) AS scaled FROM preds WHERE cluster_id >= 2000",
    ("preds",),
)
def scaled_validation_targets(t):
    """Mean and spread come from the training years and are applied to the later ones."""
    fitted = scaler(preds(t).filter("cluster_id < 2000"), "y_mean")
    mean, sd = fitted.select("mean").scalar(), fitted.select("sd").scalar()
    scaled = standardise(F.col("y_mean"), mean, sd)
    return preds(t).filter("cluster_id >= 2000").select("id", r6(scaled).alias("scaled"))


@query(
    "M13",
    "SELECT 'all' AS kind, count(*) AS n, round(sum(score * y_mean), 4) AS checksum FROM explored JOIN preds USING (id) WHERE score IS NOT NULL "
    "UNION ALL SELECT 'last', count(*), round(sum(score * y_mean), 4) FROM explored JOIN preds USING (id) "
    "WHERE score IS NOT NULL AND iter = (SELECT max(iter) FROM explored)",
    ("explored", "preds"),
)
def training_set(t):
    features = preds(t).select("id", "y_mean")
    parts = [
        training_rows(explored(t), features, retrain).select(
            F.lit(kind).alias("kind"), "score", "y_mean"
        )
        for kind, retrain in (("all", True), ("last", False))
    ]
    both = parts[0].union(parts[1])
    return both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("score") * F.col("y_mean")), 4).alias("checksum")
    )


# --- projections and filters ------------------------------------------------------------------------------------------


@query(
    "P1",
    "SELECT p_partkey AS row_idx, regexp_split_to_array(id, '\\s\\|.*\\|')[1] AS id "
    "FROM (SELECT p_partkey, concat(p_name, ' |', p_brand, '| ', p_type, ' |x|') AS id FROM part)",
)
def identifiers_without_suffix(t):
    text = F.concat("p_name", F.lit(" |"), "p_brand", F.lit("| "), "p_type", F.lit(" |x|"))
    return t.part.select(F.col("p_partkey").alias("row_idx"), library.strip_suffix(text).alias("id"))


VALID_URL = "^https?://[a-z0-9.-]+/"


@query("P2", f"SELECT page_id AS row_idx, CASE WHEN regexp_matches(url, '{VALID_URL}') THEN url END AS id FROM pages")
def validated_identifiers(t):
    pool = t.pages.select(F.col("page_id").alias("row_idx"), F.col("url").alias("id"))
    return ops.mark_valid(pool, F.col("id").rlike(VALID_URL))


@query(
    "P3",
    "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: len(x) = 0)) = 0 "
    "AND len(text) > 0",
)
def rows_with_whole_identifiers(t):
    rows = t.documents.select("doc_id", F.split("text", "\n").alias("ids"))
    return ops.drop_invalid(rows, "ids", lambda x: F.lit(True)).select("doc_id")


@query(
    "P4",
    "SELECT 'a row has no target' AS message WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'error') "
    "UNION ALL SELECT 'an identifier is not valid' WHERE EXISTS (SELECT 1 FROM events WHERE event_id >= 100) "
    "UNION ALL SELECT 'a target is not a number' WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'view')",
)
def table_errors(t):
    wide = _wide(t).withColumn("click", F.when(F.col("view") != "", "seen").otherwise(F.col("click")))
    return tables.table_errors(wide, "id", ["view", "click", "signup", "purchase"], "length(id) < 3", wide.columns)


@query(
    "P5",
    "SELECT 'quality' AS task, bool_and(quality IN (0, 1)) AS ok FROM labels UNION ALL SELECT 'toxic', bool_and(toxic IN (0, 1)) FROM labels",
)
def classification_targets_ok(t):
    rows = t.labels.select(F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return tables.task_type_ok(rows, ["quality", "toxic"], classification=True)


@query("P9", "SELECT count(*) > 0 AS found FROM part WHERE p_name = (SELECT max(p_name) FROM part)")
def pool_contains(t):
    last = t.part.agg(F.max("p_name")).first()[0]
    return ops.contains(t.part.select(F.col("p_name").alias("id")), last)


def _numbered_parts(t):
    pool = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("id"))
    return rank_within(pool, [], [F.col("key").asc()], "n").select((F.col("n") - 1).alias("row_idx"), "id")


@query(
    "P10",
    "WITH pool AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_name AS id, count(*) OVER () AS n FROM part) "
    "SELECT CAST(0 AS BIGINT) AS place, row_idx, id FROM pool WHERE row_idx = 3 UNION ALL SELECT 1, row_idx, id FROM pool WHERE row_idx = n - 1 "
    "UNION ALL SELECT 2, row_idx, id FROM pool WHERE row_idx >= n // 2 AND (row_idx - n // 2) % 3 = 0",
)
def rows_by_index(t):
    pool = _numbered_parts(t)
    n = pool.count()
    return ops.fetch_rows(pool, [3, -1, slice(n // 2, None, 3)], n)


@query("P11", "SELECT count(*) AS n FROM orders")
def pool_size(t):
    return t.orders.agg(F.count(F.lit(1)).alias("n"))


@query(
    "P12",
    "SELECT row_idx // 300 AS batch, CASE WHEN row_idx < 100 THEN 0 WHEN row_idx < 600 THEN 1 ELSE 2 END AS chunk, count(*) AS n "
    "FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx FROM part) GROUP BY 1, 2",
)
def row_batches(t):
    equal = ops.number_batches(_numbered_parts(t), 300)
    both = ops.number_batches(equal.withColumnRenamed("batch", "equal"), [100, 500, 1000])
    return both.groupBy(F.col("equal").alias("batch"), F.col("batch").cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("P13", "SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY 1, 2")
def distributed_rows(t):
    rows = t.conversations.select("conv_id", F.split("text", " ").alias("words"))
    return ops.distribute(rows, "words", "word").groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P14 J6",
    "SELECT p.id, round(least(greatest(score - y_mean, -1.5), 1.5), 6) AS error FROM "
    "(SELECT id, y_mean + sqrt(y_var) / 5 AS y_mean FROM preds) p JOIN explored e USING (id) WHERE score IS NOT NULL",
    ("preds", "explored"),
)
def clipped_errors(t):
    from ..functions.scaling import clip

    shifted = preds(t).select("id", (F.col("y_mean") + F.sqrt("y_var") / 5).alias("y_mean"))
    errors = shifted.join(explored(t), "id").filter("score IS NOT NULL")
    return errors.select("id", r6(clip(F.col("score") - F.col("y_mean"), -1.5, 1.5)).alias("error"))


# --- joins and set operations -----------------------------------------------------------------------------------------


@query("J1 U1 U2", "SELECT doc_id AS id, CAST(-quality AS DOUBLE) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_scores(t):
    labels = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    return lookup_objective(labels, minimize=True)(t.documents.select(F.col("doc_id").alias("id")))


@query("U1 U3", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN round(-sqrt(o_totalprice), 6) END AS score FROM orders")
def computed_scores(t):
    """A formula as objective, evaluated by a pandas UDF; NaN is a failure and the sign is that of a minimised one."""
    @F.pandas_udf("double")
    def root(price: pd.Series, status: pd.Series) -> pd.Series:
        return pd.Series(np.where(status == "P", np.nan, np.sqrt(price)))

    batch = t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    labels = computed_objective(lambda rows: root("o_totalprice", "o_orderstatus"), minimize=True)(batch)
    return labels.select("id", r6("score").alias("score"))


@query("U7 SO3", "SELECT id FROM (SELECT p_name AS id FROM part UNION ALL SELECT reverse(p_name) FROM part UNION ALL SELECT upper(p_name) FROM part) GROUP BY id")
def library_with_variants(t):
    pool = t.part.select(F.col("p_name").alias("id"))
    return ops.append_variants(pool, F.array(F.reverse("id"), F.upper("id")))


def _turned_words(name: str):
    """Names of a pattern have variants: one for each word, with that word turned round; those that end in a vowel are left out."""
    words = name.split(" ")
    if "e" in name:
        for i, word in enumerate(words):
            variant = " ".join([*words[:i], word[::-1], *words[i + 1 :]])
            if variant[-1:] not in ("a", "e", "i", "o", "u"):
                yield variant


@query(
    "U7 SO3",
    """
    WITH w AS (SELECT string_split(p_name, ' ') AS w FROM part WHERE contains(p_name, 'e')),
    v AS (SELECT array_to_string(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN j = i THEN reverse(w[j]) ELSE w[j] END), ' ') AS id FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w))
    SELECT id FROM (SELECT p_name AS id FROM part UNION ALL SELECT id FROM v WHERE right(id, 1) NOT IN ('a', 'e', 'i', 'o', 'u')) GROUP BY id
    """,
)
def library_with_generated_variants(t):
    """Variants from a Python generator, which may yield any number for a name."""
    return ops.append_generated(t.part.select(F.col("p_name").alias("id")), _turned_words)


@query("J5", "SELECT doc_id AS id, n_chars, quality AS score FROM documents JOIN labels USING (doc_id)")
def features_with_scores(t):
    features = t.documents.select(F.col("doc_id").alias("id"), "n_chars")
    return features.join(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("score")), "id")


@query("J6", "SELECT id, score FROM preds LEFT JOIN explored USING (id)", ("preds", "explored"))
def true_scores_in_pool_order(t):
    return preds(t).select("id").join(explored(t).select("id", "score"), "id", "left")


TOP_FOUND_SQL = "(SELECT id FROM explored WHERE score IS NOT NULL ORDER BY score DESC, id DESC LIMIT 250)"
TOP_TRUE_SQL = "(SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 250)"


def _found_and_true(t):
    from ..operators.ordered import top_n

    found = top_n(explored(t).filter("score IS NOT NULL"), 250, [F.col("score").desc(), F.col("id").desc()])
    true = top_n(
        t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice"), 250, [F.col("o_totalprice").desc(), F.col("id").desc()]
    )
    return found, true


@query("SO4", f"SELECT id FROM {TOP_FOUND_SQL} INTERSECT SELECT id FROM {TOP_TRUE_SQL}", ("explored",))
def found_true_ids(t):
    found, true = _found_and_true(t)
    return found.select("id").intersect(true.select("id"))


@query(
    "SO5",
    "SELECT score, count(*) AS n FROM (SELECT value AS score FROM events EXCEPT ALL SELECT value FROM events WHERE event_type <> 'error') GROUP BY 1",
)
def missed_scores(t):
    every = t.events.select(F.col("value").alias("score"))
    return ops.multiset_difference(every, t.events.filter("event_type <> 'error'").select(F.col("value").alias("score")))


@query(
    "SO6 W10",
    "SELECT run_id, iter, count(*) AS n_new FROM (SELECT run_id, id, min(iter) AS iter FROM runs GROUP BY 1, 2) GROUP BY 1, 2",
    ("runs",),
)
def new_points_by_iteration(t):
    from ..plans.curves import new_points

    return new_points(runs(t)).groupBy("run_id", "iter").agg(F.count(F.lit(1)).alias("n_new"))


@query(
    "SO7",
    "SELECT id, arg_max(struct_pack(s := score), iter).s AS score FROM "
    "(SELECT id, score, iter FROM explored UNION ALL SELECT id, y_mean, 100 FROM preds WHERE y_var = 0) GROUP BY id",
    ("explored", "preds"),
)
def merged_scores(t):
    later = preds(t).filter("y_var = 0").select("id", F.col("y_mean").alias("score"), F.lit(100).alias("iter"))
    return ops.merge_scores(explored(t).unionByName(later))


@query(
    "L1 T2 U2 A1 A2",
    f"""
    WITH pool AS (SELECT min(doc_id) AS id FROM documents GROUP BY text),
    batch AS (SELECT id FROM pool ORDER BY {uniform_sql('id', 42)} DESC, id DESC
              LIMIT (SELECT CAST(ceil(CAST(0.1 AS DOUBLE) * count(*)) AS BIGINT) FROM pool)),
    scored AS (SELECT id, CAST(quality AS DOUBLE) AS score FROM batch LEFT JOIN labels ON doc_id = id),
    best AS (SELECT coalesce(score, 0) AS y FROM scored ORDER BY score DESC NULLS LAST, id DESC LIMIT 20)
    SELECT (SELECT count(*) FROM scored) AS n_labelled, (SELECT count(score) FROM scored) AS n_ok,
           round((SELECT avg(score) FROM scored), 6) AS batch_mean, round((SELECT sum(y) / count(*) FROM best), 6) AS top_k_avg
    """,
)
def explore_initial(t):
    """A tenth of the distinct documents, labelled by lookup."""
    pool = documents_without_repeats(t).select(F.col("row_idx").alias("id"))
    labels = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    from ..config import batch_rows
    from ..session import cut

    batch = initial_batch(pool, batch_rows(0.1, pool.count()), 42)
    done = cut(lookup_objective(labels)(batch))
    average = top_k_average(done, 20).scalar()
    return done.agg(
        F.count(F.lit(1)).alias("n_labelled"), F.count("score").alias("n_ok"), r6(F.avg("score")).alias("batch_mean")
    ).withColumn("top_k_avg", r6(average))


@query(
    "L5 S4",
    "SELECT count(*) AS n_scores, count(score) AS n_ok, count(*) AS adjustment, 0 AS labels_used FROM explored",
    ("explored",),
)
def warm_start(t):
    """Earlier scores replace the initial batch and leave the budget untouched."""
    from ..config import RunConfig
    from ..plans.explore import Exploration
    from ..surrogate.base import RandomSurrogate

    pool = preds(t).select("id", F.array("y_mean").alias("features"))
    labels = preds(t).select("id", F.col("y_mean").alias("score"))
    e = Exploration(
        t.spark, pool, lookup_objective(labels), RandomSurrogate(), RunConfig(), scratch_path(t.spark, "run"),
        previous=explored(t).select("id", "score"),
    )
    return e.explored().agg(
        F.count(F.lit(1)).alias("n_scores"), F.count("score").alias("n_ok"), F.lit(e.adjustment).cast("long").alias("adjustment"),
        F.lit(e.labels_used).alias("labels_used"),
    )
