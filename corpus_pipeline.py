"""A training corpus from ``documents`` in five stages, each an operator of ``poolscout.llm``.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``.

Rows are judged by id and text. A document without an id goes through the stages that judge rows one by one (1, 4, 5) like any other;
it is in no group of near duplicates and before no other document, so stages 2 and 3 leave it as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscout.llm import decontaminate, language_id, near_dups, sentencepiece_unigram, suffix_dedup
from poolscout.llm.common import free_shuffles, saved
from poolscout.session import scratch_path, scratch_scope, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The five columns, whatever else the table holds."""
    return docs.select(*COLUMNS)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _met(docs: DataFrame, judged: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with what is known of their ids and texts; a missing id is equal to a missing id."""
    keys = judged.withColumnRenamed("doc_id", "of_id").withColumnRenamed("fp", "of_fp")
    return docs.withColumn("fp", _text_hash()).join(keys, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("fp") == F.col("of_fp")), how)


def _settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives as a written table; the scratch tables and shuffles on the way to it are deleted."""
    path = scratch_path(spark, f"pipeline-{label}")
    with scratch_scope(spark):
        frame = make()
        frame.write.parquet(path)
    schema = frame.schema
    del frame
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rows whose text is null, has no letter, or is like no learned language go. ``lang`` stays
    as given, a null one becomes the prediction."""
    docs = _columns(docs)
    found = _settled(spark, "languages", lambda: language_id.identify(docs).select("doc_id", "fp", "rejected", "lang_pred"))
    # tables of ids and hashes, so that their sizes are known and texts need not move for a few of them
    rejected = _settled(spark, "rejected", lambda: found.where("rejected").select("doc_id", "fp").distinct())
    kept = _met(docs, rejected, "left_anti").select(*COLUMNS)
    unnamed = docs.where("lang IS NULL").select(F.col("doc_id").alias("no_id"), _text_hash().alias("no_fp")).distinct()
    of = F.col("doc_id").eqNullSafe(F.col("no_id")) & (F.col("fp") == F.col("no_fp"))
    named = _settled(spark, "named", lambda: found.join(unnamed, of, "left_semi").groupBy("doc_id", "fp").agg(F.min("lang_pred").alias("lang_pred")))
    return _met(kept, named, "left").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; of rows that share an id and are one group the text
    that is least stays. Rows without an id stay."""
    given = _columns(docs)
    docs = given.where("doc_id IS NOT NULL")
    found = _settled(spark, "near", lambda: near_dups.near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")))
    gone = _settled(spark, "gone", lambda: found.where("NOT kept").select("doc_id"))
    several = _settled(spark, "several", lambda: found.where("kept AND n > 1").select("doc_id"))
    rest = docs.join(gone, "doc_id", "left_anti")
    # rows of one id move together; the others stay where they are
    once = rest.join(several, "doc_id", "left_anti")
    least = rest.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("no_text"), *COLUMNS[1:])).alias("row"))
    return once.union(least.select("doc_id", "row.*").select(*COLUMNS)).union(given.where("doc_id IS NULL"))


def without_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the strings of 50 bytes or more that an earlier document has. Where a cut falls inside a character, what is left
    of the character goes too, and documents of which nothing but white space is left go. ``n_chars`` follows the text. Texts without
    an id stay whole."""

    def whole_characters(batches):
        for batch in batches:
            texts = [v.as_buffer().to_pybytes().decode("utf-8", "ignore") for v in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "fp", "kept"])

    docs = _columns(docs)
    shorter = _settled(spark, "shorter", lambda: suffix_dedup.shortened_texts(docs).mapInArrow(whole_characters, "doc_id long, fp long, kept string"))
    rows = docs.withColumn("fp", _text_hash()).join(shorter, ["doc_id", "fp"], "left")
    rows = rows.withColumn("text", F.coalesce("kept", "text"))
    rows = rows.withColumn("n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")))
    return rows.where("text RLIKE '[^ \\t-\\r]'").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, word for word or nearly."""
    docs = _columns(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = lambda: decontaminate.find_matches(docs, benchmark).where(F.size("matches") > 0)
    found = _settled(spark, "contaminated", lambda: hit().select("doc_id", _text_hash().alias("fp")).distinct())
    return _met(docs, found, "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens; ``restored`` says that they decode to its text."""
    docs = _columns(docs)
    found = sentencepiece_unigram.encode(docs, sentencepiece_unigram.load(), check=True)
    return found.select("doc_id", "text", F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"), "restored")


def _stage(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return step(spark, docs, sf_dir)

    run.__name__, run.__doc__ = step.__name__, step.__doc__
    return run


STAGES = [
    ("language ID", _stage(known_language)),
    ("MinHash near-dedup", _stage(one_of_near_duplicates)),
    ("suffix-array dedup", _stage(without_repeated_text)),
    ("benchmark decontamination", _stage(without_benchmark)),
    ("SentencePiece encoding and decoding", _stage(tokens)),
]

#: Fitted models and near duplicates by hashing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = saved(docs, f"pipeline-{number}")
    return docs
