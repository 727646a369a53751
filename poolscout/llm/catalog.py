"""The queries of this folder, with their SQL where SQL can say it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from . import compression, decontaminate, filter_audit, language_id, near_dups, oracles, quality_rules, sentencepiece_unigram, substring_dedup, suffix_dedup, token_codes, url_lists, vector_codes, warc
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op1_warc_revisits": oracles.OP1,
    "op3_host_quality": oracles.OP3,
    "op5_substring_dedup": oracles.OP5,
    "op7_suffix_dedup": oracles.OP7,
    "op9_url_lists": oracles.OP9,
    "op10_minhash_near_dups": oracles.OP10,
    "op11_filter_audit": oracles.OP11,
    "op13_vector_codes": oracles.OP13,
}


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return build(spark, folder)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """All pages through archives and deduplicated archives."""
    return warc.deduplicate_pages(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every whole text."""
    return language_id.identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected", "bits")


@query
def op3_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, its host's failures and shrunk rate, and the verdict of both."""
    return quality_rules.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_host", "n_host_failed", F.round("host_rate", 9).alias("host_rate"), "kept"
    )


@query
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every whole text."""
    vocab = sentencepiece_unigram.load()
    found = sentencepiece_unigram.encode(table(spark, folder, "documents"), vocab, check=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sentencepiece_unigram.byte_tokens(vocab).alias("n_byte_tokens"), F.xxhash64("ids").alias("ids_hash"), "restored"
    )


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 50 words that an earlier document has are removed."""
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that stand in each document."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are removed."""
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


@query
def op8_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every text by two dictionaries fitted on labelled rows."""
    docs = table(spark, folder, "documents")
    model = compression.fit(docs, table(spark, folder, "labels"))
    return model.score(docs).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference"
    )


@query
def op10_minhash_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return near_dups.near_duplicates(table(spark, folder, "documents"))


#: Days that captures and list entries fall on.
FIRST_DAY, DAYS = "2024-01-01", 360


@query
def op9_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page is a capture on a day that its id gives. The list is made of the pages' own hosts and of the domains above
    them: each is added on a day that the length and letters of its name give, and most are removed again later."""
    pages = table(spark, folder, "pages")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") * 7 % DAYS).cast("int"))
    captures = pages.select("page_id", "url", day.alias("fetched"))
    keys = pages.select(F.explode(url_lists.url_keys("url")).alias("key")).distinct()
    code = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long")
    entries = keys.where(code % 3 == 0).select(
        "key", (code % DAYS).cast("int").alias("on_day"), (code % 97).cast("int").alias("held"), F.concat(F.lit("list"), (code % 4).cast("string")).alias("category")
    )
    start = F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("on_day"))
    added = entries.select("key", F.lit("add").alias("action"), start.alias("day"), "category")
    gone = entries.where("held > 9").select("key", F.lit("remove").alias("action"), F.date_add(start, F.col("held")).alias("day"), "category")
    again = entries.where("held > 60").select("key", F.lit("add").alias("action"), F.date_add(start, 2 * F.col("held")).alias("day"), "category")
    valid = url_lists.intervals(added.union(gone).union(again))
    found = url_lists.judge(captures, valid, "page_id", "url", "fetched")
    return found.select(
        F.col("id").alias("page_id"), F.date_format("day", "yyyy-MM-dd").alias("fetched"), "host", "n_active", "active_key", "category", "listed"
    )


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters in all 120 orders over all documents, by language."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op12_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token ids through files of directly addressable codes, read back."""
    path = scratch_path(spark, "token-codes")
    token_codes.write_tokens(table(spark, folder, "documents"), path, token_codes.default_model(), end_id=2)
    return token_codes.read_documents(spark, path)


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all embeddings: 8 parts, 16 entries, 6 rounds."""
    return vector_codes.compress(table(spark, folder, "embeddings"))
