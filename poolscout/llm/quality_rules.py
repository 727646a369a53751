"""Quality rules by host: rule failures per document, failure rates per host shrunk by an empirical beta prior, host verdicts
joined back to the documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import map_slices, saved

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """A document fails with fewer than ``least_words`` words, more than ``most_repeats`` percent of its words in repeated
    windows, more than ``most_symbols`` percent symbols among the characters of words, or more than ``most_dup_lines`` repeated
    lines per hundred words. A host goes when its shrunk failure rate exceeds ``host_limit``."""

    least_words: int = 10
    most_repeats: int = 20
    most_symbols: int = 10
    most_dup_lines: int = 5
    host_limit: float = 0.5


_symbol = np.zeros(256, dtype=bool)
_symbol[[ord(c) for c in SYMBOLS]] = True


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = tk.text_bytes(batch.column(2))
    starts, ends, first = tk.words_of(raw, offsets)
    total = len(starts)
    n_words = np.diff(first)
    whole = (raw & 0xC0) != 0x80
    chars = tk.count_between(whole & ~tk.SEPARATORS[raw], offsets)
    symbols = tk.count_between(_symbol[raw], offsets)

    units = tk.byte_units(raw)
    sums = tk.running_sums(units)
    words = tk.run_hashes(sums, starts, ends)
    owner = np.repeat(np.arange(len(n_words)), n_words)

    # words in windows of five that the text holds twice
    window = tk.window_hashes(words, 5, 1)
    fits = np.flatnonzero(tk.windows_inside(first, 5, total))
    key = tk.mix(window[fits] ^ tk.mix(owner[fits], 5), 6)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(fits), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeats = tk.count_between(tk.covered(fits[twice], 5, total), first) if total else np.zeros(len(n_words), np.int64)

    # lines with a word that equal an earlier line of the text
    breaks = np.flatnonzero(raw == 0x0A)
    begins = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    begins = begins[begins < len(raw)]
    line_end = np.append(breaks, len(raw))[np.searchsorted(breaks, begins)]
    stops = np.minimum(line_end, offsets[np.searchsorted(offsets, begins, side="right")])
    has_word = np.searchsorted(starts, stops, side="left") > np.searchsorted(starts, begins, side="left")
    begins, stops = begins[has_word], stops[has_word]
    of = np.searchsorted(offsets, begins, side="right") - 1
    line = tk.mix(tk.run_hashes(sums, begins, stops) ^ tk.mix(of, 8), 9)
    _, kept = np.unique(line, return_index=True)
    dup = np.bincount(of, minlength=len(n_words)) - np.bincount(of[kept], minlength=len(n_words))

    arrays = [batch.column(0), batch.column(1)] + [pa.array(x, pa.int64()) for x in (n_words, chars, symbols, dup, repeats)]
    return pa.record_batch(arrays, names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Counts over every whole text, one row per row of ``docs``; a null text has no words. One pass, no shuffle."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[host_col].cast("string").alias("host"), text.alias("text"))
    return map_slices(rows, _measure, MEASURES)


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeats * F.col("n_words"))


def failed(rules: Rules) -> Column:
    return (
        base_failed(rules)
        | (100 * F.col("n_symbols") > rules.most_symbols * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > rules.most_dup_lines * F.col("n_words"))
    )


def host_rates(measures: DataFrame, rules: Rules) -> DataFrame:
    """``(host, n, n_failed, rate)``: the rate is the mean of the beta posterior whose prior the hosts' own rates give.

    The prior has the mean of all documents and, by the method of moments, the spread of the rates between hosts beyond what
    counting alone gives. Hosts that differ by no more than that have the common rate. Documents without a host are one host.
    """
    hosts = measures.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed(rules).cast("long")).alias("n_failed"))
    hosts, _ = saved(hosts, "hosts")
    # four sums over one row per host; a single row comes back
    total = hosts.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n")).alias("ff")
    ).first()
    alpha, beta = prior(total["k"], total["n"] or 0, total["f"] or 0, total["nn"] or 0.0, total["ff"] or 0.0)
    return hosts.withColumn("rate", (F.col("n_failed") + alpha) / (F.col("n") + (alpha + beta)))


def prior(k: int, n: int, f: int, nn: float, ff: float) -> tuple[float, float]:
    """Beta parameters from the number of hosts, documents and failures, the sum of squared sizes and of ``failures^2 / size``."""
    if n == 0:
        return 1.0, 1.0
    mean = f / n
    spread = mean * (1 - mean)
    if k < 2 or spread == 0:
        # nothing is known about differences: a prior as strong as ten documents
        return 10 * mean, 10 * (1 - mean)
    between = ff - n * mean * mean  # sum of size * (rate - mean)^2
    rho = (between - (k - 1) * spread) / ((n - nn / n - (k - 1)) * spread) if n - nn / n > k - 1 else 0.0
    rho = min(max(rho, 1e-4), 0.999)
    strength = 1 / rho - 1
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The counts of every document, ``base_failed``, ``kept``, and of its host the number of documents, of failures, and the shrunk rate.

    A document that fails a base rule goes; others go with their host. Null texts fail, documents without a host are judged as
    one host, repeated rows count as often as they stand. Only counts move: a host with a third of all documents is one row per
    task in the aggregate, and in the join back its rows stand against a single row, so Spark may split them.
    """
    measures, _ = saved(measure(docs, id_col, host_col, text_col), "rule-counts")
    rates = host_rates(measures, rules).select(F.col("host").alias("r_host"), "n", "n_failed", "rate")
    verdicts = measures.join(rates, measures["host"].eqNullSafe(rates["r_host"]), "left")
    bad = base_failed(rules)
    return verdicts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        bad.alias("base_failed"),
        F.col("n").alias("n_host"),
        F.col("n_failed").alias("n_host_failed"),
        F.col("rate").alias("host_rate"),
        (~bad & (F.col("rate") <= rules.host_limit)).alias("kept"),
    )
