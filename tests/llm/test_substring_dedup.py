import pytest

from poolscout.llm import substring_dedup, textkernel as tk

import numpy as np
import pyarrow as pa

from .helpers import SMALL, edge_documents, edge_rows, no_documents, prose, word_removal, words


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("length", [50, 7, 3])
def test_equals_brute_force_on_documents(spark, length):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(substring_dedup.remove_repeats(docs, length)) == word_removal(given, length)


@pytest.mark.parametrize("length", [50, 4])
def test_edge_rows(spark, length):
    given = [(r[0], r[1]) for r in edge_rows() if r[0] is not None]
    assert rows_of(substring_dedup.remove_repeats(edge_documents(spark), length)) == word_removal(given, length)


def test_text_comes_along(spark):
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(edge_documents(spark), with_text=True).collect()}
    assert got[12] == "" and got[30] == "" and got[33] == "one two three"
    assert prose(1, 120) in got[7] and got[20] == prose(5, 90) + " " + prose(6, 10) and got[21] == ""


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(no_documents(spark)).collect() == []


def test_doubling_ends_with_the_longest_repeat(spark):
    text = prose(1, 130)
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, prose(2, 130)), (4, None)], "doc_id long, text string")
    got = {tuple(r) for r in substring_dedup.longest_repeats(docs, 8).collect()}
    assert got == {(n, i) for n in (8, 16, 32, 64, 128) for i in (1, 2)}


def test_levels_are_halves_of_the_final_length():
    assert substring_dedup.doubling(50) == [13, 25, 50]
    assert substring_dedup.doubling(7) == [4, 7]
    assert substring_dedup.doubling(50, 2) == [2, 4, 7, 13, 25, 50]


def test_each_level_leaves_out_what_its_length_tells(spark):
    """Passages shorter than the window survive some levels and not the last; candidates are those of the level before it."""
    rows = []
    for i, n in enumerate((10, 20, 40, 49, 50, 51, 130)):
        rows += [(2 * i, f"{prose(100 + i, 40)} {prose(i, n)} {prose(200 + i, 40)}"), (2 * i + 1, f"{prose(300 + i, 60)} {prose(i, n)} {prose(400 + i, 5)}")]
    rows += [(50, f"{prose(500, 60)} {prose(6, 130)}"), (51, prose(501, 500)), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring_dedup.remove_repeats(docs)) == word_removal(rows, 50)
    _, candidates, removed = substring_dedup.repeated_windows(docs)
    assert {8, 9, 10, 11, 12, 13, 50} <= {r["doc_id"] for r in candidates.collect()} <= {*range(4, 14), 50}
    assert {r["doc_id"] for r in removed.collect()} == {9, 11, 13, 50}


def test_no_candidate_survives(spark):
    rows = [(i, prose(i, 80)) for i in range(5)]
    assert rows_of(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == word_removal(rows, 50)


def test_words_are_maximal_runs_of_each_text():
    texts = ["", " a", "b\x0bc ", None, "\t\n", "dé\x85f", "g"]
    raw, offsets = tk.text_bytes(pa.array(texts))
    starts, ends, first = tk.words_of(raw, offsets)
    got = [[raw[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
    assert got == [words(t) for t in texts]


def test_equal_windows_have_equal_hashes_wherever_they_stand():
    rng = np.random.default_rng(1)
    units = tk.mix(rng.integers(0, 3, 400))
    for length in (1, 2, 7, 50):
        hashes = tk.window_hashes(units, length, 5)
        seen = {}
        for k in range(len(units) - length + 1):
            assert seen.setdefault(units[k : k + length].tobytes(), hashes[k]) == hashes[k]
        assert len(set(seen.values())) == len(seen)
