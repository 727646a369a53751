import random

import numpy as np
import pytest

from poolscout.llm import suffix_dedup

from .helpers import SMALL, byte_removal, edge_documents, edge_rows, no_documents, prose


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("length", [50, 23])
def test_equals_brute_force_on_documents(spark, length):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(suffix_dedup.remove_repeats(docs, length)) == byte_removal(given, length)


def test_edge_rows(spark):
    given = [(r[0], r[1]) for r in edge_rows() if r[0] is not None]
    assert rows_of(suffix_dedup.remove_repeats(edge_documents(spark))) == byte_removal(given, 50)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(no_documents(spark)).collect() == []


def test_periodic_and_overlapping_texts(spark):
    pick = random.Random(5)
    rows = [(i, "".join(pick.choice("ab") for _ in range(400))) for i in range(30)]
    rows += [(40, "ab" * 300), (41, "ba" * 200), (42, "a" * 500), (43, "a" * 120 + "b" + "a" * 120), (44, "\x00" * 80), (45, "\x00" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(docs)) == byte_removal(rows, 50)


def test_kept_bytes_come_along(spark):
    docs = spark.createDataFrame([(1, "é" * 40), (2, "x" + "é" * 40 + "y")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    assert got == {1: ("é" * 40).encode(), 2: b"xy"}


def maximal_by_hand(texts, length):
    """Groups of all occurrences of the strings that can be extended neither way without losing one."""
    places: dict = {}
    for t, text in enumerate(texts):
        for a in range(len(text)):
            for b in range(a + length, len(text) + 1):
                places.setdefault(text[a:b], []).append((t, a))
    out = set()
    for string, found in places.items():
        if len(found) < 2:
            continue
        lefts = {texts[t][a - 1 : a] if a else (t, a) for t, a in found}
        rights = {texts[t][a + len(string) : a + len(string) + 1] or (t, a) for t, a in found}
        if len(lefts) > 1 and len(rights) > 1:
            out.add((string, tuple(sorted(found))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_intervals_are_the_maximal_repeats(seed):
    pick = random.Random(seed)
    texts = sorted({bytes(pick.choice(b"ab") for _ in range(pick.randint(3, 14))) for _ in range(6)})
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    group, context, offset, depth = suffix_dedup.repeats_of_contexts(data, begin, size, 3)
    got = set()
    for g in np.unique(group):
        at = group == g
        assert len(set(depth[at])) == 1
        found = tuple(sorted(zip(context[at].tolist(), offset[at].tolist())))
        t, a = found[0]
        got.add((texts[t][a : a + depth[at][0]], found))
    assert got == maximal_by_hand(texts, 3)


def test_stack_scan_by_hand():
    first, last, depth = suffix_dedup.maximal_intervals(np.array([0, 3, 5, 3, 0, 4]), np.array([1, 1, 2, 1, 7, 7]))
    assert sorted(zip(first.tolist(), last.tolist(), depth.tolist())) == [(0, 3, 3), (1, 2, 5)]


def test_groups_name_every_occurrence(spark):
    text = prose(1, 20)[:70]
    docs = spark.createDataFrame([(i, f"{i} {text} {i}") for i in range(5)], "doc_id long, text string")
    rows = suffix_dedup.maximal_repeats(docs).collect()
    covered = {i: set() for i in range(5)}
    for r in rows:
        covered[r["doc_id"]] |= set(range(r["start"], r["start"] + len(r["content"])))
        assert f"{r['doc_id']} {text} {r['doc_id']}".encode()[r["start"] :].startswith(bytes(r["content"]))
    assert all(len(c) >= 72 for c in covered.values())
    for g in {r["repeat"] for r in rows}:
        assert {r["doc_id"] for r in rows if r["repeat"] == g} == set(range(5))
