from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import types as T

from poolscout.llm import filter_audit

from .helpers import edge_documents, edge_rows, no_documents, prose, words

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def by_hand(rows, labels):
    """``rows`` are ``(doc_id, text, lang)``; every order is applied from left to right."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, lang in rows:
        t, w = text or "", words(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i,
        }
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, found in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = found
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                total[letter] += len(gone)
                failing = sum(letter in d[0] for d in found)
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[0] == {letter} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*line, total[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_odd_documents_and_labels(spark):
    labels = [(7, 1, 0), (10, 1, 1), (12, 0, 1), (12, 1, 0), (12, None, None), (43, 0, 0), (None, 1, 1), (999, 1, 1), (50, 1, 1)]
    docs = edge_documents(spark).selectExpr("*", "1 AS quality", "1 AS toxic", "'m' AS mask", "'p' AS part", "0 AS slot", "'d' AS digest", "1 AS copies", "array('w') AS words", "1 AS id")
    got = rows_of(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS).selectExpr("*", "1 AS id", "1 AS good", "'t' AS text")))
    assert got == by_hand([(r[0], r[1], r[2]) for r in edge_rows()], labels)


def test_copies_across_parts_and_a_group_of_a_third(spark):
    rows = [(i, "same WORDS here", "ab"[i % 2]) for i in range(100, 200)] + [(i, prose(i % 20, 30) + " x" * (i % 3), "abc"[i % 3]) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 200, 3)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert rows_of(filter_audit.audit(frame, spark.createDataFrame(labels, LABELS))) == by_hand(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(no_documents(spark), none).collect() == []
    rows = [(1, "a", "x"), (2, "a", "x")]
    assert rows_of(filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), none)) == by_hand(rows, [])


@pytest.mark.parametrize("n_filters", [1, 3, 6])
def test_walk_gives_the_survivors_of_every_subset(n_filters):
    rng = np.random.default_rng(n_filters)
    masks = rng.integers(0, 1 << n_filters, 40)
    weights = rng.integers(0, 100, (40, 2))
    found = filter_audit.gray_walk(masks, weights, n_filters)
    for subset in range(1 << n_filters):
        assert found[subset].tolist() == weights[masks & subset == 0].sum(axis=0).tolist()


def test_states_of_a_part(spark):
    rows = [(i, prose(i, 5 + 40 * (i % 4)) + (" #" if i % 3 else ""), "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = filter_audit.states(filter_audit.cells(docs, spark.createDataFrame([], LABELS), filter_audit.text_filters()), 5).collect()
    assert len(found) == 1 and len(found[0]["docs"]) == 32 and found[0]["docs"][0] == 30
    assert sum(found[0]["total"]) == 120 * (found[0]["docs"][0] - found[0]["docs"][31])
