import hashlib
import math

import numpy as np
import pytest

from poolscout.llm import vector_codes
from poolscout.llm.vector_codes import Options

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [0.0 if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    each = width // parts
    cut = [[v[p * each : (p + 1) * each] for v in ints] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(x, books[p])[1] for x in cut[p]]
            for e in range(len(books[p])):
                if own := [x for x, o in zip(cut[p], of) if o == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    final = [[nearest(cut[p][n], books[p]) for p in range(parts)] for n in range(len(kept))]
    errors = [sum(q for q, _ in f) for f in final]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, _, label), f, err in zip(kept, final, errors)), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def vectors(seed, n, d, spread=1.0, kinds=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (kinds, d))
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(kinds)] + rng.normal(0, 0.2, d)], int(rng.integers(4))) for i in range(n)]


def test_odd_vectors(spark):
    rows = vectors(1, 60, 16)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1), (101, [None] + [0.5] * 15, 1), (102, [nan] * 16, 1), (-5, [inf] + [0.0] * 15, 1), (103, [-inf] * 16, None), (-3, [0.25] * 16, None), (-3, [0.125] * 16, None)]
    rows += [(104, rows[0][1], None), (0, rows[0][1], 0), (0, rows[0][1], 0), (None, rows[1][1], 9), (105, [0.1] * 5, 2), (106, [], 2), (107, [-0.0001] * 16, 3), (108, [5.0] * 16, 3)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS x", "3 AS code", "4 AS error", "5 AS of", "6 AS sums", "7 AS label_error")
    assert rows_of(vector_codes.compress(frame)) == by_hand(rows)


def test_a_third_are_copies_and_all_are_ties(spark):
    rows = [(i, [0.5] * 8, 0) for i in range(300)] + vectors(2, 300, 8)
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    assert rows_of(vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_hand(rows)
    same = [(i, [0.25] * 8, 1) for i in range(40)]
    assert rows_of(vector_codes.compress(spark.createDataFrame(same, SCHEMA))) == by_hand(same)


@pytest.mark.parametrize("n", [1, 2, 9])
def test_fewer_rows_than_entries(spark, n):
    rows = vectors(n, n, 24)
    assert rows_of(vector_codes.compress(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_no_row(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], SCHEMA)).collect() == []


def test_large_components(spark):
    rows = [(i, [float(np.float32(x * 5000)) for x in v], label) for i, v, label in vectors(3, 50, 8)]
    assert rows_of(vector_codes.compress(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)
    with pytest.raises(Exception, match="or more"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], SCHEMA)).collect()


def test_bounds_spare_work_and_adapt(spark):
    rows = vectors(4, 3000, 64, kinds=5)
    model = vector_codes.fit(spark.createDataFrame(rows, SCHEMA), Options())
    later = model.work[1:]
    parts = 8 * len(rows)
    assert all(needed.sum() == parts for _, needed in later)
    looked = [sum(m * c for m, c in enumerate(needed[:-1])) + 15 * needed[-1] for _, needed in later]
    assert looked[-1] < 0.3 * 15 * parts and looked[-1] < looked[0]
    widths = [b for b, _ in model.work]
    assert widths == sorted(widths, reverse=True) and widths[-1] < widths[0]


def test_fewer_bounds_in_one_round_than_the_next_would_like(spark, monkeypatch):
    wishes = iter([3, 2, 4, 1, 3, 2])
    monkeypatch.setattr(vector_codes, "next_bounds", lambda *_: next(wishes))
    rows = vectors(6, 400, 16, kinds=30)
    assert rows_of(vector_codes.compress(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


@pytest.mark.parametrize("b", [1, 3, 7, 15])
def test_bounds_never_miss_the_nearest(b):
    rng = np.random.default_rng(b)
    rows = rng.integers(-40, 40, (500, 4)).astype(np.int32)  # small numbers, so that distances tie
    book = rng.integers(-40, 40, (16, 4)).astype(np.int64)
    code, near, low = vector_codes.ranked(vector_codes.distances(rows, book), b)
    needed = np.zeros(b + 2, dtype=np.int64)
    for turn in range(12):
        following = book + rng.integers(-6, 7, book.shape) // (1 + turn // 3)
        moved = np.nextafter(np.sqrt(((following - book) ** 2).sum(1).astype(np.float64)), np.inf)
        book = following
        code, near, low = vector_codes.reassign(rows, book, code, near, vector_codes.moved_bounds(code, near, low, moved), needed)
        squares = vector_codes.distances(rows, book)
        assert code.tolist() == np.argmin(squares, axis=1).tolist()
        true = np.sqrt(np.take_along_axis(squares, near.astype(np.int64), 1))
        assert (np.diff(low.astype(np.float64), axis=1) >= 0).all() and (low[:, :b] <= true).all()
        rest = squares.astype(np.float64)
        np.put_along_axis(rest, np.concatenate((code[:, None], near), axis=1).astype(np.int64), np.inf, 1)
        assert (low[:, b] <= np.sqrt(rest.min(axis=1))).all()
    assert needed[0] > 0 and needed[1:].sum() > 0
