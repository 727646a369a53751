"""Exact neighbour pairs, density clusters, components and leaders by rounds against brute force."""

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest

from poolscout.operators.density import connected_components, density_clusters
from poolscout.operators.neighbours import distinct_sets, greedy_independent, neighbour_pairs, set_members
from poolscout.operators.similarity import pick_leaders

SCHEMA = "id long, bits array<int>"


def random_sets(seed, n, length, most, common=()):
    """Sets that share bits of ``common`` with a chance of a third, some of them near copies of an earlier one."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and pick.random() < 0.4:
            bits = set(pick.choice(rows)[1])
            for b in pick.sample(range(length), 2):
                bits ^= {b}
        else:
            bits = set(pick.sample(range(length), pick.randint(0, most)))
        bits |= {b for b in common if pick.random() < 0.34}
        rows.append((i, sorted(bits)))
    return [(pick.randrange(10**6) * 10_000 + i, b) for i, b in rows]


def similarity(x, y):
    x, y = set(x), set(y)
    return len(x & y) / len(x | y) if x | y else 0.0


def by_hand(rows, floor):
    first = {}
    for i, b in rows:
        if b is not None:
            first[tuple(b)] = min(i, first.get(tuple(b), i))
    sets = sorted((i, b) for b, i in first.items())
    return sorted((a, b, similarity(x, y)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if similarity(x, y) >= floor)


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("distance", [0.2, 0.5, 0.65, 0.8])
@pytest.mark.parametrize("options", [{}, {"hot_sets": 5}, {"hot_sets": 5, "block": 4}, {"hot_sets": 10**6, "block": 16}])
def test_pairs(spark, distance, options):
    rows = random_sets(3, 220, 64, 14, common=(60, 61, 62)) + [(-1, []), (-2, [5]), (-3, [5, 6]), (-4, [6]), (-5, None), (-6, [5])]
    sets = distinct_sets(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ranks", "2 AS block"))
    assert found(neighbour_pairs(sets, 64, distance, **options)) == by_hand(rows, 1 - distance)


def test_bits_that_come_together_in_all_sets(spark):
    rows = [(i, sorted({0, 1, 2, 10 + i % 50, 60 + i // 50})) for i in range(300)]
    sets = distinct_sets(spark.createDataFrame(rows, SCHEMA))
    assert found(neighbour_pairs(sets, 80, 0.5, hot_sets=20, block=64)) == by_hand(rows, 0.5)


def test_wide_fingerprints_and_names_as_ids(spark):
    rows = [(f"n{i}", b) for i, b in random_sets(5, 120, 3000, 12)]
    sets = distinct_sets(spark.createDataFrame(rows, "id string, bits array<int>"))
    assert found(neighbour_pairs(sets, 3000, 0.6)) == by_hand(rows, 0.4)


def test_no_sets_and_impossible_distances(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(neighbour_pairs(distinct_sets(empty), 64, 0.5)) == []
    with pytest.raises(ValueError):
        neighbour_pairs(distinct_sets(empty), 64, 1.0)


def test_members_of_a_large_group_of_copies(spark):
    rows = [(i, [1, 2, 3]) for i in range(500)] + [(1000, [1, 2]), (1001, None)]
    items = spark.createDataFrame(rows, SCHEMA)
    assert found(distinct_sets(items).select("id", "members")) == [(0, 500), (1000, 1)]
    assert found(set_members(items)) == [(i, 0) for i in range(500)] + [(1000, 1000)]


def test_components(spark):
    path = [(i, i + 1) for i in range(400)]
    hub = [(1000, 1001 + i) for i in range(300)]
    rest = [(5000, 5001), (5001, 5002), (5002, 5000), (6000, 6000)]
    pairs = spark.createDataFrame(path + hub + rest, "a long, b long")
    want = [(i, 0) for i in range(401)] + [(1000 + i, 1000) for i in range(301)] + [(i, 5000) for i in (5000, 5001, 5002)]
    assert found(connected_components(pairs, most_rounds=40)) == want
    assert found(connected_components(pairs.where("a < 0"))) == []


def density_by_hand(rows, floor, least):
    near = {i: [j for j, c in rows if b and c and similarity(b, c) >= floor] or [i] for i, b in rows}
    core = {i for i, n in near.items() if dict(rows)[i] and len(n) >= least}
    cluster = {}
    for i in sorted(core):
        if i not in cluster:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in cluster:
                    cluster[k] = i
                    stack += [j for j in near[k] if j in core]
    first = {}
    for i, b in rows:
        first[tuple(b)] = min(i, first.get(tuple(b), i))
    # of a border item's core neighbours the one whose bits have the least id decides
    named = lambda i: min((first[tuple(dict(rows)[j])] for j in near[i] if j in core), default=None)
    return sorted((i, cluster[i] if i in core else cluster.get(named(i)), i in core) for i, _ in rows)


@pytest.mark.parametrize("least", [1, 3, 6])
def test_density_clusters(spark, least):
    rows = random_sets(8, 150, 40, 9, common=(0,))
    rows += [(-i - 1, rows[4][1]) for i in range(5)] + [(-50 - i, []) for i in range(4)]
    got = sorted((tuple(r) for r in density_clusters(spark.createDataFrame(rows, SCHEMA), 40, 0.5, least).collect()), key=str)
    assert got == sorted(density_by_hand(rows, 0.5, least), key=str)


def test_rounds_take_what_a_pass_in_order_takes(spark):
    pick = random.Random(4)
    pairs = {tuple(sorted(pick.sample(range(150), 2))) for _ in range(400)} | {(0, i) for i in range(1, 100)}
    taken = []
    for i in range(150):
        if not any((j, i) in pairs for j in taken):
            taken.append(i)
    nodes = spark.createDataFrame([(i,) for i in range(150)], "id long")
    assert found(greedy_independent(nodes, spark.createDataFrame(sorted(pairs), "a long, b long"))) == [(i,) for i in taken]


def test_leaders_by_rounds_are_those_by_blocks(spark):
    items = spark.createDataFrame(random_sets(9, 300, 64, 10, common=(1,)), SCHEMA)
    for picks in (None, 7):
        by_blocks = found(pick_leaders(items, 64, 0.6, picks, block=32, method="blocks").select("id"))
        assert found(pick_leaders(items, 64, 0.6, picks, method="rounds").select("id")) == by_blocks
    with pytest.raises(ValueError):
        pick_leaders(items, 64, method="other")


@pytest.mark.parametrize("distance", [0.2, 0.5, 0.8])
@pytest.mark.parametrize("options", [{"method": "all"}, {"method": "all", "block": 40}, {"method": "prefix"}, {"method": "prefix", "hot_sets": 5, "block": 4}])
def test_pairs_of_either_method(spark, distance, options):
    rows = random_sets(3, 220, 64, 14, common=(60, 61, 62)) + [(-1, []), (-2, [5]), (-3, [5, 6]), (-4, [6]), (-5, None), (-6, [5])]
    sets = distinct_sets(spark.createDataFrame(rows, SCHEMA))
    assert found(neighbour_pairs(sets, 64, distance, **options)) == by_hand(rows, 1 - distance)
    with pytest.raises(ValueError):
        neighbour_pairs(sets, 64, distance, method="other")


def test_long_sets_are_sent_once_per_block(spark, monkeypatch):
    """Sets of 300 bits out of 1024: under the bits of their prefixes, which nearly all are split, each would be sent some ten thousand times."""
    from poolscout.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAST_PACKED", 50)
    monkeypatch.setattr(neighbours, "PART", 16)
    pick = random.Random(6)
    rows = [(i, sorted(pick.sample(range(1024), pick.randint(200, 400)))) for i in range(150)]
    rows += [(1000 + i, sorted(set(b) ^ set(pick.sample(range(1024), 60)))) for i, b in rows[:60]]
    sets = distinct_sets(spark.createDataFrame(rows, SCHEMA))

    def sent(*a, **k):
        raise AssertionError("sets were posted under their bits")

    monkeypatch.setattr(neighbours, "_keys", sent)
    assert found(neighbour_pairs(sets, 1024, 0.4, hot_sets=20)) == by_hand(rows, 0.6) != []


@pytest.mark.parametrize("least", [2, 4])
def test_density_clusters_of_long_sets(spark, monkeypatch, least):
    from poolscout.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAST_PACKED", 40)
    pick = random.Random(7)
    rows = [(i, sorted(pick.sample(range(512), pick.randint(120, 200)))) for i in range(60)]
    rows += [(100 + i, sorted(set(rows[i % 25][1]) ^ set(pick.sample(range(512), 20)))) for i in range(80)] + [(300, rows[3][1])]

    def sent(*a, **k):
        raise AssertionError("sets were posted under their bits")

    monkeypatch.setattr(neighbours, "_keys", sent)
    got = sorted((tuple(r) for r in density_clusters(spark.createDataFrame(rows, SCHEMA), 512, 0.4, least).collect()), key=str)
    assert got == sorted(density_by_hand(rows, 0.6, least), key=str)


@pytest.mark.parametrize("least", [2, 5, 200])
def test_a_group_of_near_copies_is_not_written_out_as_pairs(spark, monkeypatch, least):
    """All but some sets are near each other: a block gives out a few rows per set, and counts and clusters are those of all pairs."""
    from poolscout.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAST_PACKED", 50)
    monkeypatch.setattr(neighbours, "PART", 16)
    pick = random.Random(11)
    base = sorted(pick.sample(range(512), 150))
    rows = [(i, sorted(set(base) ^ set(pick.sample(range(512), 16)))) for i in range(150)]
    rows += [(200 + i, sorted(set(pick.sample(range(512), 150)))) for i in range(20)]
    rows += [(300 + i, sorted(set(rows[155 + i][1]) ^ set(pick.sample(range(512), 20)))) for i in range(6)] + [(400, rows[3][1]), (401, rows[3][1])]
    items = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in density_clusters(items, 512, 0.4, least).collect()), key=str)
    assert got == sorted(density_by_hand(rows, 0.6, least), key=str)
    if least < 200:
        links, near = neighbours.near_links(distinct_sets(items).withColumnRenamed("members", "weight"), 512, 0.4, least)
        pairs = by_hand(rows, 0.6)
        assert links.count() < len(pairs) / 4
        weight = {i: 3 if i == 3 else 1 for i, _ in rows}
        want = {i: sum(weight[b if i == a else a] for a, b, _ in pairs if i in (a, b)) for i, _ in rows}
        assert {r["id"]: r["near"] for r in near.collect()} == {i: n for i, n in want.items() if n}


def test_blocks_do_not_grow_in_number_with_the_partitions(spark):
    """Sets are sent once per block, so more blocks than their number asks for are more to send."""
    from poolscout.operators import neighbours

    pick = random.Random(12)
    rows = [(7, sorted(pick.sample(range(256), pick.randint(60, 64)))) for _ in range(300)]
    ranked = neighbours._ranked(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L AS weight").repartition(20), 256, 0.4)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["block", "ids"])

    blocks = neighbours._all_pairs(ranked.rows, 256, 0.6, 300, "long", 100, seen, "block long, ids array<long>")
    sizes = {r["block"]: len(r["ids"]) for r in blocks.collect()}
    assert len(sizes) <= 4 and sum(sizes.values()) == 300 and max(sizes.values()) < 150


def maps_of(rows, length):
    has = np.zeros((len(rows), length), dtype=np.uint8)
    for i, b in enumerate(rows):
        has[i, list(b)] = 1
    return np.packbits(has, axis=1)


@pytest.mark.parametrize("length, most", [(60, 50), (500, 60), (500, 400), (2048, 300), (2048, 2000)])
@pytest.mark.parametrize("floor", [0.35, 0.6, 1.0])
def test_what_a_few_words_rule_out_is_not_near(monkeypatch, length, most, floor):
    """Sets of all sizes in parts of a few, the number of words chosen or held at any; the pairs are those of all bits."""
    from poolscout.operators import neighbours

    pick = random.Random(length + most)
    rows = [set(pick.sample(range(length), pick.randint(1, most))) for _ in range(60)]
    rows += [r ^ set(pick.sample(range(length), min(len(r) // 3, 40))) or r for r in rows[:40]] + [set(range(length))]
    left, right = maps_of(rows[:70], length), maps_of(rows[30:], length)
    near = lambda x, y: similarity(x, y) >= floor
    two = {(i, j) for i, x in enumerate(rows[:70]) for j, y in enumerate(rows[30:]) if near(x, y)}
    one = {(i, j) for i, x in enumerate(rows[:70]) for j, y in enumerate(rows[:70]) if i < j and near(x, y)}
    chosen = neighbours._words_to_compare
    monkeypatch.setattr(neighbours, "TILE", 64)
    monkeypatch.setattr(neighbours, "MOST_FOUND", 20)
    for words in (None, 1, 3, 4, 5, -(-length // 64)):
        monkeypatch.setattr(neighbours, "_words_to_compare", lambda x, *a: min(words, x.shape[1]) if words else chosen(x, *a))
        parts = [*neighbours._near_in_parts(left, right, False, floor, length)]
        found = [(i, j) for row, col, _ in parts for i, j in zip(row.tolist(), col.tolist())]
        assert len(found) == len(two) and set(found) == two
        assert all(s == similarity(rows[i], rows[30 + j]) for row, col, value in parts for i, j, s in zip(row.tolist(), col.tolist(), value.tolist()))
        found = [tuple(sorted(p)) for row, col, _ in neighbours._near_in_parts(left, left, True, floor, length) for p in zip(row.tolist(), col.tolist())]
        assert len(found) == len(one) and set(found) == one


def test_unlike_sets_are_not_counted_in_whole(monkeypatch):
    """Sets of 200 bits out of 2048 differ in so many that an eighth to a quarter of their words tells; where all are near, these are not tried first."""
    from poolscout.operators import neighbours

    pick = random.Random(13)
    rows = [set(pick.sample(range(2048), 200)) for _ in range(300)]
    words = []
    folded = neighbours._folded
    monkeypatch.setattr(neighbours, "_folded", lambda z, n: words.append((len(z), n)) or folded(z, n))
    assert not [*neighbours._near_in_parts(maps_of(rows, 2048), maps_of(rows, 2048), True, 0.6, 2048)]
    assert max(words)[0] == 300 and max(words)[1] <= 8
    words.clear()
    near = maps_of([rows[0] ^ {i} for i in range(300)], 2048)
    assert sum(len(row) for row, _, _ in neighbours._near_in_parts(near, near, True, 0.6, 2048)) == 300 * 299 // 2
    assert max(words) == (300, 32)


def test_blocks_of_sets_that_are_likely_near_are_smaller(spark, monkeypatch):
    """All of the sets hold most of the bits, so all pairs are near, and two blocks give out as many as their sizes multiplied."""
    from poolscout.operators import neighbours

    monkeypatch.setattr(neighbours, "MOST_NEAR", 50)
    pick = random.Random(14)
    rows = [(i, sorted(pick.sample(range(256), pick.randint(230, 240)))) for i in range(300)] + [(1000 + i, sorted(pick.sample(range(256), 60))) for i in range(300)]
    ranked = neighbours._ranked(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L AS weight"), 256, 0.4)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["block", "ids"])

    blocks = neighbours._all_pairs(ranked.rows, 256, 0.6, 600, "long", 400, seen, "block long, ids array<long>").collect()
    sizes = {r["block"]: len(r["ids"]) for r in blocks}
    assert sum(sizes.values()) == 600
    assert max(sum(i < 300 for i in r["ids"]) for r in blocks) < 100
    assert found(neighbour_pairs(distinct_sets(spark.createDataFrame(rows, SCHEMA)), 256, 0.4, method="all")) == by_hand(rows, 0.6)


def test_few_edges_are_settled_in_one_task(spark, monkeypatch):
    """Rounds go on while edges are many, and what is left is one task's; a round takes several jobs, and the driver keeps what it knows of each."""
    from poolscout.operators import density

    pick = random.Random(15)
    pairs = sorted({tuple(sorted(pick.sample(range(260), 2))) for _ in range(180)}) + [(i, i + 1) for i in range(300, 500)] + [(900, 900)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = []
    for i in near:
        seen, open_ = {i}, [i]
        while open_:
            new = near[open_.pop()] - seen
            seen |= new
            open_ += new
        want.append((i, min(seen)))
    cuts = []
    cut = density.cut
    monkeypatch.setattr(density, "cut", lambda df: cuts.append(df) or cut(df))
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    assert found(connected_components(edges)) == sorted(want)
    few = len(cuts)
    assert few <= 4
    for small in (0, 60):
        cuts.clear()
        assert found(connected_components(edges, small=small)) == sorted(want)
        assert len(cuts) > few
    names = edges.selectExpr("concat('n', a) AS a", "concat('n', b) AS b")
    first = {}
    for i, c in want:
        first[c] = min(first.get(c, f"n{i}"), f"n{i}")
    assert found(connected_components(names)) == sorted((f"n{i}", first[c]) for i, c in want)


def test_bits_of_distinct_sets_are_computed_once(spark):
    from pyspark.sql import functions as F

    from poolscout.functions.fingerprint import fingerprint

    texts = spark.createDataFrame([(5, "a b c"), (3, "c b a"), (4, "d"), (1, "  "), (2, None)], "id long, text string")
    sets = distinct_sets(texts.select("id", fingerprint(F.col("text"), "rdkit", 0, 2048).alias("bits")))
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["id"], len(r["bits"]), r["members"]) for r in sets.collect()) == [(3, 3, 2), (4, 1, 1)]
