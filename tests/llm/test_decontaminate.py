from collections import Counter

import numpy as np
import pytest

from poolscout.llm import decontaminate as dc

from .helpers import edge_documents, edge_rows, lower, no_documents, prose, words


def counted(w):
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def by_hand(docs, items):
    """Per document the number of items that some window of their size matches, and the best (similarity, -item, start)."""
    out = {}
    for i, text in docs:
        w, found = words(lower(text)), {}
        for item, t in items:
            v = words(lower(t))
            if not v or not w:
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = counted(w[s : s + len(v)]), counted(v)
                both, union = sum((a & b).values()), sum((a | b).values())
                if 100 * both >= 75 * union:
                    found[item] = max(found.get(item, (0, 0)), (both / union, -s))
        best = max(((x, -i, -s) for i, (x, s) in found.items()), default=None)
        out[i] = (len(found), best and round(best[0], 9), best and -best[1])
    return out


def result(frame):
    return {r["doc_id"]: (r["n_items"], r["similarity"] and round(r["similarity"], 9), r["item_id"]) for r in frame.collect()}


ALL = dc.Decontamination(radius=63)


def planted():
    items = [(1, prose(1, 30)), (2, prose(2, 18)), (3, prose(3, 60)), (4, "Two words"), (5, ""), (6, None), (7, prose(1, 30)), (8, "rep " * 20)]
    base = prose(3, 60).split(" ")
    docs = [
        (1, prose(10, 50) + " " + prose(1, 30).upper() + " " + prose(11, 5)),
        (2, prose(2, 18)),
        (3, " ".join(prose(2, 18).split(" ")[:16])),
        (4, " ".join([*prose(12, 40).split(" "), *base[:30], "odd", *base[31:], *prose(13, 9).split(" ")])),
        (5, " ".join([*base[:20], "a", "b", "c", *base[20:]])),
        (6, " ".join(base[:30])),
        (7, prose(14, 500)),
        (8, "some two words here"),
        (9, "two"),
        (10, None),
        (11, "rep " * 40),
        (12, " ".join(base[:25] + base[26:])),
    ]
    return docs, items


def frames(spark):
    docs, items = planted()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("block", [20_000, 2])
def test_equals_brute_force_over_all_windows(spark, block):
    docs, benchmark, d, i = frames(spark)
    want = by_hand(d, i)
    got = result(dc.contamination(docs, benchmark, dc.Decontamination(radius=63, items=block)))
    if block == 2:  # a tie between items of different blocks goes to the smaller id as well
        assert got == want
    assert got == want
    assert want[1][0] == 2 and want[2][0] == want[4][0] == 1 and want[7][0] == want[6][0] == 0


def test_the_radius_loses_none_of_these(spark):
    docs, benchmark, d, i = frames(spark)
    assert result(dc.contamination(docs, benchmark)) == by_hand(d, i)


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = dc.contamination(docs, benchmark).collect()
    texts = {r["doc_id"]: lower(r["text"]) for r in docs.collect()}
    items = [lower(r["text"]) for r in benchmark.collect()]
    inside = {i for i, t in texts.items() if any(x in t for x in items)}
    found = {r["doc_id"] for r in got if r["contaminated"]}
    assert len(got) == len(texts) and inside <= found and len(found) < 0.1 * len(texts)


def test_edge_rows(spark):
    rows = edge_rows()
    benchmark = spark.createDataFrame([(1, rows[0][1]), (2, prose(1, 120)), (None, "x"), (3, "one two three")], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = dc.contamination(edge_documents(spark), benchmark).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"] for r in got if r["contaminated"]}
    assert found == {None, 10, 11, 12, 7, 20, 21, 33, 34}


def test_empty_tables(spark):
    docs, benchmark, _, _ = frames(spark)
    assert not any(r["contaminated"] for r in dc.contamination(docs, benchmark.limit(0)).collect())
    assert dc.contamination(no_documents(spark), benchmark).collect() == []


def flipped(rng, prints, bits):
    """The fingerprints with some bits flipped."""
    out = prints.copy()
    for row in out:
        for bit in rng.choice(dc.BITS, bits, replace=False).tolist():
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return out


@pytest.mark.parametrize("radius", [0, 3, 10, 20, 32])
def test_the_index_gives_every_fingerprint_within_the_radius(radius):
    rng = np.random.default_rng(4)
    index = dc.Index(list(range(200)), [prose(s, 12 + s % 3) for s in range(200)], dc.Decontamination(radius=radius))
    near = flipped(rng, index.prints[rng.integers(0, 200, 60)], radius)
    sizes = rng.integers(12, 15, 60)
    window, item = index.near(near, sizes)
    far = dc.distances(near[:, None], index.prints[None]) <= radius
    want = {(w, i) for w, i in zip(*np.nonzero(far & (sizes[:, None] == index.words[None])))}
    assert want and set(zip(window.tolist(), item.tolist())) == want


def test_radii_of_the_blocks_cover_the_radius():
    for radius in (0, 3, 10, 32, 40):
        for blocks in (1, 4, 7):
            made = dc.blocks_of(radius, blocks)
            assert sum(w for _, w, _ in made) == dc.BITS and sum(r + 1 for _, _, r in made) == radius + 1


def test_a_look_up_returns_a_small_share_of_the_items():
    index = dc.Index(list(range(1000)), [prose(s, 40) for s in range(1000)], dc.Decontamination())
    prints = np.random.default_rng(5).integers(0, 2**64, (40, 2), dtype=np.uint64)
    window, _ = index.looked_up(prints, np.full(40, 40))
    assert len(window) < 0.1 * 40 * 1000


def test_prints_of_overlapping_runs():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 2**64, 300, dtype=np.uint64)
    start, count = rng.integers(0, 200, 40), rng.integers(1, 90, 40)
    want = [dc.fingerprints(hashes[a : a + n], np.array([0, n]))[0].tolist() for a, n in zip(start, count)]
    assert dc.run_prints(hashes, start, count).tolist() == want


def test_fingerprints_weigh_by_count():
    hashes = np.array([1, 1, 1, 2], dtype=np.uint64)
    several, single = dc.fingerprints(hashes, np.array([0, 4])), dc.fingerprints(hashes[:1], np.array([0, 1]))
    assert several[0].tolist() == single[0].tolist()


def near_items(spark, radius, words, cut):
    """Share of items found that stand in a text with their first words altered, where one window reaches the threshold just so."""
    items = [(i, prose(10_000 + i, words)) for i in range(3000)]
    docs = [(i, " ".join([*prose(50_000 + i, cut + 5).split(" "), *t.split(" ")[cut:]])) for i, t in items]
    benchmark, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: [(m["item_id"], m["similarity"]) for m in r["matches"]] for r in dc.find_matches(frame, benchmark, dc.Decontamination(radius=radius)).collect()}
    # of two short words drawn by chance some are equal, so a few pairs lie above the threshold
    exact = {i: found[i] for i, _ in docs if found[i] in ([], [(i, 0.75)])}
    assert len(exact) > 0.99 * len(docs)
    return sum(len(x) for x in exact.values()) / len(exact)


def test_recall_at_the_threshold(spark):
    """Six of eight shingles, and 48 of 64: the least similarity that counts. Fingerprints decide: a small radius finds few."""
    shares = [near_items(spark, 32, 11, 1), near_items(spark, 32, 60, 8)]
    print("found at the threshold", shares)
    assert min(shares) > 0.98
    assert near_items(spark, 3, 60, 8) < 0.1
