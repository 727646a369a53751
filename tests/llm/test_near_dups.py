import math
import random

import numpy as np
import pyarrow as pa
import pytest

from poolscout.llm import near_dups
from poolscout.llm.components import components

from .helpers import SMALL, edge_documents, edge_rows, near_components, no_documents, prose, shingle_set


def check(frame, rows):
    want = near_components(rows)
    sizes = sorted((i, len(shingle_set(t))) for i, t in rows)
    got = frame.collect()
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(near_dups.near_duplicates(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_rows(spark):
    check(near_dups.near_duplicates(edge_documents(spark)), [(r[0], r[1]) for r in edge_rows() if r[0] is not None])


def test_empty_table(spark):
    assert near_dups.near_duplicates(no_documents(spark)).collect() == []


def variants(seed: int, n: int, changed: int) -> list[tuple[int, str]]:
    """Texts around one another, many of them near the threshold, so that stars alone do not link them all."""
    pick, rows, base = random.Random(seed), [], prose(seed, 160).split(" ")
    for i in range(n):
        text = list(base)
        for k in pick.sample(range(len(text)), pick.randint(0, changed)):
            text[k] = f"v{i}x{k}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [2000, 7])
def test_links_that_do_not_touch_a_hub_are_found(spark, block):
    rows = variants(3, 60, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_dups.near_duplicates(docs, near_dups.NearDups(block=block)), rows)


@pytest.mark.parametrize("block", [2000, 3])
def test_every_text_of_a_repeated_id_links(spark, block):
    a, b, c, d = (prose(s, 80) for s in (21, 22, 23, 24))
    near = lambda text, k: " ".join(f"n{k}" if i == 7 * k else w for i, w in enumerate(text.split(" ")))
    rows = [(7, a), (7, b), (9, near(b, 1)), (5, near(a, 1)), (20, c), (20, None), (20, d), (21, near(d, 2)), (22, near(c, 1)), (30, None), (30, ""), (31, ""), (40, a + " " + b), (40, near(c, 3))]
    rows += [(50, prose(30, 60)), (50, prose(31, 60)), (51, prose(32, 60)), (52, near(prose(31, 60), 1)), (60, b), (3, d), (3, "")]
    rows += [(100 + i, t) for i, t in variants(41, 12, 9)] + [(101, t) for _, t in variants(43, 6, 9)] + [(120 + i, t) for i, t in variants(43, 9, 9)]
    check(near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dups.NearDups(block=block)), rows)


def test_exactly_the_threshold_is_a_link(spark):
    # 12 shared shingles of 16 together: 0.75; 11 of 15 is below
    text = prose(1, 16).split(" ")
    at, below = text + ["p", "q", "r", "s"], text[:15] + ["p", "q", "r", "s"]
    assert (len(shingle_set(" ".join(text))), len(shingle_set(" ".join(at)))) == (12, 16)
    for other, linked in ((at, True), (below, False)):
        rows = [(1, " ".join(text)), (2, " ".join(other))]
        got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dups.NearDups(bands=128, rows=1)).collect()
        assert ({r["component_id"] for r in got} == {1}) == linked


def test_a_comparison_stops_at_the_chosen_posterior():
    options = near_dups.NearDups()
    for n, m in near_dups.stop_counts(options):
        mass = lambda k: sum(math.comb(n + 1, i) * 0.75**i * 0.25 ** (n + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        assert m < 0 or mass(m) < options.miss
        assert mass(m + 1) >= options.miss


def test_the_sequential_test_keeps_similar_pairs():
    rng = np.random.default_rng(2)
    stops = near_dups.stop_counts(near_dups.NearDups())
    left = rng.integers(0, 2**32, (5000, 128), dtype=np.uint32)
    for similarity, low, high in ((0.8, 1.0, 1.0), (0.3, 0.0, 0.001)):
        right = np.where(rng.random(left.shape) < similarity, left, left + 1)
        every = np.arange(len(left))
        kept = len(near_dups.survivors(left, right.astype(np.uint32), every, every, stops)) / len(left)
        assert low <= kept <= high


def test_signatures_estimate_the_similarity():
    a = prose(1, 400).split(" ")
    texts = [" ".join(a), " ".join(a[:300] + prose(2, 100).split(" "))]
    hashes, bounds = near_dups.shingle_sets(pa.array(texts), 5)
    sets = [shingle_set(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(s) for s in sets]
    sig = near_dups.signatures(hashes, bounds, 2000)
    assert abs((sig[0] == sig[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.04


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 230)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
