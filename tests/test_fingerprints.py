"""Fingerprints against a plain Python reading of their definition, and similarity against brute force."""

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolscout.functions import fingerprint as fp
from poolscout.operators import similarity

TEXTS = ["a b c d e f a b", "one", "", "  ", None, "x\ty\nz", "a b", "é ü é"]


def mix(a, b):
    return (a * fp.HASH_FACTOR + b) % fp.HASH_MODULUS


def features(text, kind, radius):
    h = [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) for t in text.split()]
    n, out = len(h), []
    at = lambda i: h[i] if 0 <= i < n else 0
    for i in range(n):
        if kind == "morgan":
            x = h[i]
            out.append(x)
            for r in range(1, radius + 1):
                x = mix(mix(x, at(i - r)), at(i + r))
                out.append(x)
        elif kind == "pair":
            out += [mix(mix(h[i], h[i + d]), d) for d in range(1, radius + 2) if i + d < n]
        else:
            x = h[i]
            out.append(x)
            for r in range(1, radius + 1):
                if i + r < n:
                    x = mix(x, h[i + r])
                    out.append(x)
    return out


@pytest.mark.parametrize("kind", ["morgan", "pair", "rdkit"])
@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("length", [512, 2048])
def test_bits(spark, kind, radius, length):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    got = rows.select("t", fp.fingerprint(F.col("t"), kind, radius, length).alias("b")).collect()
    for r in got:
        if r["t"] is None or not r["t"].split():
            assert r["b"] is None
        else:
            assert r["b"] == sorted({x % length for x in features(r["t"], kind, radius)})


def test_long_text_is_read_to_its_end(spark):
    base = " ".join(f"w{i}" for i in range(20_000))
    rows = spark.createDataFrame([(base + " last",), (base + " other",)], "t STRING")
    a, b = [r["b"] for r in rows.select(fp.fingerprint(F.col("t"), "rdkit", 1, 1 << 24).alias("b")).collect()]
    assert len(set(a) ^ set(b)) == 4


def test_keys_and_dense(spark):
    keys = [f"k{i:03d}" for i in range(167)]
    rows = spark.createDataFrame([("k000 k166",), ("nothing",), ("",)], "t STRING")
    got = rows.select(fp.fingerprint(F.col("t"), "maccs", keys=keys).alias("b")).collect()
    assert [r["b"] for r in got] == [[0, 166], [], None]
    dense = rows.select(fp.dense_bits(fp.fingerprint(F.col("t"), "maccs", keys=keys), 167).alias("d")).collect()
    assert [len(r["d"]) for r in dense] == [167] * 3 and sum(dense[0]["d"]) == 2.0


def test_minhash_estimates_similarity(spark):
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"w{i}" for i in range(100, 400))
    rows = spark.createDataFrame([(a,), (b,)], "t STRING")
    s = [r["s"] for r in rows.select(fp.minhash_signature(F.col("t"), "rdkit", 0, 256).alias("s")).collect()]
    share = np.mean(np.array(s[0]) == np.array(s[1]))
    assert abs(share - 0.5) < 0.12
    bits = rows.select(fp.fingerprint(F.col("t"), "map4", 1, 64).alias("b")).first()["b"]
    assert bits == sorted(set(bits)) and max(bits) < 64


def test_unknown_kind():
    with pytest.raises(ValueError):
        fp.fingerprint(F.lit("x"), "none")
    with pytest.raises(ValueError):
        fp.fingerprint(F.lit("x"), "maccs")


def jaccard(a, b):
    return len(a & b) / len(a | b)


def one_by_one(bits, max_distance):
    leaders = []
    for i in sorted(bits):
        if all(1 - jaccard(bits[i], bits[j]) > max_distance + 1e-12 for j in leaders):
            leaders.append(i)
    return leaders


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    bits = {i: set(rng.choice(40, rng.integers(3, 9), replace=False).tolist()) for i in range(240)}
    for i in range(0, 240, 3):
        bits[i] = {1, 2, 3, 4}
    frame = pd.DataFrame({"id": list(bits), "bits": [sorted(b) for b in bits.values()]})
    return bits, spark.createDataFrame(frame, "id long, bits array<int>").repartition(5).cache()


@pytest.mark.parametrize("block", [1000, 17])
@pytest.mark.parametrize("max_distance", [0.65, 0.3])
def test_leaders_equal_the_sequential_pass(items, block, max_distance):
    bits, frame = items
    got = sorted(r["id"] for r in similarity.pick_leaders(frame, 40, max_distance, block=block).collect())
    assert got == one_by_one(bits, max_distance)


def test_leader_count_can_be_limited(items):
    bits, frame = items
    got = sorted(r["id"] for r in similarity.pick_leaders(frame, 40, 0.3, max_picks=25, block=17).collect())
    assert got == one_by_one(bits, 0.3)[:25]


@pytest.mark.parametrize("block", [1000, 7])
def test_assignment_and_neighbours(items, block):
    bits, frame = items
    leaders = similarity.pick_leaders(frame, 40, 0.3)
    ids = one_by_one(bits, 0.3)
    got = {r["id"]: r["leader"] for r in similarity.assign_to_leaders(frame, leaders, 40, block).collect()}
    want = {i: i if i in ids else max(ids, key=lambda j: (jaccard(bits[i], bits[j]), -j)) for i in bits}
    assert got == want
    near = {(r["leader"], r["id"]) for r in similarity.within_distance(frame, leaders, 40, 0.5, block).collect()}
    assert near == {(j, i) for j in ids for i in bits if jaccard(bits[i], bits[j]) >= 0.5}


def test_classes(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (6, 4)], "id INT, leader INT")
    got = {r["id"]: r["class"] for r in similarity.cluster_classes(rows).collect()}
    assert got == {1: "singleton", 2: "mid", 3: "mid", 4: "large", 5: "large", 6: "large"}


def test_a_batch_is_read_in_chunks_of_bounded_text(monkeypatch):
    texts = ["a b " * 50, None, "", "c d e " * 100, "x", None, "y z " * 70, "w"]
    monkeypatch.setattr(fp, "CHUNK_CHARS", 250)
    some = list(fp._chunks(pa.array(["left out", *texts]).slice(1)))
    assert sum(some, []) == texts and len(some) > 1
    assert all(sum(len(t or "") for t in part[:-1]) < 250 for part in some)
    assert list(fp._chunks(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("kind", ["morgan", "pair", "rdkit", "map4"])
def test_chunks_of_a_batch_make_no_difference(kind):
    texts = [" ".join(f"w{(i * j) % 40}" for j in range(i % 60)) or None for i in range(200)]
    length = 64
    rows = []
    for part in ([texts], [[t] for t in texts]):
        out = []
        for some in part:
            if kind == "map4":
                minima, full = fp._signatures(some, "morgan", 2, length)
                values, owners = minima[full].ravel() % length, np.repeat(np.flatnonzero(full), length)
            else:
                h, bounds = fp._token_hashes(some)
                values, owners = fp._features(h, bounds, kind, 2)
                values, full = values % length, np.diff(bounds) > 0
            out.append(fp._rows(*fp._distinct_by_text(values, owners, len(some), length), full))
        rows.append(fp._joined(out, pa.int64()).to_pylist())
    assert rows[0] == rows[1] and [r is None for r in rows[0]] == [t is None for t in texts]


def test_tokens_end_at_four_characters_only():
    texts = ["a\x0bb c", "x\x0cy\tz", "  a b\x85c \x1c d\u2003e\xa0f", "", None, " \r\n ", "\u00e9\0 q\rq"]
    got, bounds = fp._token_hashes(texts)
    want = [[int(hashlib.md5(t.encode()).hexdigest()[:7], 16) for t in re.findall(fp.TOKEN, x or "")] for x in texts]
    assert [got[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
