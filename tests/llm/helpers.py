"""Brute force and fixtures for the corpus operators."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 7))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and white texts, very long ones, copies, ties and repeated rows."""
    shared, other = prose(1, 120), prose(2, 300)
    near = other.split(" ")
    near[150] = "changed"
    rows = [
        (10, other, "en", "a", len(other)),
        (11, " ".join(near), "en", "a", None),
        (12, other, "de", "a", len(other)),
        (7, prose(3, 40) + " " + shared + " " + prose(4, 40), "en", "b", 1),
        (20, prose(5, 90) + "\n" + shared + "\n" + prose(6, 10), "fr", "b", 1),
        (21, shared, None, None, None),
        (30, None, "en", "b", 0),
        (31, "", "en", "b", 0),
        (32, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (33, "one two three", "en", "c", 13),
        (34, "one two three", "en", "c", 13),
        (35, "é😀漢字 naïve ▁x ▁▁y", "en", "c", 3),
        (36, "a", None, "c", 1),
        (40, prose(7, 30_000), "en", "d", 1),
        (41, "z" * 60_000, "en", "d", 1),
        (42, "12345 %%% ### 678", "en", "d", 1),
        (43, ("same line again\n") * 60, "en", "d", 1),
        (50, prose(8, 70), "en", "e", 1),
        (50, prose(8, 70), "en", "e", 1),
        (51, prose(9, 70), "en", "e", 1),
        (51, prose(10, 60), "en", "e", 1),
        (60, prose(9, 70) + " more", "en", "e", 1),
        (None, other, "en", "a", 1),
        (None, None, None, None, None),
    ]
    return rows


def edge_documents(spark):
    """The rows above with columns of names that the operators use themselves."""
    frame = spark.createDataFrame(edge_rows(), DOCUMENTS)
    extra = {"fp": "1", "hits": "2", "n": "3", "kept": "'no'", "rep": "4", "label": "5", "fold": "6", "matches": "7", "host": "'h'", "bucket": "8", "score": "9"}
    for name, value in extra.items():
        frame = frame.selectExpr("*", f"{value} AS {name}")
    return frame


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def word_removal(rows: list[tuple], length: int) -> dict:
    """Per row ``(doc_id, text)``: words, removed words and the digest of what stays."""
    first: dict = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def byte_removal(rows: list[tuple], length: int) -> list[tuple]:
    first: dict = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            key = b[k : k + length]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def near_components(rows: list[tuple], percent: int = 75) -> dict[int, int]:
    """The least id that each id reaches, by links of any of its rows."""
    sets: dict[int, set] = {}
    for i, text in rows:
        sets.setdefault(i, set()).add(shingle_set(text))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            for s in sets[i]:
                for t in sets[j]:
                    both = len(s & t)
                    if both and 100 * both >= percent * len(s | t):
                        a, b = find(i), find(j)
                        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
