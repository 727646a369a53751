"""Fixed-length bit fingerprints of strings, built from their tokens.

Every kind returns the sorted positions of the set bits, or NULL for a string without tokens. Token fingerprints run as vectorised
functions on Arrow batches: a token is hashed once per batch, and its features are array arithmetic over all texts of the batch
at once. The same with Spark's array functions takes about twenty times the CPU time, as these interpret their lambdas per element.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[^ \t\n\r]+"
HASH_MODULUS = 2_147_483_647
HASH_FACTOR = 131_071
#: Characters of text that are looked at together.
CHUNK_CHARS = 500_000

_token = re.compile(TOKEN.encode())


def has_tokens(text: Column) -> Column:
    """Whether a string gets a fingerprint. Filter by this rather than by the fingerprint: a filter on a computed
    column moves below it and computes it a second time."""
    return F.coalesce(text.rlike(TOKEN), F.lit(False))


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return (a * HASH_FACTOR + b) % HASH_MODULUS


def _tokens(text: str) -> list[bytes]:
    """The tokens in UTF-8. Splitting is faster than the pattern, but ends tokens at two more characters, which few texts have."""
    data = text.encode()
    return _token.findall(data) if b"\x0b" in data or b"\x0c" in data else data.split()


def _token_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """28-bit hashes of all tokens in text order, and where each text begins."""
    lists = [_tokens(t) if t else [] for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    codes, names = pd.factorize(np.array(list(chain.from_iterable(lists)), dtype=object))
    digests = b"".join([hashlib.md5(n).digest() for n in names])
    table = (np.frombuffer(digests, dtype=">u4")[::4] >> 4).astype(np.int64)
    return table[codes] if len(codes) else np.empty(0, np.int64), bounds


def _features(h: np.ndarray, bounds: np.ndarray, kind: str, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of all texts, repeats included, and the text of each.

    ``morgan``: each token with its neighbours up to 0, 1, ... ``radius`` away; 0 stands in beyond the ends. ``pair``: tokens
    1 ... 1 + ``radius`` apart. ``rdkit``: runs of 1 ... 1 + ``radius`` tokens.
    """
    n = len(h)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def ahead(distance: int) -> np.ndarray:
        """Positions whose text goes on for that many tokens."""
        at = np.arange(n - distance) if distance < n else np.empty(0, np.int64)
        return at[owner[at] == owner[at + distance]]

    values, owners = [], []
    if kind == "pair":
        for distance in range(1, radius + 2):
            at = ahead(distance)
            values.append(_mix(_mix(h[at], h[at + distance]), distance))
            owners.append(owner[at])
    else:
        level = h.copy()
        values, owners = [h], [owner]
        for r in range(1, radius + 1):
            at = ahead(r)
            if kind == "morgan":
                left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
                left[at + r], right[at] = h[at], h[at + r]
                level = _mix(_mix(level, left), right)
                values.append(level)
                owners.append(owner)
            else:
                level[at] = _mix(level[at], h[at + r])
                values.append(level[at])
                owners.append(owner[at])
    return np.concatenate(values), np.concatenate(owners)


def _chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch; only those of one chunk are Python strings at a time."""
    ends, start = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64)), 0
    while start < len(texts):
        stop = min(len(texts), int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_CHARS)) + 1)
        yield texts.slice(start, stop - start).to_pylist()
        start = stop


def _distinct_by_text(values: np.ndarray, owners: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct values (below ``size``) and its bounds."""
    found = np.unique(owners * size + values)
    return found % size, np.searchsorted(found, np.arange(texts + 1) * size)


def _rows(values: np.ndarray, bounds: np.ndarray, present: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values), mask=pa.array(~present))


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def _signatures(texts: list[str | None], kind: str, radius: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima of each text's feature hashes under ``length`` affine hashes, and which texts have any."""
    h, bounds = _token_hashes(texts)
    values, at = _distinct_by_text(*_features(h, bounds, kind, radius), len(texts), HASH_MODULUS + 1)
    out, full = np.zeros((len(texts), length), np.int64), np.flatnonzero(np.diff(at) > 0)
    if len(full):
        for i in range(1, length + 1):
            hashed = (values * (i * 48271 % HASH_MODULUS) + i * 69621 % HASH_MODULUS) % HASH_MODULUS
            out[full, i - 1] = np.minimum.reduceat(hashed, at[:-1][full])
    return out, np.diff(at) > 0


def minhash_signature(text: Column, kind: str = "morgan", radius: int = 2, length: int = 128) -> Column:
    """``length`` minima under different affine hashes; NULL without features."""

    @F.arrow_udf("array<bigint>")
    def sign(texts: pa.Array) -> pa.Array:
        out = []
        for some in _chunks(texts):
            minima, full = _signatures(some, kind, radius, length)
            out.append(_rows(minima.ravel(), np.arange(len(some) + 1) * length, full))
        return _joined(out, pa.int64())

    return sign(text)


def key_bits(text: Column, keys: Sequence[str]) -> Column:
    """One bit per pattern that occurs in the string."""
    hits = [F.when(text.rlike(pattern), F.lit(i)) for i, pattern in enumerate(keys)]
    return F.when(F.length(F.trim(text)) > 0, F.array_compact(F.array(*hits)))


def fingerprint(
    text: Column, kind: str = "pair", radius: int = 2, length: int = 2048, keys: Sequence[str] | None = None
) -> Column:
    """Bit positions of a string for a fingerprint kind: pair, morgan, rdkit, maccs (needs ``keys``) or map4."""
    if kind == "maccs":
        if keys is None:
            raise ValueError("maccs needs its list of key patterns")
        return key_bits(text, keys)
    if kind not in ("pair", "morgan", "rdkit", "map4"):
        raise ValueError(f"unknown fingerprint {kind!r}")

    @F.arrow_udf("array<int>")
    def bits(texts: pa.Array) -> pa.Array:
        out = []
        for some in _chunks(texts):
            if kind == "map4":
                minima, full = _signatures(some, "morgan", radius, length)
                values, owners = minima[full].ravel(), np.repeat(np.flatnonzero(full), length)
            else:
                h, bounds = _token_hashes(some)
                values, owners = _features(h, bounds, kind, radius)
                full = np.diff(bounds) > 0
            found, at = _distinct_by_text(values % length, owners, len(some), length)
            out.append(_rows(found.astype(np.int32), at, full))
        return _joined(out, pa.int32())

    return bits(text)


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over all bits of two position arrays."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def dense_bits(bits: Column, length: int) -> Column:
    """0/1 array of a fixed length, for models that want vectors."""

    @F.arrow_udf("array<float>")
    def scatter(positions: pa.Array) -> pa.Array:
        out = np.zeros((len(positions), length), dtype=np.float32)
        sizes = pc.fill_null(pc.list_value_length(positions), 0).to_numpy()
        out[np.repeat(np.arange(len(positions)), sizes), positions.flatten().to_numpy()] = 1.0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(positions) + 1) * length, pa.int32()), pa.array(out.ravel()))

    return scatter(bits)
