"""Vectorised helpers on Arrow string columns: words, hashes of words and windows, content-chosen anchors.

Everything works on a whole Arrow batch at once; no Python code runs per row. Hashes are 64-bit sums modulo 2^64 whose
coefficients come from a mixing function, so they are the same on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64

#: The bytes of ``[\x20\x09-\x0D]``, which separate words.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser of unsigned integers."""
    x = values.astype(_U) + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def odd(seed: int) -> np.uint64:
    return mix(np.array([seed], dtype=_U), 77)[0] | _U(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array and the offsets of the texts in it; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), bounds - bounds[0]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the index of its first word (one longer than the texts)."""
    inside = ~SEPARATORS[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    cut = edges[(edges > 0) & (edges < len(raw))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Longest run whose powers a worker keeps.
_KEPT = 1 << 21
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of a fixed odd base and of its inverse, modulo 2^64."""
    global _powers
    if _powers and len(_powers[0]) >= n:
        return _powers
    base, size, made = int(odd(11)), max(n, min(2 * n, _KEPT)), []
    for factor in (base, pow(base, -1, 2**64)):
        run = np.full(size, factor, dtype=_U)
        run[0] = 1
        made.append(np.multiply.accumulate(run, out=run))
    if size <= _KEPT:
        _powers = made
    return made


def running_sums(units: np.ndarray) -> np.ndarray:
    """Prefix sums of the units times powers of a base; every run of units has its hash in the difference of two of them."""
    sums = np.zeros(len(units) + 1, _U)
    np.cumsum(units * _powers_of(max(1, len(units)))[0][: len(units)], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``starts[i] .. ends[i]``; equal runs have equal hashes wherever they stand."""
    inverse = _powers_of(max(1, len(sums) - 1))[1]
    return mix((sums[ends] - sums[starts]) * inverse[np.minimum(starts, len(inverse) - 1)], 12)


def byte_units(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix(np.arange(256, dtype=_U), seed + 1)[raw]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.empty(0, _U)
    return run_hashes(running_sums(byte_units(raw, seed)), starts, ends)


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, step: int = 1_000_000) -> np.ndarray:
    """Hashes of stretches of bytes whose starts ascend, about ``step`` bytes at a time."""
    out, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(starts, low + step)))
        high = int(ends[at:upto].max())
        sums = running_sums(byte_units(raw[low:high], seed))
        out[at:upto] = run_hashes(sums, starts[at:upto] - low, ends[at:upto] - low)
        at = upto
    return out


def window_hashes(units: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` units from each position on; the last ``length - 1`` positions are left out. Other seeds give
    independent hashes."""
    n = len(units) - length + 1
    if n <= 0:
        return np.empty(0, _U)
    sums = running_sums(mix(units, seed + 12) if seed else units)
    return mix((sums[length:] - sums[:-length]) * _powers_of(len(units))[1][:n], 13)


def gram_hashes(units: np.ndarray, length: int) -> np.ndarray:
    """Like ``window_hashes`` with a lighter mix, for comparing hashes of neighbours."""
    n = len(units) - length + 1
    if n <= 0:
        return np.empty(0, _U)
    sums = running_sums(units)
    x = sums[length:] - sums[:-length]
    x *= _powers_of(len(units))[1][:n]
    x ^= x >> _U(32)
    x *= _U(0x9E3779B97F4A7C15)
    return x


def windows_inside(bounds: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of the positions ``0 .. total - length`` begin a window that stays inside one text."""
    n = max(0, total - length + 1)
    change = np.zeros(n + 1, dtype=np.int64)
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < total)]
    # a window from p crosses a bound b if p < b < p + length
    np.add.at(change, np.clip(inner - length + 1, 0, n), 1)
    np.add.at(change, np.clip(inner, 0, n), -1)
    return np.cumsum(change[:n]) == 0


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` positions a window of the given length from one of the starts covers."""
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, total), -1)
    return np.cumsum(change[:total]) > 0


def count_between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive bounds."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        shift = width - span
        out = np.minimum(out[:-shift], out[shift:])
    return out
