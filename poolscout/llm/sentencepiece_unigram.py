"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The model file is only read, by the driver, and its pieces go to the tasks as a few arrays. A space is written as the whitespace
marker and a text gets one before it; characters without a piece fall back to byte pieces. As no piece has a marker behind
another character, texts fall apart into units (markers and what follows them) that can be encoded one by one; every distinct
unit of a slice is encoded once, and all of them together position by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import map_slices
from .suffix_dedup import _stretches, equal_stretches

#: Default model file of this machine; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: How far an unknown character's score lies below that of the worst piece.
UNKNOWN_PENALTY = 10.0
SPACE = 0x20
#: Bytes of distinct units that are encoded together.
CHUNK_BYTES = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes (a space for each marker), their log scores, byte pieces, and the trie in ``base``, ``check``, ``value``."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray  # one more than the pieces: that of an unknown character
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int


def build_trie(entries: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double-array trie: from state s by byte c to ``base[s] + c + 1``, which is its child if ``check`` there is s."""
    entries = sorted(entries)
    size = 1 << 12
    base, check, value = (np.full(size, fill, dtype=np.int32) for fill in (0, -1, -1))
    used = np.zeros(size, dtype=bool)
    used[0] = True
    free, wide, step = 1, 0, 2048
    todo = [(0, 0, len(entries), 0)]  # state, range of entries, depth
    while todo:
        state, start, stop, depth = todo.pop()
        while start < stop and len(entries[start][0]) == depth:
            value[state] = entries[start][1]
            start += 1
        if start == stop:
            continue
        children, at = [], start
        while at < stop:
            byte, begin = entries[at][0][depth], at
            while at < stop and entries[at][0][depth] == byte:
                at += 1
            children.append((byte, begin, at))
        codes = np.array([c[0] + 1 for c in children])
        # one child fills the first hole; more are looked for from where the last such place was found
        start_at = free if len(codes) == 1 else max(free, wide)
        place = max(0, start_at - int(codes[0]))
        while True:
            while place + step + 300 > len(used):
                more = len(used)
                base, check, value = (np.concatenate((x, np.full(more, fill, dtype=np.int32))) for x, fill in ((base, 0), (check, -1), (value, -1)))
                used = np.concatenate((used, np.zeros(more, dtype=bool)))
            taken = used[place + codes[0] : place + codes[0] + step].copy()
            for code in codes[1:]:
                taken |= used[place + code : place + code + step]
            found = int(taken.argmin())
            if not taken[found]:
                place += found
                break
            place += step
        if len(codes) > 1:
            wide = max(wide, place - step)
        base[state] = place
        used[place + codes] = True
        check[place + codes] = state
        while used[free]:
            free += 1
        for byte, begin, end in reversed(children):
            todo.append((place + byte + 1, begin, end, depth + 1))
    return base, check, value


def vocabulary(pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], ranked: bool) -> Vocabulary:
    """``ranked``: the scores are merge ranks, not log probabilities; the piece of rank r gets that of Zipf's law, -log(r + 1)
    less the log of the harmonic sum."""
    data = [p.encode().replace(MARKER.encode(), b" ") for p in pieces]
    plain = [i for i in range(len(pieces)) if i not in special and data[i]]
    logs = np.full(len(pieces) + 1, -np.inf)
    if ranked:
        order = sorted(plain, key=lambda i: (-scores[i], i))
        total = np.log(np.sum(1 / np.arange(1, len(order) + 1)))
        for rank, i in enumerate(order):
            logs[i] = -np.log(rank + 1) - total
    else:
        logs[plain] = np.array(scores, dtype=float)[plain]
    for i in plain:
        if b" " in data[i].lstrip(b" "):
            raise ValueError(f"a marker inside the piece {pieces[i]!r}: units can't be encoded one by one")
    logs[-1] = (logs[plain].min() if plain else 0.0) - UNKNOWN_PENALTY
    bytes_ = np.array([byte_ids.get(b, -1) for b in range(256)], dtype=np.int32)
    if (bytes_ < 0).any():
        raise ValueError("the model has no piece for every byte")
    trie = build_trie([(data[i], i) for i in plain])
    shown = tuple(b"" if i in special else data[i] for i in range(len(pieces)))
    return Vocabulary(shown, logs, bytes_, *trie, max((len(data[i]) for i in plain), default=1))


def load(path: str = MODEL, ranked: bool = True) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
    special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    return vocabulary(pieces, [model.get_score(i) for i in range(n)], byte_ids, special, ranked)


def best_paths(data: np.ndarray, begin: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the best segmentation of each unit, one unit after another, and their bounds.

    Of equally good paths to a position the one with the longer last piece wins.
    """
    n = len(data)
    unit = np.repeat(np.arange(len(size)), size)
    stop = (begin + size)[unit]
    whole = (data & 0xC0) != 0x80
    width = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
    unknown = len(vocab.pieces)
    # piece[k - 1, e]: the piece of k bytes that ends behind byte e
    piece = np.full((max(vocab.longest, 4), n), -1, dtype=np.int32)
    at = np.flatnonzero(whole)
    state = np.zeros(len(at), dtype=np.int64)
    single = np.zeros(n, dtype=bool)
    for k in range(1, vocab.longest + 1):
        inside = at + k <= stop[at]
        at, state = at[inside], state[inside]
        target = vocab.base[state].astype(np.int64) + data[at + k - 1] + 1
        target[target >= len(vocab.check)] = 0
        good = vocab.check[target] == state
        at, state = at[good], target[good]
        if not len(at):
            break
        ids = vocab.value[state]
        ends = ids >= 0
        piece[k - 1, at[ends] + k - 1] = ids[ends]
        single[at[ends & (width[at] == k)]] = True
    lone = np.flatnonzero(whole & ~single)
    piece[width[lone] - 1, np.minimum(lone + width[lone], n) - 1] = unknown

    order = np.argsort(-size, kind="stable")
    starts = begin[order]
    live = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1 if len(size) else 1), side="right")
    best = np.full(n, -np.inf)
    back = np.zeros(n, dtype=np.int32)
    tokens = np.zeros(n, dtype=np.int64)
    scores = np.append(vocab.scores, -np.inf)  # index -1: no piece
    for p in range(1, len(live) + 1):
        at = starts[: live[p - 1]] + p - 1
        top, length = np.full(len(at), -np.inf), np.zeros(len(at), dtype=np.int32)
        for k in range(min(p, len(piece)), 0, -1):
            score = scores[piece[k - 1, at]]
            if k < p:
                score = best[at - k] + score
            better = score > top
            top[better], length[better] = score[better], k
        best[at], back[at] = top, length
        # bytes inside a character are on no path
        on = length > 0
        at, length = at[on], length[on]
        ids = piece[length - 1, at]
        tokens[at] = np.where(ids == unknown, length, 1) + np.where(length < p, tokens[np.maximum(at - length, 0)], 0)
    last = begin + size - 1
    counts = tokens[last] if len(size) else np.empty(0, np.int64)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(bounds[-1]), dtype=np.int32)
    slot = bounds[1:] - 1
    at = last.copy()
    active = np.arange(len(size))
    while len(active):
        here = at[active]
        length = back[here]
        ids = piece[length - 1, here]
        known = ids != unknown
        out[slot[active[known]]] = ids[known]
        slot[active[known]] -= 1
        for back_by in range(4):  # the bytes of unknown characters, last one first
            some = active[~known][length[~known] > back_by]
            if len(some):
                out[slot[some]] = vocab.byte_ids[data[at[some] - back_by]]
                slot[some] -= 1
        at[active] -= length
        active = active[at[active] >= begin[active]]
    return out, bounds


def encode_column(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts and their bounds; an empty or null text has no tokens."""
    raw, offsets = tk.text_bytes(column)
    if len(raw) == 0:
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
    # one space before every text that is not empty; a literal marker is a space as well
    sizes = np.diff(offsets)
    marks = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.empty(0, np.int64)
    # three bytes in a row can't stretch over two texts, as each text is whole UTF-8
    full = np.flatnonzero(sizes > 0)
    lead = offsets[:-1][full]
    data = np.insert(raw, lead, SPACE)
    where = marks + np.searchsorted(lead, marks, side="right")
    if len(marks):
        data[where] = SPACE
        gone = np.concatenate((where + 1, where + 2))
        data = np.delete(data, gone)
        text_of = np.searchsorted(offsets, marks, side="right") - 1
        sizes = sizes - 2 * np.bincount(text_of, minlength=len(sizes))
    sizes = sizes + (sizes > 0)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    space = data == SPACE
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[bounds[:-1][sizes > 0]] = True
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(data)))
    same, first = equal_stretches(data, begin, size)
    own = size[first]
    # some distinct units at a time, so that the table of pieces stays small
    chunk = np.cumsum(own) // CHUNK_BYTES
    found = []
    for some in np.split(first, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1):
        long = size[some]
        found.append(best_paths(data[_stretches(begin[some], long)], np.concatenate(([0], np.cumsum(long)[:-1])), long, vocab))
    ids = np.concatenate([x for x, _ in found])
    ends = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(e) for _, e in found]))))
    counts = np.diff(ends)[same]
    tokens = ids[_stretches(ends[:-1][same], counts)]
    total = np.concatenate(([0], np.cumsum(counts)))
    return tokens, total[np.searchsorted(begin, bounds)]


def decode_bytes(ids: np.ndarray, bounds: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts: pieces with spaces for markers, less the space before the text; control pieces are nothing."""
    table = list(vocab.pieces)
    for byte, i in enumerate(vocab.byte_ids.tolist()):
        table[i] = bytes([byte])
    sizes = np.array([len(p) for p in table])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat = np.frombuffer(b"".join(table), dtype=np.uint8)
    many = sizes[ids]
    data = flat[_stretches(begins[ids], many)]
    total = np.concatenate(([0], np.cumsum(many)))[bounds]
    full = total[1:] > total[:-1]
    lead = total[:-1][full]
    lead = lead[data[lead] == SPACE] if len(lead) else lead
    strip = np.zeros(len(total) - 1, dtype=np.int64)
    np.add.at(strip, np.searchsorted(total, lead, side="right") - 1, 1)
    return np.delete(data, lead), np.concatenate(([0], np.cumsum(np.diff(total) - strip)))


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """``(doc_id, text, ids[, restored])`` of every row, in one pass without a shuffle; null texts are empty and have no tokens.

    With ``check`` the tokens of every text are decoded in the same pass, and ``restored`` says that this gives the text back,
    where a literal whitespace marker counts as a space.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # as large as the model file

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = encode_column(batch.column(1), shared.value)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        columns, names = [batch.column(0), batch.column(1), lists], ["doc_id", "text", "ids"]
        if check:
            data, ends = decode_bytes(ids.astype(np.int64), bounds, shared.value)
            raw, starts = tk.text_bytes(batch.column(1))
            want, got, space = memoryview(raw.tobytes()), memoryview(data.tobytes()), MARKER.encode()
            same = [bytes(want[a:b]).replace(space, b" ") == got[c:d] for a, b, c, d in zip(starts[:-1].tolist(), starts[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist())]
            columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "restored"]
        return pa.record_batch(columns, names=names)

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    return map_slices(rows, step, "doc_id long, text string, ids array<int>" + ", restored boolean" * check)


def decode(tokens: DataFrame, vocab: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with a column ``decoded`` instead of the ids; bytes that are no UTF-8 become U+FFFD. Ids outside the vocabulary
    are an error, null ids an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocab)
    others = [c for c in tokens.columns if c not in (ids_col, "decoded")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column(len(others))
                counts = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
                flat = np.asarray(lists.flatten(), dtype=np.int64)
                if len(flat) and not 0 <= flat.min() <= flat.max() < len(shared.value.pieces):
                    raise ValueError("an id is not in the vocabulary")
                data, bounds = decode_bytes(flat, np.concatenate(([0], np.cumsum(counts))), shared.value)
                view = data.tobytes()
                texts = [view[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.record_batch([*(part.column(i) for i in range(len(others))), pa.array(texts, pa.string())], names=[*others, "decoded"])

    rows = tokens.select(*others, ids_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema.fields)
    return rows.mapInArrow(run, f"{fields}, decoded string")


def byte_tokens(vocab: Vocabulary) -> Column:
    """How many of the ``ids`` are byte pieces."""
    low, high = int(vocab.byte_ids.min()), int(vocab.byte_ids.max())
    if high - low != 255:
        raise ValueError("byte pieces do not stand together")
    return F.size(F.filter("ids", lambda i: i.between(low, high))).cast("long")
