"""Token ids as directly addressable codes: files from which any token can be read without decoding what stands before it.

An id is split into chunks of bits, lowest first. Level 0 holds the first chunk of every id, level ``k`` the next chunk of the ids that go on, and a
bitmap beside each level but the last marks those. A rank directory counts the marks before each block of 512, so the place of an id's next
chunk is one look into the directory and a count inside one block. The widths of the levels are those of least total size for the ids of the segment.

A file is a sequence of segments, each followed by a line feed. All numbers are little-endian::

    "DAC1", part u32, seq u32, documents u32, levels u8, tokens u64, bytes of the segment u64,
    widths u8 x levels, null ids (a bit each, padded to a byte), ids i64 x documents, ends u64 x documents,
    then per level: chunks (bit fields, padded to a byte) and, but for the last, bitmap u64 words (blocks of 8) and directory u32 x blocks

``part`` and ``seq`` put the segments of a folder in order. A document is never split between segments.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_sums
from . import textkernel as tk
from .common import pieces, saved, slices

MAGIC = b"DAC1"
HEAD = struct.Struct("<4sIIIBQQ")
BLOCK = 512
#: Tokens after which a segment is closed, and segments after which a file is.
SEGMENT_TOKENS = 1 << 20
SEGMENTS_PER_FILE = 16
SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8)
#: Units whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 4_000_000


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths of least total size: a chunk and a mark (with its share of the directory) for every id that reaches a level."""
    if not len(ids):
        return [1]
    lengths = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=33)
    most = max(1, int(np.flatnonzero(lengths)[-1]))
    reach = [len(ids), *(int(lengths[used + 1 :].sum()) for used in range(1, most))]
    mark = 1 + 32 / BLOCK
    cost, choice = [0.0] * (most + 1), [0] * (most + 1)
    for used in reversed(range(most)):
        options = [(reach[used] * (w + (mark if used + w < most else 0)) + cost[used + w], w) for w in range(1, most - used + 1)]
        cost[used], choice[used] = min(options)
    widths, used = [], 0
    while used < most:
        widths.append(choice[used])
        used += choice[used]
    return widths


def _pack_fields(values: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    shifts, out = np.arange(width, dtype=np.uint32), []
    for at in range(0, len(values), 1 << 16):  # a multiple of 8, so every piece ends at a byte
        out.append(np.packbits((values[at : at + (1 << 16), None] >> shifts & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def _fields(data: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    """The bit fields at ``index``; ``data`` has room for five bytes from any field's first."""
    bit = index.astype(np.int64) * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    found = np.zeros(len(index), dtype=np.uint64)
    for k in range((width + 14) // 8):
        found |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (found >> shift & np.uint64((1 << width) - 1)).astype(np.uint32)


def build_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, part: int = 0, seq: int = 0) -> bytes:
    """A segment of documents with ``counts`` tokens each, whose ids stand one after another in ``ids`` (unsigned, 32 bits)."""
    values = ids.astype(np.uint32)
    widths = best_widths(values)
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8), bitorder="little").tobytes()
    body = [bytes(widths), nulls, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.cumsum(counts).astype("<u8").tobytes()]
    for level, width in enumerate(widths):
        body.append(_pack_fields(values & np.uint32((1 << width) - 1), width))
        if level + 1 < len(widths):
            rest = values >> np.uint32(width)
            goes_on = rest > 0
            blocks = -(-len(values) // BLOCK)
            marks = np.packbits(np.pad(goes_on, (0, blocks * BLOCK - len(values))), bitorder="little")
            before = np.cumsum(np.bitwise_count(marks.reshape(blocks, BLOCK // 8)).sum(axis=1)) if blocks else np.empty(0)
            body += [marks.tobytes(), np.concatenate(([0], before[:-1])).astype("<u4").tobytes() if blocks else b""]
            values = rest[goes_on]
    size = HEAD.size + sum(map(len, body))
    return HEAD.pack(MAGIC, part, seq, len(doc_ids), len(widths), len(ids), size) + b"".join(body)


class Segment:
    """A segment in ``buffer`` from ``offset`` on. Nothing is decoded until it is asked for."""

    def __init__(self, buffer, offset: int = 0):
        data = memoryview(buffer)[offset:]
        magic, self.part, self.seq, self.n_docs, levels, self.n_tokens, self.size = HEAD.unpack(data[: HEAD.size])
        if magic != MAGIC or len(data) < self.size:
            raise ValueError("not a whole segment of token codes")
        self._data, self._at = data[: self.size], HEAD.size
        self.widths = self._take("u1", levels).tolist()
        nulls = np.unpackbits(self._take("u1", -(-self.n_docs // 8)), bitorder="little", count=self.n_docs)
        self.doc_ids = [None if null else d for d, null in zip(self._take("<i8", self.n_docs).tolist(), nulls)]
        self.ends = self._take("<u8", self.n_docs).astype(np.int64)
        self._levels, n = [], self.n_tokens
        for level, width in enumerate(self.widths):
            chunks = np.concatenate((self._take("u1", -(-n * width // 8)), np.zeros(8, np.uint8)))
            marks = directory = None
            if level + 1 < len(self.widths):
                blocks = -(-n // BLOCK)
                marks, directory = self._take("<u8", blocks * (BLOCK // 64)), self._take("<u4", blocks).astype(np.int64)
                n = int(directory[-1]) + int(np.bitwise_count(marks[-(BLOCK // 64) :]).sum()) if blocks else 0
            self._levels.append((width, chunks, marks, directory))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, dtype=kind, count=n, offset=self._at)
        self._at += out.nbytes
        return out

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1])) if self.n_docs else self.ends

    def at(self, positions) -> np.ndarray:
        """The ids at these positions of the segment. Each costs a field, a mark and a rank per level, wherever it stands."""
        index = np.asarray(positions, dtype=np.int64)
        if len(index) and not 0 <= index.min() <= index.max() < self.n_tokens:
            raise IndexError("a position is outside the segment")
        out, open_rows, shift = np.zeros(len(index), np.uint32), np.arange(len(index)), 0
        for width, chunks, marks, directory in self._levels:
            out[open_rows] |= _fields(chunks, width, index) << np.uint32(shift)
            shift += width
            if marks is None:
                break
            on = (marks[index >> 6] >> (index & 63).astype(np.uint64) & np.uint64(1)) == 1
            open_rows, index = open_rows[on], _rank(marks, directory, index[on])
        return out

    def tokens(self) -> np.ndarray:
        """All ids."""
        out, rows, shift = np.zeros(self.n_tokens, np.uint32), None, 0
        for width, chunks, marks, _ in self._levels:
            n = self.n_tokens if rows is None else len(rows)
            found = _fields(chunks, width, np.arange(n)) << np.uint32(shift)
            if rows is None:
                out, rows = found, np.arange(n)
            else:
                out[rows] |= found
            shift += width
            if marks is not None:
                rows = rows[np.unpackbits(marks.view(np.uint8), bitorder="little", count=n) == 1]
        return out


def _rank(marks: np.ndarray, directory: np.ndarray, index: np.ndarray) -> np.ndarray:
    """How many marks stand before each position."""
    word = index >> 6
    below = (np.uint64(1) << (index & 63).astype(np.uint64)) - np.uint64(1)
    rank = directory[index // BLOCK] + np.bitwise_count(marks[word] & below)
    first = index // BLOCK * (BLOCK // 64)
    for k in range(BLOCK // 64 - 1):
        inside = first + k < word
        rank[inside] += np.bitwise_count(marks[(first + k)[inside]])
    return rank


# --- encoding ----------------------------------------------------------------------------------------------------------


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of bytes: white space, letters, digits, other printable ones, and those whose units are left whole.
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
CLASS = np.full(256, WHOLE, dtype=np.uint8)
CLASS[33:127] = OTHER
CLASS[SPACES] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A character that is a word by itself; it parts the units of one call.
MARK = "\x01"
#: Units in one string for the library.
JOINED = 256


def word_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and begin of the pieces of texts that can be encoded one by one.

    The tokenizer drops white space and splits words into runs of letters, single digits, runs of other characters, and ``'s 't 're 've 'm 'll 'd`` where an
    apostrophe begins such a run. ASCII words are split like that here and lower-cased; a word that holds another character, or
    ``<|``, the begin of a special token, is one piece and left as it is."""
    kind = CLASS[data]
    word = kind != SPACE
    fresh = np.zeros(len(data), dtype=bool)  # begins of words; a text begins one too
    fresh[1:] = word[1:] & ~word[:-1]
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    fresh[starts] = word[starts]
    first = np.flatnonzero(fresh)
    if not len(first):
        return np.empty(0, np.uint8), np.zeros(1, np.int64), first
    odd = kind == WHOLE
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    odd = np.logical_or.reduceat(odd, first)
    piece = fresh.copy()
    piece[1:] |= word[1:] & word[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    lower = LOWER[data]
    at = np.flatnonzero(piece & (data == 39))
    at = at[at + 1 < len(data)]
    at = at[(kind[at + 1] == LETTER) & ~fresh[at + 1]]
    one = np.isin(lower[at + 1], np.frombuffer(b"stmd", np.uint8))
    room = at + 2 < len(data)
    after = np.minimum(at + 2, len(data) - 1)
    pair = lower[at + 1].astype(np.int64) * 256 + lower[after]
    two = ~one & room & ~fresh[after] & np.isin(pair, [x * 256 + y for x, y in (b"re", b"ve", b"ll")])
    found, length = at[one | two], np.where(one, 2, 3)[one | two]
    piece[found + 1] = False
    stop = found + length
    inside = stop < len(data)
    stop = stop[inside]
    piece[stop[word[stop]]] = True  # the rest of the letters, or what begins there anyway
    whole = np.flatnonzero(odd)
    if len(whole):
        ends = np.append(first, len(data))[whole + 1]
        span = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(span, first[whole], 1)
        np.add.at(span, ends, -1)
        span = np.cumsum(span[:-1], dtype=np.int8) > 0
        piece &= ~span | fresh
        lower = np.where(span, data, lower)
    begin = np.flatnonzero(piece)
    upto = np.concatenate(([0], np.cumsum(word)))
    return lower[word], np.append(upto[begin], upto[-1]), begin


class Encoder:
    """Ids of texts by a word tokenizer of the ``tokenizers`` library that drops white space (``word_bpe_49k.json``): every distinct piece is encoded once and
    its ids kept for the next batch. Runs of ASCII letters need neither the library's normaliser nor its pattern."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(model)
        plain = json.loads(model) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.letters = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.full.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        (self.mark,) = self.full.encode(MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _joined(tokenizer, units: list[str], by: str) -> np.ndarray:
        texts = [by.join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)]
        found = [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found)

    def _new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and count for each, of units that are not known yet."""
        counts = np.zeros(len(units), dtype=np.int64)
        easy = np.array([u.isascii() and u.isalpha() for u in units])
        odd = np.array([MARK in u for u in units])
        flat: list[np.ndarray] = []
        order: list[np.ndarray] = []
        if easy.any():
            at = np.flatnonzero(easy)
            ids = self._joined(self.letters, [units[i] for i in at], " ")
            ends = np.flatnonzero(self.ends_word[ids])
            counts[at] = np.diff(ends, prepend=-1)
            flat, order = [*flat, ids], [*order, at]
        if (rest := ~easy & ~odd).any():
            at = np.flatnonzero(rest)
            for i in range(0, len(at), JOINED):
                ids = self._joined(self.full, [f"{units[k]} {MARK}" for k in at[i : i + JOINED]], " ")
                marks = np.flatnonzero(ids == self.mark)
                counts[at[i : i + JOINED]] = np.diff(marks, prepend=-1) - 1
                flat.append(ids[ids != self.mark])
            order.append(at)
        for k in np.flatnonzero(odd):
            ids = np.array(self.full.encode(units[k], add_special_tokens=False).ids, dtype=np.uint32)
            counts[k] = len(ids)
            flat, order = [*flat, ids], [*order, np.array([k])]
        order = np.concatenate(order)
        begin = np.empty(len(units), dtype=np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(flat), begin, counts

    def _learn(self, units: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        new = [u for u in units if u not in known]
        if new:
            ids, begin, count = self._new(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.begin = np.concatenate((self.begin, begin + len(self.ids)))
            self.count, self.ids = np.concatenate((self.count, count)), np.concatenate((self.ids, ids))
        return np.array([known[u] for u in units], dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and their count per text."""
        data, bounds = tk.text_bytes(texts)
        letters, offsets, begin = word_pieces(data, bounds)
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = pieces(letters, offsets).cast(pa.large_string() if offsets[-1] > 2**31 - 1 else pa.string()).dictionary_encode()
        listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        row = self._learn(pc.binary_join(listed, " ")[0].as_py().split(" "))[np.asarray(coded.indices)]
        many = self.count[row]
        ends = np.concatenate(([0], np.cumsum(many)))
        place = np.arange(ends[-1]) + np.repeat(self.begin[row] - ends[:-1], many)
        return self.ids[place], np.diff(ends[np.searchsorted(begin, bounds)])


_encoders: dict[str, Encoder] = {}


def _encoder(model: str) -> Encoder:
    """One encoder for each worker."""
    key = hashlib.md5(model.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _pieces_of(text: pa.Scalar, size: int) -> Iterator[pa.Array]:
    """A long text in pieces of about ``size`` bytes that end before white space; a longer run without any is a piece."""
    data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
    at = 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data):
            space = np.flatnonzero(np.isin(data[stop : stop + size], SPACES))
            stop = min(stop + (int(space[0]) if len(space) else size), len(data))
            if len(space):
                break
        yield pa.array([data[at:stop].tobytes().decode()], pa.string())
        at = stop


def _encoded(batches, model: str, end_id: int, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """``(doc ids, token counts, ids)`` of bounded pieces of the batches, an end id after every document."""
    encoder = _encoder(model)
    for batch in batches:
        for piece in slices(batch, 1, size):
            texts = piece.column(1)
            if piece.num_rows == 1 and (buffer := texts[0].as_buffer()) is not None and buffer.size > size:
                parts = [encoder.encode(t)[0] for t in _pieces_of(texts[0], size)]
                flat = np.concatenate(parts)
                counts = np.array([len(flat)])
            else:
                flat, counts = encoder.encode(texts)
            out = np.full(len(flat) + len(counts), end_id, dtype=np.uint32)
            out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
            yield piece.column(0).to_pylist(), counts + 1, out


def write_tokens(docs: DataFrame, path: str, model: str, end_id: int, segment_tokens: int = SEGMENT_TOKENS, per_file: int = SEGMENTS_PER_FILE, size: int = SLICE_BYTES) -> None:
    """Encode every whole text of ``(doc_id, text)`` and write the files to ``path``, in ascending order of ids; ``model`` is the tokenizer's JSON.

    A null text is empty and holds the end id alone. Rows without an id come first; rows with one id stand in the order of a hash of their texts.
    Texts are range-partitioned by (id, hash), so ids that repeat spread as well, and a task holds one segment. Spark's text sink writes the segments,
    so any file system that Spark can write will do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the tokenizer's file
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def segments(batches):
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def close():
            names = [d for x in held for d in x[0]]
            blob = build_segment(names, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), part, seq)
            return pa.record_batch([pa.array([blob], pa.binary())], names=["segment"])

        for found in _encoded(batches, shared.value, end_id, size):
            held.append(found)
            n += len(found[2])
            if n >= segment_tokens:
                yield close()
                seq, held, n = seq + 1, [], 0
        if held:
            yield close()

    blobs = rows.mapInArrow(segments, "segment binary").select(F.col("segment").cast("string").alias("value"))
    blobs.write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


# --- reading -----------------------------------------------------------------------------------------------------------


def segments_of(content) -> Iterator[tuple[int, Segment]]:
    """Offset and segment, for every segment of a file."""
    offset = 0
    while offset < len(content):
        segment = Segment(content, offset)
        yield offset, segment
        offset += segment.size
        if bytes(content[offset : offset + 1]) != b"\n":
            raise ValueError("a segment does not end where its size says")
        offset += 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment: ``(part, seq, path, offset, n_docs, n_tokens, start)``, where ``start`` counts the tokens of all segments before."""

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = [(s.part, s.seq, name.as_py(), o, s.n_docs, s.n_tokens) for o, s in segments_of(memoryview(content.as_buffer()))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    names = ["part", "seq", "path", "offset", "n_docs", "n_tokens"]
    schema = pa.schema([(n, pa.string() if n == "path" else pa.int64()) for n in names])
    found = _files(spark, path).mapInArrow(read, "part long, seq long, path string, offset long, n_docs long, n_tokens long")
    found, _ = saved(found, "segments")  # a sort by ranges looks at its rows twice
    summed = running_sums(found, [], [F.col("part"), F.col("seq")], {"upto": F.col("n_tokens")})
    return summed.select(*names, (F.col("upto") - F.col("n_tokens")).alias("start"))


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, middle_id[, ids])`` of every document in the files. ``start`` counts the ids of all documents before it,
    ``ids_crc32`` is that of its ids as unsigned little-endian numbers of 32 bits, and ``middle_id`` its middle id (the earlier of two), which
    is looked up by direct access."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                for _, s in segments_of(memoryview(content.as_buffer())):
                    flat, starts = s.tokens(), s.starts
                    sums = [zlib.crc32(flat[a:b].data) for a, b in zip(starts.tolist(), s.ends.tolist())]
                    many = s.ends - starts
                    columns = [pa.array(np.full(s.n_docs, x, np.int64)) for x in (s.part, s.seq)]
                    columns += [pa.array(s.doc_ids, pa.int64()), pa.array(starts), pa.array(many), pa.array(sums, pa.int64())]
                    middle = np.full(s.n_docs, -1, np.int64)
                    middle[many > 0] = s.at((starts + (many - 1) // 2)[many > 0])
                    columns.append(pa.array(middle, mask=many == 0))
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], s.ends)), pa.int32()), pa.array(flat.astype(np.int64))))
                    yield pa.record_batch(columns, names=names)

    names = ["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32", "middle_id"] + ["ids"] * ids
    rows = _files(spark, path).select("content").mapInArrow(read, ", ".join(f"{n} {'array<long>' if n == 'ids' else 'long'}" for n in names))
    starts = directory(spark, path).select("part", "seq", "start")
    out = rows.join(starts, ["part", "seq"]).withColumn("start", F.col("start") + F.col("begin"))
    return out.select("doc_id", "start", *names[4:])


def lookup(spark: SparkSession, path: str, positions: DataFrame, bucket: int = SEGMENT_TOKENS) -> DataFrame:
    """``(position, token)`` for every row of ``positions(position)`` that lies inside the corpus, by direct access: only files that hold an asked
    position are opened, and no segment is decoded. Positions are matched to segments by equal buckets; a position that repeats is looked up once."""
    segments = directory(spark, path).select("path", "offset", "start", "n_tokens").where("n_tokens > 0")
    first, last = F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("n_tokens") - 1) / bucket)
    segments = segments.withColumn("bucket", F.explode(F.sequence(first, last)))
    asked = positions.select(F.col("position").cast("long").alias("position"))
    wanted = asked.where("position >= 0").distinct().withColumn("bucket", F.floor(F.col("position") / bucket))
    local = F.struct("offset", (F.col("position") - F.col("start")).alias("local"), "position")
    placed = wanted.join(segments, "bucket").where("position >= start AND position < start + n_tokens").groupBy("path").agg(F.collect_list(local).alias("at"))

    def read(batches):
        for batch in batches:
            for content, at in zip(batch.column("content"), batch.column("at")):
                buffer, rows = memoryview(content.as_buffer()), at.values
                offsets, inside, asked_at = (np.asarray(rows.field(i)) for i in range(3))
                for offset in np.unique(offsets):
                    here = offsets == offset
                    found = Segment(buffer, int(offset)).at(inside[here])
                    yield pa.record_batch([pa.array(asked_at[here]), pa.array(found.astype(np.int64))], names=["position", "token"])

    found = _files(spark, path).join(placed, "path").select("content", "at").mapInArrow(read, "position long, token long")
    return asked.join(found, "position")


def default_model(path: str | None = None) -> str:
    return Path(path or tokenizer_file()).read_text(encoding="utf-8")
