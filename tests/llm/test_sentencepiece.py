import numpy as np
import pyarrow as pa
import pytest

from poolscout.llm import sentencepiece_unigram as su

from .helpers import SMALL, edge_documents, edge_rows, no_documents, prose

TEXTS = ["", " ", "   ", "  a", "a\nb\tc  d", "▁x▁▁y", "x▁", "ﬁ ½ é 漢字 𝒳 😀", "x" * 300, "\x00\x00", "é" * 50, prose(1, 200), "ünïcödé wörds hellooooo the quick brown", "the the the\r\n"]


@pytest.fixture(scope="module")
def vocab():
    return su.load()


def best_of_unit(unit: bytes, vocab, table):
    """Best path over the bytes of one unit; of equal scores the longer last piece."""
    at = [0]
    for c in unit.decode():
        at.append(at[-1] + len(c.encode()))
    best, back = {0: 0.0}, {}
    for e in at[1:]:
        for s in [x for x in at if x < e]:
            piece = table.get(unit[s:e])
            if piece is not None:
                score = vocab.scores[piece]
            elif len(unit[s:e].decode()) == 1:
                score, piece = vocab.scores[-1], -1
            else:
                continue
            if e not in best or best[s] + score > best[e]:
                best[e], back[e] = best[s] + score, (s, piece)
    out, e = [], at[-1]
    while e:
        s, piece = back[e]
        out[:0] = [piece] if piece >= 0 else [int(vocab.byte_ids[b]) for b in unit[s:e]]
        e = s
    return out


def by_hand(text, vocab):
    if not text:
        return []
    data = (" " + text.replace(su.MARKER, " ")).encode()
    table = {p: i for i, p in enumerate(vocab.pieces) if p and vocab.scores[i] > -np.inf}
    out, begin = [], 0
    for k in range(1, len(data) + 1):
        if k == len(data) or (data[k] == 32 and data[k - 1] != 32):
            out += best_of_unit(data[begin:k], vocab, table)
            begin = k
    return out


def test_equals_viterbi_by_hand(vocab):
    ids, bounds = su.encode_column(pa.array(TEXTS + [None]), vocab)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [by_hand(t, vocab) for t in [*TEXTS, None]]


@pytest.mark.parametrize("chunk", [1, 7])
def test_chunks_of_units_make_no_difference(vocab, chunk, monkeypatch):
    want = su.encode_column(pa.array(TEXTS), vocab)
    monkeypatch.setattr(su, "CHUNK_BYTES", chunk)
    got = su.encode_column(pa.array(TEXTS), vocab)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_decoding_agrees_with_the_library(vocab):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=su.MODEL)
    ids, bounds = su.encode_column(pa.array(TEXTS), vocab)
    data, cuts = su.decode_bytes(ids.astype(np.int64), bounds, vocab)
    for k, text in enumerate(TEXTS):
        own = data[cuts[k] : cuts[k + 1]].tobytes().decode()
        assert own == text.replace(su.MARKER, " ")
        assert model.decode(ids[bounds[k] : bounds[k + 1]].tolist()) == own
        theirs = model.encode(text)
        back, at = su.decode_bytes(np.array(theirs, dtype=np.int64), np.array([0, len(theirs)]), vocab)
        assert back.tobytes().decode() == model.decode(theirs)


def test_round_trip_of_documents(spark, vocab):
    for docs, n in ((spark.read.parquet(f"{SMALL}/documents.parquet"), 200), (edge_documents(spark), len(edge_rows())), (no_documents(spark), 0)):
        tokens = su.encode(docs, vocab, check=True)
        rows = su.decode(tokens.withColumn("n", su.byte_tokens(vocab)), vocab).collect()
        assert len(rows) == n and all(r["restored"] and r["decoded"] == r["text"].replace(su.MARKER, " ") for r in rows)
        assert {r["n"] > 0 for r in rows if r["text"].startswith("é😀")} == ({True} if n == len(edge_rows()) else set())


def test_a_unigram_model_keeps_its_scores():
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "▁a", "bc"]
    scores = [0.0] * 257 + [-2.0, -3.0, -3.0, -4.0, -4.5, -1.0]
    vocab = su.vocabulary(pieces, scores, {b: 1 + b for b in range(256)}, set(range(257)), ranked=False)
    texts = ["abc", "ab", "c", "bcbc a", "á"]
    ids, bounds = su.encode_column(pa.array(texts), vocab)
    got = [[pieces[i] for i in ids[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [["▁a", "bc"], ["▁", "ab"], ["▁", "<0x63>"], ["▁", "bc", "bc", "▁a"], ["▁", "<0xC3>", "<0xA1>"]]


def test_trie_holds_exactly_its_entries():
    entries = sorted({bytes(np.random.default_rng(s).integers(0, 256, 1 + s % 6).astype(np.uint8)) for s in range(500)})
    base, check, value = su.build_trie([(e, i) for i, e in enumerate(entries)])

    def find(word):
        state = 0
        for c in word:
            state, before = int(base[state]) + c + 1, state
            if state >= len(check) or check[state] != before:
                return -1
        return int(value[state])

    assert [find(e) for e in entries] == list(range(len(entries)))
    assert all(find(e + b"!") == (entries.index(e + b"!") if e + b"!" in entries else -1) for e in entries)


def test_bad_ids_and_bad_bytes(spark, vocab):
    low = int(vocab.byte_ids[0xFF])
    rows = spark.createDataFrame([(1, [low]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in su.decode(rows, vocab).collect()} == {1: "�", 2: "", 3: ""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        su.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), vocab).collect()
    with pytest.raises(ValueError, match="marker inside"):
        su.vocabulary(["a▁b"], [0.0], dict.fromkeys(range(256), 0), set(), False)
