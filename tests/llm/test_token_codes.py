import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from poolscout.llm import token_codes

from .helpers import edge_documents, edge_rows, no_documents, prose


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_codes.tokenizer_file())


@pytest.fixture(scope="module")
def encoder():
    return token_codes.Encoder(token_codes.default_model())


def by_hand(rows, tokenizer):
    """Rows of one id are sorted by what they give; their order is that of a hash."""
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids[(len(ids) - 1) // 2]))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def checked(spark, docs, path, rows, tokenizer, **kw):
    token_codes.write_tokens(docs, path, token_codes.default_model(), 2, **kw)
    found = sorted(token_codes.read_documents(spark, path, ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [r[0] for r in by_hand(rows, tokenizer)]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["middle_id"]) for r in found), key=lambda r: (r[0] is not None, r)) == by_hand(rows, tokenizer)
    upto = 0
    for r in found:
        assert r["start"] == upto and len(r["ids"]) == r["n_tokens"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        upto += r["n_tokens"]
    return found


@pytest.mark.parametrize("kw", [{}, {"segment_tokens": 50, "per_file": 2, "size": 3000}])
def test_odd_documents(spark, tmp_path, tokenizer, kw):
    docs = edge_documents(spark).selectExpr("*", "1 AS segment", "2 AS part", "3 AS seq", "4 AS start", "'i' AS ids")
    found = checked(spark, docs, str(tmp_path / "codes"), [r[:2] for r in edge_rows()], tokenizer, **kw)
    ids = [i for r in found for i in r["ids"]]
    asked = [0, 1, len(ids) - 1, len(ids), -1, None, 5, 5, *random.Random(1).sample(range(len(ids)), 300)]
    got = token_codes.lookup(spark, str(tmp_path / "codes"), spark.createDataFrame([(p,) for p in asked], "position long"), bucket=64)
    assert sorted(tuple(r) for r in got.collect()) == sorted((p, ids[p]) for p in asked if p is not None and 0 <= p < len(ids))


def test_the_given_documents(spark, tmp_path, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    checked(spark, docs, str(tmp_path / "codes"), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, segment_tokens=100_000)


def test_empty_table(spark, tmp_path):
    token_codes.write_tokens(no_documents(spark), str(tmp_path / "codes"), token_codes.default_model(), 2)
    assert token_codes.read_documents(spark, str(tmp_path / "codes")).collect() == []
    assert token_codes.lookup(spark, str(tmp_path / "codes"), spark.createDataFrame([(0,)], "position long")).collect() == []


def test_a_text_of_many_pieces(tokenizer):
    text = prose(4, 60_000) + " é" * 2000 + "<|endoftext|> don't"
    batch = pa.record_batch([pa.array([5]), pa.array([text])], names=["doc_id", "text"])
    ((names, counts, ids),) = token_codes._encoded([batch], token_codes.default_model(), 2, 10_000)
    assert names == [5] and counts.tolist() == [len(ids)] and ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


CHARS = list("aB'sStdm.,!-_1 2<|>") + ["é", "́", "İ", "Σ", "ß", "\n", "\t", "\x0b", "\xa0", "　", "\x85", "\x1c", "２", "re", "VE", "ll", "<|endoftext|>", "漢", "😀", "‍", "ﬁ", "\x00", "\x01", "한", "ᄒ", "ᅡ", "ᆫ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CHARS), max_size=24).map("".join), max_size=4))
def test_units_encode_as_whole_texts_do(texts):
    whole, own = test_units_encode_as_whole_texts_do.tools
    ids, counts = own.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


test_units_encode_as_whole_texts_do.tools = (Tokenizer.from_file(token_codes.tokenizer_file()), token_codes.Encoder(token_codes.default_model()))


def test_a_worker_that_forgets(encoder, monkeypatch, tokenizer):
    monkeypatch.setattr(token_codes, "REMEMBERED", 10)
    for seed in range(3):
        text = prose(seed, 50)
        ids, counts = encoder.encode(pa.array([text, None, ""]))
        assert counts.tolist() == [len(ids), 0, 0] and ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 32), st.integers(0, 10**6))
def test_codes_give_any_id(n, bits, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(32 - bits, 33, n, dtype=np.uint64)).astype(np.uint32)
    cut = sorted(rng.integers(0, n + 1, 2).tolist())
    blob = token_codes.build_segment([7, None, 9], np.diff([0, *cut, n]), ids, 3, 4)
    ((offset, segment),) = token_codes.segments_of(memoryview(blob + b"\n"))
    assert (offset, segment.part, segment.seq, segment.doc_ids, segment.ends.tolist()) == (0, 3, 4, [7, None, 9], [*cut, n])
    assert segment.tokens().tolist() == ids.tolist()
    at = rng.integers(0, n, 50) if n else np.empty(0, np.int64)
    assert segment.at(at).tolist() == ids[at].tolist()
    with pytest.raises(IndexError):
        segment.at([n])


def test_widths_are_the_least_of_all():
    ids = np.random.default_rng(5).geometric(0.02, 3000).astype(np.uint32)
    def cost(widths):
        total, used, left = 0, 0, ids
        for level, w in enumerate(widths):
            used += w
            last = level + 1 == len(widths)
            total += len(left) * (w + (0 if last else 1 + 32 / token_codes.BLOCK))
            left = left[left >> np.uint32(used) > 0]
        return total
    most = int(ids.max()).bit_length()
    splits = [[b - a for a, b in zip([0, *cuts], [*cuts, most])] for mask in range(1 << (most - 1)) for cuts in [[i for i in range(1, most) if mask >> (i - 1) & 1]]]
    assert cost(token_codes.best_widths(ids)) == pytest.approx(min(map(cost, splits)))


def test_broken_files_are_errors():
    blob = token_codes.build_segment([1], np.array([3]), np.array([1, 2, 300]))
    for bad in (blob, blob[:-1] + b"\n", b"X" + blob[1:] + b"\n"):
        with pytest.raises(ValueError):
            list(token_codes.segments_of(memoryview(bad)))
