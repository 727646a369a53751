import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscout.llm import language_id as li

from .helpers import edge_documents, no_documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == docs.count() and len(held) > 100
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()
    assert got["rejected"].mean() < 0.01


def test_predictions_do_not_look_at_languages(spark):
    """Other languages, sources and ids in fold 0 change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda f: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in li.identify(f).collect())
    assert key(docs) == key(other)


def test_edge_rows(spark):
    got = {}
    for r in li.identify(edge_documents(spark)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[50]) == 2 and len(got[None]) == 2
    for i in (30, 31, 32, 42):
        assert (got[i][0]["lang_pred"], got[i][0]["score"], got[i][0]["rejected"]) == ("und", 0.0, True)
    for i in (35, 36, 41):
        assert got[i][0]["lang_pred"] in ("en", "de", "fr")


def test_empty_table(spark):
    assert li.identify(no_documents(spark)).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(i, "some text", None) for i in range(20)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.identify(docs).collect()} == {"und"}


def test_garbage_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**7 + i, "ωμγδφσ ξζψχθ " * 40, "en") for i in range(1)], "doc_id long, text string, lang string")
    fold = spark.range(10**7, 10**7 + 40).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).first()["id"]
    got = li.identify(docs.union(odd.withColumn("doc_id", F.lit(fold)))).where(F.col("doc_id") == fold).first()
    assert got["rejected"]


def counts_of(text: str):
    codes, _ = li.code_points([text])
    key, _ = li.grams(codes)
    return np.unique(key, return_counts=True)


def test_probabilities_sum_to_one():
    """Over all symbols seen, and the mass that stays for one unseen symbol, after seen and unseen histories."""
    texts = ["abab abc bca cab abba", "xyz xy yx zzx abc"]
    model = li.build(["p", "q"], [counts_of(t) for t in texts])
    symbols = np.unique(np.concatenate([counts_of(t)[0] for t in texts]) & np.uint64(0xFFFF))
    unseen = 2  # the floor is that of the symbols and two more
    for history in ("\0\0\0", "\0\0a", "\0ab", "aba", "zzz", "qqq"):
        head = 0
        for c in history:
            head = head << 16 | ord(c)
        keys = (np.uint64(head) << np.uint64(16)) | symbols
        other = (np.uint64(head) << np.uint64(16)) | np.uint64(0x4E00)
        total = np.exp(model.log_probability(keys).astype(float)).sum(axis=0) + unseen * np.exp(model.log_probability(np.array([other])).astype(float))[0]
        assert total == pytest.approx([1, 1], abs=1e-5)


def test_kneser_ney_by_hand():
    """The unigram level counts in how many histories a symbol stands."""
    model = li.build(["p"], [counts_of("ab ab cb")])
    bigrams = {("\0", "a"), ("\0", "c"), ("a", "b"), ("c", "b"), ("b", "\0")}
    types = {s: len({h for h, t in bigrams if t == s}) for s in "abc\0"}
    ones, twos = sum(v == 1 for v in types.values()), sum(v == 2 for v in types.values())
    discount, total = ones / (ones + 2 * twos), sum(types.values())
    for s in "abc":
        want = (types[s] - discount) / total + discount * len(types) / total / (len(types) + 2)
        assert math.exp(model.log_probability(np.array([ord(s)], dtype=np.uint64), 1)[0, 0]) == pytest.approx(want, rel=1e-5)


def test_words_do_not_depend_on_what_stands_before():
    codes, bounds = li.code_points(["x ab", "ab", "Äb"])
    key, at = li.grams(codes)
    first, second = key[(at >= 2) & (at < bounds[1])], key[(at >= bounds[1]) & (at < bounds[2])]
    assert first.tolist() == second.tolist()


def reference(rows: list[tuple[str, str]]) -> li.Model:
    """The model of all grams of ``(lang, text)``, whatever their number."""
    names = sorted({lang for lang, _ in rows})
    return li.build(names, [counts_of("\n".join(t for lang, t in rows if lang == name)) for name in names])


def bits_of(model: li.Model, text: str) -> float:
    keys = li.grams(li.code_points([text])[0])[0]
    return float((model.log_probability(keys).astype(float) / -math.log(2)).mean(axis=0).min())


def folds(spark, start: int, n: int) -> list[tuple[int, int]]:
    ids = spark.range(start, start + n).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 5).alias("fold"))
    return [(r["id"], r["fold"]) for r in ids.collect()]


def test_no_gram_is_dropped_from_a_large_alphabet(spark):
    """A language of more than 500 000 different 4-grams, nearly all seen once."""
    draw = np.random.default_rng(5)
    words = draw.integers(0x4E00, 0x4E00 + 5000, size=(260_000, 4))
    texts = [" ".join("".join(map(chr, w)) for w in part) for part in np.array_split(words, 100)]
    docs = [(i, t, "zh", f) for (i, f), t in zip(folds(spark, 0, 100), texts)]
    model = reference([(lang, t) for _, t, lang, f in docs if f > 1])
    assert len(model.hashes[li.ORDER - 1]) > 500_000
    got = li.identify(spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string")).collect()
    want = {i: bits_of(model, t) for i, t, _, _ in docs[:5]}
    assert {r["doc_id"]: r["bits"] for r in got if r["doc_id"] in want} == pytest.approx(want, rel=1e-5)


def test_a_model_that_no_task_holds_gives_the_same(spark):
    """Grams that are not held are looked up by a join: nothing is left out and nothing estimated otherwise."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300)
    odd = [(None, "한국어 문장 하나", "ko"), (None, "한국어 문장 하나", "ko"), (10**7, None, "en"), (10**7 + 1, "", "en"), (10**7 + 2, "ωμγδ 漢字", None)]
    odd += [(i, "한국어 문장 둘 " * 3, "ko") for i in range(10**8, 10**8 + 20)]
    docs = spark.createDataFrame(docs.collect() + odd, "doc_id long, text string, lang string")
    key = lambda r: (r["doc_id"] is not None, r["doc_id"])
    whole, split = (sorted(li.identify(docs, li.Options(held=n)).collect(), key=key) for n in (10**9, 300))
    assert len(whole) == len(split) == docs.count()
    for a, b in zip(whole, split):
        assert (a["doc_id"], a["held_out"], a["lang_pred"], a["rejected"]) == (b["doc_id"], b["held_out"], b["lang_pred"], b["rejected"])
        assert (b["bits"], b["score"]) == pytest.approx((a["bits"], a["score"]), rel=1e-5, abs=1e-6)


def test_short_texts_of_an_unlearned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    short = ["ωμ", "漢字", "это", "ok", "hyvä", "jog", "ydw", "kyllä", "szép"]
    held = [i for i, f in folds(spark, 10**7, 200) if f == 0][: len(short)]
    odd = spark.createDataFrame([(i, t, None) for i, t in zip(held, short)], docs.schema)
    got = {r["doc_id"]: r["rejected"] for r in li.identify(docs.union(odd)).collect()}
    assert {t: got[i] for i, t in zip(held, short)} == dict.fromkeys(short, True)
    assert sum(r for i, r in got.items() if i not in held) < 0.01 * len(got)


def test_a_language_without_calibration_rows_rejects(spark):
    """``el`` is learned from one text and never seen in fold 1."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    by = {}
    for i, f in folds(spark, 10**7, 100):
        by.setdefault(f, []).append(i)
    learned, usual, odd = by[2][0], *by[0][:2]
    rows = [(learned, "αβγδ εζηθ ικλμ " * 30, "el"), (usual, "αβγδ εζηθ ικλμ " * 3, None), (odd, "θδμ αηκ λγζε βι " * 10, None)]
    got = {r["doc_id"]: r for r in li.identify(docs.union(spark.createDataFrame(rows, docs.schema))).collect()}
    assert [got[i]["lang_pred"] for i in (usual, odd)] == ["el", "el"]
    assert [got[i]["rejected"] for i in (usual, odd)] == [False, True]
