import pytest

from poolscout.llm import quality_rules as qr

from .helpers import SMALL, edge_documents, edge_rows, no_documents, words


def by_hand(text):
    w = words(text)
    windows = {}
    for k in range(len(w) - 4):
        windows.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = {r["doc_id"]: by_hand(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in qr.judge(docs).collect()} == given


def test_edge_rows(spark):
    got = sorted((str(r["doc_id"]), *(r[c] for c in COUNTS)) for r in qr.judge(edge_documents(spark).drop("host")).collect())
    assert got == sorted((str(r[0]), *by_hand(r[1])) for r in edge_rows())
    rows = qr.judge(edge_documents(spark)).collect()
    assert len(rows) == len(edge_rows()) and all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] == 0)


def test_empty_table(spark):
    assert qr.judge(no_documents(spark)).collect() == []


def test_a_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "bad") for i in range(200)]
    rows += [(5000, good, "new"), (5001, bad, "fine"), (5002, good, None)]
    got = {r["doc_id"]: r for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["kept"] and not got[5001]["kept"]
    assert not got[1000]["base_failed"] and not got[1000]["kept"]
    assert (got[1000]["n_host"], got[1000]["n_host_failed"]) == (200, 180) and (got[0]["n_host"], got[0]["n_host_failed"]) == (201, 1)
    # every rate lies between the host's own and the common one
    common = 181 / 403
    assert 0 < got[0]["host_rate"] < common < got[1000]["host_rate"] < 0.9
    # a host with one document is judged mostly by the prior
    assert 0 < got[5000]["host_rate"] < 0.9


def test_hosts_that_differ_by_chance_share_one_rate():
    alpha, beta = qr.prior(3, 300, 30, 3 * 100.0**2, 3 * 10**2 / 100)
    assert alpha / (alpha + beta) == pytest.approx(0.1) and alpha + beta > 1000
    alpha, beta = qr.prior(2, 200, 100, 2 * 100.0**2, 99**2 / 100 + 1 / 100)
    assert alpha / (alpha + beta) == pytest.approx(0.5) and alpha + beta < 1
    assert qr.prior(0, 0, 0, 0.0, 0.0) == (1.0, 1.0)
