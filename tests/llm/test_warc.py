import base64
import hashlib

import pytest
from pyspark.sql import types as T

from poolscout.llm import warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def by_hand(rows, least=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for body, pages in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ranked = sorted(pages, key=lambda p: (p is None, -(p or 0)))
        for rank, page in enumerate(ranked):
            revisit = rank > 0 and len(body) >= least
            out.append((page, len(body), digest, "revisit" if revisit else "response", ranked[0] if revisit else None))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


HARD = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/", "same"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (6, "http://e/", "\r\n\r\n"), (7, "http://ü/ñ", "é漢😀\x00\x01"), (8, "x", "y" * 400_000), (10, "x", "y" * 400_000), (None, "n", "same"), (11, "p: q", "\n"),
]


@pytest.mark.parametrize("per_file", [20_000, 2])
@pytest.mark.parametrize("least", [0, 5])
def test_hard_payloads(spark, least, per_file):
    pages = spark.createDataFrame(HARD, PAGES).selectExpr("*", "1 AS record_id", "'x' AS payload", "2 AS n")
    assert rows_of(warc.deduplicate_pages(pages, least, per_file)) == by_hand(HARD, least)


def test_repeated_rows_are_records_of_their_own(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "a"), (2, "v", "b")]
    got = rows_of(warc.deduplicate_pages(spark.createDataFrame(rows, PAGES)))
    assert [r[3] for r in got] == ["response", "revisit", "revisit", "response"] and {r[4] for r in got if r[3] == "revisit"} == {1}


def test_empty_table(spark):
    assert warc.deduplicate_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert rows_of(warc.deduplicate_pages(pages)) == by_hand([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_archives_are_read_back_whole_and_refer_to_each_other(spark, tmp_path):
    pages = spark.createDataFrame(HARD, PAGES)
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    warc.write_pages(pages, first)
    whole = warc.read_archives(spark, first, payloads=True)
    assert sorted((r["page_id"] or 0, bytes(r["payload"])) for r in whole.collect()) == sorted((p or 0, (h or "").encode()) for p, _, h in HARD)
    warc.write_deduplicated(whole, warc.resolve(warc.read_archives(spark, first)), second)
    records = warc.read_archives(spark, second, payloads=True).collect()
    ids = {r["record_id"]: r for r in records}
    assert len(ids) == len(HARD) and not set(ids) & {r["record_id"] for r in whole.collect()}
    for r in records:
        if r["record_type"] == "revisit":
            assert bytes(r["payload"]) == b"" and ids[r["refers_to_record"]]["payload_digest"] == r["payload_digest"]
            assert ids[r["refers_to_record"]]["page_id"] == r["refers_to"]


def test_broken_archives_are_errors():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [body for _, body in warc.parse(iter([record[:7], record[7:], record]))] == [b"abc", b"abc"]
    for bad in (record[:-6], record.replace(b"3", b"2"), b"junk\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse(iter([bad])))
