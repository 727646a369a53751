import datetime as dt

import pytest

from poolscout.llm import url_lists as ul


def day(text):
    return dt.date.fromisoformat(text)


def test_keys_of_urls(spark):
    rows = [
        ("https://User@A.b.Example.com:80/x/Y/?q#f", ["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x", "a.b.example.com/x/y"]),
        ("http://example.com", ["example.com"]),
        ("http://example.com.?q=/a", ["example.com"]),
        ("http://localhost/a", ["localhost", "localhost/a"]),
        ("mailto:a@b.c", None),
        ("", None),
        (None, None),
    ]
    got = spark.createDataFrame(rows, "url string, want array<string>").select("want", ul.url_keys("url").alias("got")).collect()
    for r in got:
        assert (r["got"] and sorted(r["got"])) == (r["want"] and sorted(r["want"]))


EVENTS = [
    ("a.com", "add", "2024-01-10", "x"), ("a.com", "remove", "2024-02-01", "x"), ("A.com", "ADD", "2024-03-01", "x"), ("a.com", "add", "2024-01-20", "x"),
    ("a.com", "add", "2024-01-01", None), ("b.com/p", "add", "2024-01-01", "y"), ("b.com", "add", "2024-05-05", "x"), ("b.com", "remove", "2024-05-05", "x"),
    ("c.com", "remove", "2024-01-01", "x"), (None, "add", "2024-01-01", "x"), ("d.com", "add", None, "x"), ("d.com", "renew", "2024-01-01", "x"), ("a.com", "add", "2024-01-10", "x"),
]


def events(spark):
    return spark.createDataFrame(EVENTS, "key string, action string, day string, category string").selectExpr("*", "1 AS valid_from", "2 AS part")


def test_intervals(spark):
    got = {tuple(r) for r in ul.intervals(events(spark)).collect()}
    never = day(ul.NEVER)
    assert got == {
        ("a.com", "x", day("2024-01-10"), day("2024-01-20")), ("a.com", "x", day("2024-01-20"), day("2024-02-01")), ("a.com", "x", day("2024-03-01"), never),
        ("a.com", "", day("2024-01-01"), never), ("b.com/p", "y", day("2024-01-01"), never),
    }


@pytest.mark.parametrize("salts", [1, 16])
def test_captures_see_the_entries_of_their_day(spark, salts):
    rows = [
        (1, "http://s.a.com/q", "2024-01-09"), (2, "http://s.a.com/q", "2024-01-10"), (3, "http://a.com", "2024-01-31"), (4, "http://a.com", "2024-02-01"), (5, "http://a.com", "2024-03-01"),
        (6, "http://b.com/p/z", "2024-06-01"), (7, "http://b.com/pp", "2024-06-01"), (8, None, "2024-06-01"), (9, "http://a.com", None), (10, "http://c.com", "2024-06-01"), (2, "http://s.a.com/q", "2024-01-10"), (None, "http://a.com", "2024-03-01"),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string").selectExpr("*", "1 AS key", "2 AS salt", "3 AS host", "4 AS category")
    found = ul.judge(captures, ul.intervals(events(spark)), "page_id", "url", "fetched", salts).collect()
    assert sorted((str(r["id"]), str(r["day"])) for r in found) == sorted((str(i), str(d)) for i, _, d in rows)
    got = {(r["id"], str(r["day"])): (r["n_active"], r["active_key"], r["category"], r["listed"]) for r in found}
    assert got == {
        (1, "2024-01-09"): (1, "a.com", "", True), (2, "2024-01-10"): (2, "a.com", "", True), (3, "2024-01-31"): (2, "a.com", "", True), (4, "2024-02-01"): (1, "a.com", "", True),
        (5, "2024-03-01"): (2, "a.com", "", True), (6, "2024-06-01"): (1, "b.com/p", "y", True), (7, "2024-06-01"): (0, None, None, False), (8, "2024-06-01"): (0, None, None, False),
        (9, "None"): (0, None, None, False), (10, "2024-06-01"): (0, None, None, False), (None, "2024-03-01"): (2, "a.com", "", True),
    }


def test_empty_tables(spark):
    none = spark.createDataFrame([], "key string, action string, day string, category string")
    captures = spark.createDataFrame([(1, "http://a.com", "2024-01-01")], "page_id long, url string, fetched string")
    assert [r["n_active"] for r in ul.judge(captures, ul.intervals(none), "page_id", "url", "fetched").collect()] == [0]
    assert ul.judge(captures.limit(0), ul.intervals(events(spark)), "page_id", "url", "fetched").collect() == []


def test_every_capture_has_a_row(spark):
    rows = [(1, "http://a.com/x", "2024-03-01")] * 3 + [(None, "http://a.com/x", "2024-03-01")] * 2 + [(None, None, None)] * 2 + [(1, "http://b.com", "2024-03-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string")
    found = ul.judge(captures, ul.intervals(events(spark)), "page_id", "url", "fetched").collect()
    assert sorted((str(r["id"]), str(r["host"]), r["n_active"]) for r in found) == [("1", "a.com", 2)] * 3 + [("1", "b.com", 0)] + [("None", "None", 0)] * 2 + [("None", "a.com", 2)] * 2


def test_very_long_urls_have_few_keys(spark):
    deep = [(1, "http://b.com/p/" + "x/" * 500_000, "2024-03-01"), (2, "http://" + "s." * 300_000 + "a.com/", "2024-03-01")]
    captures = spark.createDataFrame(deep, "page_id long, url string, fetched string")
    found = {r["id"]: (r["n_active"], r["active_key"]) for r in ul.judge(captures, ul.intervals(events(spark)), "page_id", "url", "fetched").collect()}
    assert found == {1: (1, "b.com/p"), 2: (2, "a.com")}
    got = spark.createDataFrame([("http://a.b.c.d.com/1/2/3",)], "url string").select(ul.url_keys("url", 3, 2)).first()[0]
    assert sorted(got) == ["a.b.c.d.com", "a.b.c.d.com/1", "a.b.c.d.com/1/2", "c.d.com", "d.com"]
