"""Every query of the folder over its whole table; those with SQL against it."""

import duckdb
import pytest

from poolscout.llm import catalog

SF = "/root/testdata/sf0.01"
TABLE = {name: "pages" if name.startswith(("op1_", "op9_")) else "embeddings" if name.startswith("op13_") else "documents" for name in catalog.QUERIES}
#: Rows per part instead of rows per document.
BY_PART = {"op11_filter_audit": "SELECT 600 * count(DISTINCT coalesce(lang, '')) FROM documents"}


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    frame = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    with duckdb.connect() as duck:
        for table in {TABLE[name], "labels"}:
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        assert len(rows) == duck.execute(BY_PART.get(name, f"SELECT count(*) FROM {TABLE[name]}")).fetchone()[0]
        if name in catalog.SQL:
            found = duck.execute(catalog.SQL[name])
            names = [d[0] for d in found.description]
            assert sorted(names) == sorted(frame.columns)
            assert plain(rows) == plain(tuple(r[names.index(c)] for c in frame.columns) for r in found.fetchall())
