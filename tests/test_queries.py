"""Driver queries against their SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from pagemend.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def sortable(rows):
    return sorted(rows, key=lambda r: tuple((x is None, repr(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, tables, name):
    df = QUERIES[name](spark, DIR)
    cur = tables.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sortable(tuple(r[c] for c in sorted(columns)) for r in df.collect())
    at = [columns.index(c) for c in sorted(columns)]
    want = sortable(tuple(r[i] for i in at) for r in cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y)) for x, y in zip(a, b, strict=True)), (a, b)


def test_queries_without_sql(spark):
    changed = QUERIES["correct_changes"](spark, DIR).collect()
    lines = {(r.document_id, r.page_ord, r.line_no): r for r in QUERIES["correct_lines"](spark, DIR).collect()}
    assert len(lines) > 1000 and changed
    last = {}
    for c in sorted(changed, key=lambda c: c.seq):
        last[c.document_id, c.page_ord, c.line_no] = c
    assert {k: c.new for k, c in last.items()} == {k: r.corrected for k, r in lines.items() if r.corrected != r.text}
    spark.catalog.clearCache()
