"""Every array query against its SQL in DuckDB."""

import duckdb
import pytest

from tesserae import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "orders", "nation", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    want = sorted((tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall()), key=str)
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-6) for x, y in zip(a, b)), (a, b)
