"""Each query with SQL against DuckDB on the supplied tables."""

import math

import duckdb
import pytest

from corpuslab.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted([tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())
