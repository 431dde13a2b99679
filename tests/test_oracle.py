"""Every query with SQL against DuckDB on the supplied tables."""

import math

import duckdb
import pytest

from corpuslab.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted([tuple("~" if v is None else f"{v:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert plain(rows) == plain(want.select(*columns).fetchall())
