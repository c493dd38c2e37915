"""Corpus queries with SQL beside them give the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from setforge.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert len(got)
