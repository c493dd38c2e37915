"""Every query with SQL beside it gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from setforge.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(frame.columns)
    return frame[cols].sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = ordered(registry.queries()[name](spark, SF).toPandas()), ordered(duck.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
    assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
