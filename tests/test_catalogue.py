"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from chronoweave import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("events", "orders", "lineitem"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    own = normal(queries.queries()[name](spark, SF).toPandas())
    assert own == normal(duck.sql(queries.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
