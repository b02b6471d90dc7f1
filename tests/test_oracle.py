"""Every registered graph and text query against its SQL, and rows for those without."""

import math

import duckdb
import pytest

from tessella.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def values(df):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, str | bool):
            return str(x)
        return round(float(x), 9)

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(one, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    found, wanted = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert values(found) == values(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).take(1)


def test_nothing_of_the_data_is_written_to_the_tables(sf):
    assert duckdb.connect().execute(f"SELECT count(*) FROM '{sf}/region.parquet'").fetchall() == [(5,)]
