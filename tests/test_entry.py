"""What __spark_entry__ gives to a driver: SQL texts that DuckDB runs, with the rows of the queries."""

import duckdb
import pytest

import __spark_entry__
from corpusgraph.plans import registry
from corpusgraph.plans.fixtures import BASE

FOLDER = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()


def test_oracles_are_texts_for_queries():
    assert all(isinstance(text, str) for text in ORACLES.values())
    assert ORACLES.keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - registry.QUERIES.keys()))
def test_matches_duckdb(spark, name):
    connection = duckdb.connect()
    for table in BASE:
        connection.execute(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    ours = __spark_entry__.queries()[name](spark, FOLDER).toPandas()
    theirs = connection.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda df: sorted(tuple(map(str, row)) for row in df[sorted(df.columns)].itertuples(index=False))
    assert plain(ours) == plain(theirs)
