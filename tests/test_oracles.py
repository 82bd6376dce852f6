"""Every registered query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from corpusgraph.plans import code, registry, reports, searching  # noqa: F401
from corpusgraph.plans.fixtures import BASE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_duckdb(spark, duck, name):
    ours = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert len(ours)  # each query meets rows that it finds
    theirs = duck.execute(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
