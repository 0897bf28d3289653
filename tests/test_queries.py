"""Every query that SQL can state, held against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from callscope.plans import class_queries, fleet_queries, graph_queries, list_queries, pom_queries, signature_queries, store_queries  # noqa: F401
from callscope.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return None
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    found, wanted = QUERIES[name](spark, DATA).toPandas(), oracle.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert canonical(found) == canonical(wanted)
