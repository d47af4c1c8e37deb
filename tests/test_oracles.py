"""Every registered query with an SQL twin agrees with DuckDB on sf0.001."""

import duckdb
import pandas as pd
import pytest

from hydrosift.plans.registry import ORACLES, QUERIES

from .conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(df):
    df = df.reindex(sorted(df.columns), axis=1)

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "None"
        if isinstance(v, float):
            return repr(round(v, 6))
        return str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    s = QUERIES[name](spark, SF001).toPandas()
    o = con.execute(ORACLES[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert _norm(s) == _norm(o)
