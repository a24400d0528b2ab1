"""The registered queries against their SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from driftglass.llm import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        path = f"{DATA}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    def plain(table):
        return sorted((tuple("" if pd.isna(v) else v if isinstance(v, str) else float(v) for v in row) for row in table[sorted(table.columns)].astype(object).itertuples(index=False)), key=repr)

    ours, theirs = catalogue.queries()[name](spark, DATA).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)
