"""Every registered query of the edit-pair operators against its SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from editpairs.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cell = lambda v: round(float(v), 6) if isinstance(v, float) and not pd.isna(v) else None if pd.api.types.is_scalar(v) and pd.isna(v) else v
    return sorted(str([cell(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())
