"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from confluo.plans import load_all
from confluo.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v).removesuffix(" 00:00:00")
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DIR)
    rows = sorted(tuple(shown(r[c]) for c in sorted(found.columns)) for r in found.collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(found.columns)
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert rows == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())
