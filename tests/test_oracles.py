"""Every query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tarnwork import plans  # noqa: E402
from tarnwork.plans.registry import TABLES  # noqa: E402

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float) and v == int(v) and abs(v) < 2**53:
        v = int(v)
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    got = [tuple(r) for r in found.collect()]
    if name not in plans.ORACLES:
        assert got is not None
        return
    want = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, got) == rows(columns, want.fetchall())
