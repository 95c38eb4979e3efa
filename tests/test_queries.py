"""Every query against its SQL, over whole tables."""

import datetime
import decimal
import glob
import importlib.util
import math
import os

import duckdb
import pytest

from caudal import cli

QUERIES = cli.load()
from caudal.plans.registry import SQL  # noqa: E402


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.5f}"
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x).replace(" 00:00:00", "")
    return str(x)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(_value(r[c]) for c in order) for r in df.collect())
    at = [columns.index(c) for c in order]
    assert got == sorted(tuple(_value(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    QUERIES[name](spark, data).collect()


def test_entry(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).limit(1).count() == 1
    assert set(module.oracle_sql()) <= set(module.queries())
