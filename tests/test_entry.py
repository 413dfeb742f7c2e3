"""The registry: every query runs on the smallest tables, and equals its SQL where there is one."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from prosegrid.plans import oracles, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return str(value) if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in oracles.oracle_sql():
        result = tables.execute(oracles.oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())


def test_oracles_belong_to_queries():
    assert set(oracles.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
