"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from speechframe.plans import registry
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = ordered(df.select(*columns).collect())
    assert rows
    if name in registry.ORACLE_SQL:
        cursor = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == ordered([r[names.index(c)] for c in columns] for r in cursor.fetchall())
