"""Every registered query against its DuckDB text on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodestone import registry
from lodestone.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    if isinstance(value, datetime.date | datetime.datetime | decimal.Decimal):
        return str(value)
    return repr(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, sf):
    df = registry.QUERIES[name](spark, sf)
    columns, rows = sorted(df.columns), df.collect()
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    if name not in registry.ORACLES:
        assert got
        return
    found = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
