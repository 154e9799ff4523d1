"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from oracle_check import TABLES, rows
from strataq.queries import registry

registry.load_all()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    got, columns = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.SQL:
        rel = con.execute(registry.SQL[name])
        want, names = rows([c[0] for c in rel.description], rel.fetchall())
        assert columns == names
        assert got == want
