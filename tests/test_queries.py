"""Every registered query against the DuckDB SQL it is compared with, and rows of the queries without SQL."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from ruleweave.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


def plain(v):
    """A value in the form both engines share."""
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) & set(registry.ORACLE_SQL)))
def test_query_equals_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, DATA)
    ran = tables.execute(registry.ORACLE_SQL[name])
    want_columns, want = rows_of([d[0] for d in ran.description], ran.fetchall())
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got_columns == want_columns
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
