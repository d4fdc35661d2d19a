"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from dossier.plans import FUNCTIONS, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = FUNCTIONS[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rows = duck.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in place) for r in rows.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(FUNCTIONS) - set(SQL)))
def test_has_rows(spark, name):
    assert FUNCTIONS[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
