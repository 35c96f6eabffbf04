"""Every registered query of the engine against its SQL, and the contract of the entry points."""

import glob
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from framestride.plans import catalogue


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_queries_agree_with_their_sql(spark, tables, name):
    df, sql = catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name]
    columns = sorted(df.columns)
    want = tables.sql(sql)
    assert sorted(want.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    rows = tables.sql(f"SELECT {names} FROM ({sql})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, rows))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
