"""Every registered query runs; those with SQL agree with it."""

import glob
import os

import duckdb
import pytest
from conftest import SF

from framestride.llm import queries


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_their_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, sql = queries.queries()[name](spark, SF), queries.oracle_sql()[name]
    columns = sorted(df.columns)
    assert sorted(db.sql(sql).columns) == columns
    rows = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, rows))
