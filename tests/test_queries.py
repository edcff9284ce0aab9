"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from terravane.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{value:.9g}" if value % 1 else str(int(value))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    # The smallest tables have no pair of heights that agree; then both sides are empty.
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert mine == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())
