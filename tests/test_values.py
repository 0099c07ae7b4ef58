"""Every query of the engine against its SQL, values included, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(x):
    x = float(x) if isinstance(x, decimal.Decimal) else x
    return (None if math.isnan(x) else round(x, 5) + 0.0) if isinstance(x, float) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    got = QUERIES[name](spark, FOLDER)
    want = tables.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())
