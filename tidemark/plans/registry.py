"""Registration of queries over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources.views import Views, sql_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(views) under its name; ``sql`` goes on after the views' common table expressions."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Views(spark, folder))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql_views() + ("" if sql.lstrip().startswith(",") else "\n") + sql
        return f

    return register


def six(*names: str) -> dict:
    """Doubles to six places: sums may add up in another order elsewhere."""
    return {n: F.round(n, 6) for n in names}
