"""The engine's tables over the driver's files, as DataFrames and as DuckDB SQL.

Event times are long microseconds since 1970 (``t``), so that windows are integer arithmetic and no
result depends on a session's time zone. Amounts are signed from the pool's side, as logged.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND

_TRADE = {
    "block_number": "event_id", "log_index": "0", "pool_id": "event_id % 20", "wallet": "user_id", "kind": "event_type",
    "side": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'OUT0' ELSE 'OUT1' END",
    "t": "{us:ts}", "created_t": "{us:ts} + (event_id % 7) * 60000000",
    "amount0": "CASE WHEN event_type IN ('purchase', 'signup') THEN -1 ELSE 1 END * (1 + event_id % 97)",
    "amount1": "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END * CAST(round(value * 100) AS BIGINT)",
}
_SIGNAL = {
    "signal_id": "event_id", "token_id": "user_id", "pool_id": "event_id % 20", "version": "concat('v', user_id % 2)", "alpha": "CAST({json:props} AS DOUBLE)",
    "coverage": "CAST(user_id % 11 AS DOUBLE) / 10", "t": "{us:ts}", "price": "CAST(round(value * 100) AS DOUBLE) / (1 + event_id % 97)",
}
_SNAPSHOT = {"pool_id": "o_custkey", "snapshot_id": "o_orderkey", "t": "{us:o_orderdate}", "liquidity": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END", "market_cap": "10 * o_totalprice"}
_HOLDER = {"token_id": "c_nationkey", "wallet": "c_custkey", "balance": "CAST(round(c_acctbal * 100) AS BIGINT)", "first_t": "c_custkey * 60000000"}
_TRANSFER = {"token_id": "l_suppkey % 10", "tx": "l_orderkey", "log_index": "l_linenumber", "source": "l_suppkey", "target": "l_partkey", "value": "CAST(l_quantity AS BIGINT)", "t": "{us:l_shipdate}"}
_FUNDING = {"wallet": "o_orderkey", "funder": "o_custkey", "t": "{us:o_orderdate}", "value": "CAST(round(o_totalprice * 100) AS BIGINT)", "tx": "concat({us:o_orderdate}, o_orderpriority)"}
#: View to (table, filter, columns).
_VIEWS = {
    "trades": ("events", "true", _TRADE),
    "signals": ("events", "event_type = 'signup'", _SIGNAL),
    "quotes": ("events", "event_type = 'view'", {"quote_id": "event_id", "token_id": "event_id % 5", "t": "{us:ts}", "price": "value"}),
    "snapshots": ("orders", "true", _SNAPSHOT),
    "holders": ("customer", "true", _HOLDER),
    "transfers": ("lineitem", "true", _TRANSFER),
    "fundings": ("orders", "true", _FUNDING),
}


def _dialect(text: str, us: str, json: str) -> str:
    import re

    text = re.sub(r"\{us:(\w+)\}", lambda m: us.format(m[1]), text)
    return re.sub(r"\{json:(\w+)\}", lambda m: json.format(m[1]), text)


def sql_views() -> str:
    """The views as common table expressions for DuckDB."""
    parts = []
    for name, (table, where, columns) in _VIEWS.items():
        body = ", ".join(f"{_dialect(e, 'epoch_us({})', "json_extract_string({}, '$.k')")} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {body} FROM {table} WHERE {where})")
    return "WITH RECURSIVE " + ",\n".join(parts)


class Views:
    """Lazily read tables and views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        table, where, columns = _VIEWS[name]
        rows = self.table(table).filter(where)
        return rows.selectExpr(*(f"{_dialect(e, 'unix_micros(CAST({} AS TIMESTAMP))', "get_json_object({}, '$.k')")} AS {c}" for c, e in columns.items()))

    trades = cached_property(lambda self: self._view("trades"))
    signals = cached_property(lambda self: self._view("signals"))
    quotes = cached_property(lambda self: self._view("quotes"))
    snapshots = cached_property(lambda self: self._view("snapshots"))
    holders = cached_property(lambda self: self._view("holders"))
    transfers = cached_property(lambda self: self._view("transfers"))
    fundings = cached_property(lambda self: self._view("fundings"))
