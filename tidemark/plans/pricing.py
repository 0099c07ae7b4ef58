"""Queries of prices from pool state, market caps, liquidity, taxes and answers of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import decode, exact
from tidemark.operators import risk

from .ingest import _word
from .registry import query

ONE = "CAST(1000000000000000000 AS HUGEINT)"


def scaled_sql(p: str) -> str:
    """A number of 18 places as text, without trailing zeros; null stays."""
    return f"CASE WHEN {p} IS NOT NULL THEN concat(CASE WHEN {p} < 0 THEN '-' ELSE '' END, abs({p}) // {ONE}, CASE WHEN abs({p}) % {ONE} = 0 THEN '' ELSE concat('.', rtrim(lpad(CAST(abs({p}) % {ONE} AS VARCHAR), 18, '0'), '0')) END) END"


#: Pools: some sides are empty; every third has a square-root price k * 2**96.
_STATE = f""", st AS (SELECT p_partkey AS pool, CAST(p_partkey % 7 * 1000003 AS HUGEINT) AS r0, CAST(p_size % 11 * 1000 AS HUGEINT) AS r1, CASE WHEN p_partkey % 3 = 0 THEN CAST(1 + p_size AS HUGEINT) END AS k, p_partkey % 2 = 0 AS first FROM part),
    pr AS (SELECT *, CASE WHEN r0 > 0 AND r1 > 0 THEN nullif(r1 * {ONE} // r0, 0) END AS by_reserves, k * k * {ONE} AS by_sqrt FROM st),
    qu AS (SELECT *, CASE WHEN r0 > 0 AND r1 > 0 THEN coalesce(by_sqrt, by_reserves) END AS p FROM pr),
    pq AS (SELECT *, CASE WHEN first THEN p ELSE nullif({ONE} * {ONE} // p, 0) END AS price FROM qu)"""


def _states(v):
    key = F.col("p_partkey")
    root = F.when(key % 3 == 0, ((1 + F.col("p_size")).cast("decimal(9,0)") * F.lit(str(2**96)).cast("decimal(29,0)")).cast("string"))
    text = lambda x: x.cast("long").cast("string")
    return v.table("part").select(key.alias("pool"), text(key % 7 * 1000003).alias("r0"), text(F.col("p_size") % 11 * 1000).alias("r1"), root.alias("root"), (key % 2 == 0).alias("first"))


@query(_STATE + f" SELECT pool, {scaled_sql('by_reserves')} AS price, {scaled_sql('nullif(' + ONE + ' * ' + ONE + ' // by_reserves, 0)')} AS inverted FROM pr")
def reserves_price(v):
    rows = _states(v).select("pool", exact.price_of_reserves("r0", "r1", F.lit(6), F.lit(6)).alias("price"))
    return rows.withColumn("inverted", exact.inverted("price"))


@query(_STATE + f" SELECT pool, {scaled_sql('by_sqrt')} AS price, {scaled_sql('by_sqrt // 100')} AS cents FROM pr")
def sqrt_price(v):
    return _states(v).select("pool", exact.price_of_sqrt("root", F.lit(6), F.lit(6)).alias("price"), exact.price_of_sqrt("root", F.lit(6), F.lit(8)).alias("cents"))


@query(_STATE + f" SELECT pool, {scaled_sql('price')} AS price FROM pq")
def price_in_quote(v):
    """Price of the candidate in the quote token by the pool's own model."""
    return _states(v).select("pool", exact.price_in_quote("root", "r0", "r1", "first", F.lit(6), F.lit(6)).alias("price"))


@query(_STATE + f""", us AS (SELECT *, CASE WHEN pool % 5 <> 0 THEN nullif(price * 5 // 2, 0) END AS usd, CASE WHEN first THEN r0 ELSE r1 END AS b, CASE WHEN first THEN r1 ELSE r0 END AS q FROM pq)
    SELECT pool, {scaled_sql('usd')} AS price_usd, CASE WHEN pool % 4 <> 0 THEN {scaled_sql('nullif(CAST(pool * 1000 AS HUGEINT) * usd // 1000000, 0)')} END AS market_cap_usd, {scaled_sql('b * usd // 1000000 + q * 5 * ' + ONE + ' // 2 // 1000000')} AS liquidity_usd FROM us""")
def snapshot_metrics(v):
    """A snapshot's price, market cap and liquidity in dollars, from pool state, supply and the quote's price (2.5, or unknown)."""
    rows = _states(v).withColumn("quote_usd", F.when(F.col("pool") % 5 != 0, "2.5"))
    rows = rows.withColumn("price_usd", exact.to_usd(exact.price_in_quote("root", "r0", "r1", "first", F.lit(6), F.lit(6)), "quote_usd"))
    supply = F.when(F.col("pool") % 4 == 0, "0").otherwise((F.col("pool") * 1000).cast("string"))
    base, quote = (F.when(F.col("first"), a).otherwise(b) for a, b in ((F.col("r0"), F.col("r1")), (F.col("r1"), F.col("r0"))))
    return rows.select("pool", "price_usd", exact.market_cap(supply, F.lit(6), "price_usd").alias("market_cap_usd"), exact.liquidity(base, quote, F.lit(6), F.lit(6), "price_usd", "quote_usd").alias("liquidity_usd"))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 9 <> 0 THEN greatest(1e0 - (o_orderkey % 101) / 100e0 / pow(1e0 - fee, 2e0), 0e0) END, 9) AS tax
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN CASE o_orderkey % 4 WHEN 0 THEN 0.01e0 WHEN 1 THEN 0.003e0 WHEN 2 THEN 0.0005e0 ELSE 0.003e0 END ELSE 0.003e0 END AS fee FROM orders)""")
def token_tax(v):
    key = F.col("o_orderkey")
    dex = F.element_at(F.array(*map(F.lit, ("uniswap-v2", "uniswap-v3", "aerodrome"))), (key % 3 + 1).cast("int"))
    tier = F.when(key % 4 == 0, 10000).when(key % 4 == 1, 3000).when(key % 4 == 2, 500)
    return v.table("orders").select("o_orderkey", F.round(risk.token_tax(F.when(key % 9 != 0, (key % 101) / 100), dex, tier), 9).alias("tax"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS amount FROM events")
def last_amount(v):
    """The last word of an array of one to three amounts; an empty answer has none."""
    cents = F.round(F.col("value") * 100).cast("long")
    data = F.concat(F.lit("0x"), F.when(F.col("event_id") % 4 > 0, F.concat(F.repeat(_word(F.lit(9)), (F.col("event_id") % 4).cast("int")), _word(cents))).otherwise("00"))
    return v.table("events").select("event_id", decode.last_amount(data).alias("amount"))


@query("""SELECT p_partkey AS pool, CASE WHEN p_partkey % 3 = 1 THEN 'uniswap-v3' ELSE 'uniswap-v2' END AS dex, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size + 7 AS VARCHAR) END AS sqrt_price, CAST(p_partkey AS VARCHAR) AS reserve0, CAST(p_size AS VARCHAR) AS reserve1
    FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 3 <> 1""")
def pool_state(v):
    """Answers of one batch of calls; every fifth square-root price failed."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    hex_of = lambda *words: F.concat(F.lit("0x"), *map(_word, words))
    calls = v.table("part").select(key.alias("pool"), F.when(key % 3 == 1, "uniswap-v3").otherwise("uniswap-v2").alias("dex"), hex_of(key, size, F.lit(3)).alias("reserves"), F.when(key % 5 != 0, hex_of(size + 7, F.lit(1))).alias("slot0"), hex_of(key).alias("balance0"), hex_of(size).alias("balance1"))
    return decode.pool_states(calls)


@query("""SELECT s_suppkey AS token, CASE WHEN s_suppkey % 4 <> 0 THEN nullif(trim(s_name), '') END AS symbol, CASE WHEN s_suppkey % 6 <> 0 THEN concat('Token ', s_name) END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS INTEGER) END AS decimals,
    CASE WHEN s_suppkey % 5 = 0 THEN 'rate' END AS decimals_error, CASE WHEN s_suppkey % 7 = 0 THEN '0' ELSE CAST(s_suppkey AS VARCHAR) END AS total_supply FROM supplier""")
def token_metadata(v):
    key = F.col("s_suppkey")
    text = lambda x: F.concat(F.lit("0x"), _word(F.lit(32)), _word(F.length(x).cast("long")), F.rpad(F.hex(x), 128, "0"))
    calls = v.table("supplier").select(
        key.alias("token"), F.when(key % 4 != 0, text(F.col("s_name"))).otherwise("0x00").alias("symbol"), F.when(key % 6 != 0, text(F.concat(F.lit("Token \x07"), "s_name"))).alias("name"),
        F.when(key % 5 != 0, F.concat(F.lit("0x"), _word(F.col("s_nationkey").cast("long")))).alias("decimals"), F.when(key % 7 != 0, F.concat(F.lit("0x"), _word(key))).alias("supply"), F.lit("HTTP 429").alias("error"),
    )
    return decode.token_metadata(calls)


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'block_number' END, CASE WHEN event_id % 11 = 0 THEN 'tx_hash' END, CASE WHEN event_id % 13 = 0 THEN 'log_index' END) AS missing FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0""")
def log_rejects(v):
    """Logs without an identity."""
    key = F.col("event_id")
    logs = v.table("events").select("event_id", F.when(key % 7 != 0, key).alias("block_number"), F.when(key % 11 != 0, "0x1").alias("tx_hash"), F.when(key % 13 != 0, 0).alias("log_index"))
    return decode.rejected(logs).select("event_id", "missing")


@query("""SELECT o_orderkey AS token, k % 5 <> 0 AS can_buy, CASE WHEN k % 5 <> 0 THEN k % 7 <> 0 AND k % 3 <> 0 END AS can_sell, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN 0e0 WHEN k % 3 <> 0 THEN round((k % 1000) / 1000.0e0, 9) END AS retained,
    CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'execution reverted' ELSE 'buy reverted' END WHEN k % 7 = 0 THEN 'buy delivered zero tokens' WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'execution reverted' ELSE 'sell reverted' END END AS reason FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def round_trip(v):
    """Simulated purchases and sales: every fifth can't buy, every seventh gets nothing, every third can't sell."""
    key = F.col("o_orderkey")
    hex_of = lambda *words: F.concat(F.lit("0x"), *map(_word, words))
    calls = v.table("orders").select(
        key.alias("token"), F.lit("1000").alias("spent"), F.when(key % 5 != 0, "0x1").otherwise("0x0").alias("buy_status"), F.lit("0x1").alias("balance_status"), F.when(key % 7 != 0, hex_of(key)).otherwise("0x").alias("balance"),
        F.when(key % 3 != 0, "0x1").alias("sell_status"), hex_of(F.lit(32), F.lit(2), F.lit(1000), key % 1000).alias("sell_data"), F.when(key % 2 == 0, "execution reverted").alias("error"),
    )
    return decode.round_trips(calls).withColumn("retained", F.round("retained", 9))
