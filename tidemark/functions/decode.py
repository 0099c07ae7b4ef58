"""Chain logs to rows: pool creations, swaps and transfers, told apart by their first topic.

A log has address, topics (array of hex words), data (hex), block_number, tx_hash, log_index. Logs that are
pending (a null block, transaction or index) or of another kind are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact

#: First topics: hashes of the events' signatures (fixed values).
CREATED = {
    "0x0d3648bd0f6ba80134a33ba9275ac585d9d315f0ad8355cddefde31afa28d0e9": "uniswap-v2",
    "0x783cca1c0412dd0d695e784568c96da2e9c22ff989357a2e8b1d9b2b4e6b7118": "uniswap-v3",
    "0x2128d88d14c80cb081c1252a5acff7a264671bf199ce226b53788fb26065005e": "aerodrome",
}
SWAPPED = {
    "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822": "uniswap-v2",
    "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67": "uniswap-v3",
    "0xb3e2773606abfd36b5bd91394b3a54d1398336c65005baf7bf7a05efeffaf75b": "aerodrome",
}
TRANSFERRED = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55aeb4df523ef"


def word(i: int) -> Column:
    """The i-th 32-byte word of the data, as hex."""
    return F.substring("data", 3 + 64 * i, 64)


def address(hex_word: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(hex_word, F.lit(40))))


def topic(i: int) -> Column:
    return F.try_element_at("topics", F.lit(i + 1))


def _kinds(logs: DataFrame, names: dict[str, str]) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    sound = F.col("block_number").isNotNull() & F.col("tx_hash").isNotNull() & F.col("log_index").isNotNull()
    return logs.filter(sound).withColumn("dex", table[F.lower(topic(0))]).filter(F.col("dex").isNotNull())


def pools(logs: DataFrame) -> DataFrame:
    rows = _kinds(logs, CREATED)
    v3 = F.col("dex") == "uniswap-v3"
    number = lambda w: F.conv(F.right(w, F.lit(8)), 16, 10).cast("int")
    return rows.select("dex", address(F.when(v3, word(1)).otherwise(word(0))).alias("pool"), address(topic(1)).alias("token0"), address(topic(2)).alias("token1"), F.when(v3, number(topic(3))).alias("fee"), F.when(F.col("dex") == "aerodrome", number(topic(3)) == 1).alias("stable"), "block_number", F.lower("tx_hash").alias("tx_hash"), "log_index")


def swaps(logs: DataFrame) -> DataFrame:
    """Amounts from the pool's side: what came in less what went out, as text of any size."""
    rows = _kinds(logs, SWAPPED)
    v3 = F.col("dex") == "uniswap-v3"
    net = lambda i: F.when(v3, exact.word_signed(word(i))).otherwise(exact.difference(exact.word_unsigned(word(i)), exact.word_unsigned(F.when(~v3, word(i + 2)))))
    return rows.select("dex", F.lower("address").alias("pool"), address(F.coalesce(topic(2), topic(1))).alias("wallet"), net(0).alias("amount0"), net(1).alias("amount1"), "block_number", F.lower("tx_hash").alias("tx_hash"), "log_index")


def transfers(logs: DataFrame) -> DataFrame:
    rows = _kinds(logs, {TRANSFERRED: "transfer"}).filter((F.size("topics") == 3) & (F.length("data") >= 66))
    return rows.select(F.lower("address").alias("token"), address(topic(1)).alias("source"), address(topic(2)).alias("target"), exact.word_unsigned(word(0)).alias("value"), "block_number", F.lower("tx_hash").alias("tx_hash"), "log_index")


def last_amount(data: Column) -> Column:
    """The last 32-byte word of returned data (hex with its prefix) as text of any size; null if there is none."""
    body = F.substring(data, 3, 2**31 - 1)
    start = F.floor(F.length(body) / 64) * 64 - 64
    return exact.word_unsigned(F.when(F.length(body) >= 64, F.substring(body, start.cast("int") + 1, F.lit(64))))


def _text(data: Column) -> Column:
    """A returned string: a word with its place, a word with its length, its bytes. Null unless whole and valid."""
    body = F.substring(data, 3, 2**31 - 1)
    size = F.conv(F.substring(body, 121, 8), 16, 10).cast("long") * 2
    found = F.when((F.length(body) >= 128) & (F.length(body) >= 128 + size), F.substring(body, F.lit(129), size.cast("int")))
    return F.try_validate_utf8(F.unhex(found).cast("string"))


def pool_states(calls: DataFrame) -> DataFrame:
    """State of pools from one batch of calls' answers: reserves, or a square-root price and both balances.

    calls: pool, dex, and hex answers reserves, slot0, balance0, balance1 (null if a call failed). A pool whose
    answers lack a side has no row.
    """
    v3 = F.col("dex") == "uniswap-v3"
    nth = lambda c, i: exact.word_unsigned(F.when(F.length(c) >= 66 + 64 * i, F.substring(c, 3 + 64 * i, 64)))
    rows = calls.select("pool", "dex", F.when(v3, nth("slot0", 0)).alias("sqrt_price"), *(F.when(v3, nth(f"balance{i}", 0)).otherwise(nth("reserves", i)).alias(f"reserve{i}") for i in (0, 1)))
    return rows.filter("reserve0 IS NOT NULL AND reserve1 IS NOT NULL AND (dex <> 'uniswap-v3' OR sqrt_price IS NOT NULL)")


def token_metadata(calls: DataFrame) -> DataFrame:
    """Symbol and name (null if unreadable), decimals (null with its error class: read again later) and total supply ("0" if the call failed).

    calls: token, and hex answers symbol, name, decimals, supply (null if a call failed), error (of the decimals call).
    """
    from . import text

    decimals = F.when(F.length("decimals") >= 66, F.conv(F.substring("decimals", 59, 8), 16, 10).cast("int"))
    supply = exact.word_unsigned(F.when(F.length("supply") >= 66, F.substring("supply", 3, 64)))
    return calls.select(
        "token", *(text.sanitize(_text(F.col(c))).alias(c) for c in ("symbol", "name")), decimals.alias("decimals"),
        F.when(decimals.isNull(), text.error_class(F.col("error"))).alias("decimals_error"), F.coalesce(supply, F.lit("0")).alias("total_supply"),
    )


def rejected(logs: DataFrame) -> DataFrame:
    """Logs that can't be told apart from others, with what they lack: block, transaction or index."""
    lacks = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ("block_number", "tx_hash", "log_index"))))
    return logs.withColumn("missing", F.array_join(lacks, ",")).filter("missing <> ''")


def round_trips(calls: DataFrame) -> DataFrame:
    """What a simulated purchase and sale came to: can_buy, can_sell, retained (share of what was spent), reason.

    calls: token, spent (text), and answers buy_status, balance_status, balance, sell_status, sell_data, error. A purchase that
    didn't go through proves nothing about selling; one that delivered nothing, or that can't be sold, does.
    """
    went = lambda c: F.coalesce(F.col(c) == "0x1", F.lit(False))
    bought, sold = went("buy_status"), went("sell_status")
    held = exact.word_unsigned(F.when(went("balance_status") & (F.length("balance") > 2), F.substring("balance", 3, 64)))
    rows = calls.withColumns({"_held": F.coalesce(held, F.lit("0")), "_back": F.coalesce(last_amount(F.col("sell_data")), F.lit("0"))})
    empty = F.col("_held") == "0"
    share = F.col("_back").cast("double") / F.nullif(F.col("spent").cast("double"), F.lit(0.0))
    reason = F.when(~bought, F.coalesce("error", F.lit("buy reverted"))).when(empty, "buy delivered zero tokens").when(~sold, F.coalesce("error", F.lit("sell reverted")))
    return rows.select("token", bought.alias("can_buy"), F.when(bought, ~empty & sold).alias("can_sell"), F.when(bought & empty, 0.0).when(bought & sold, share).alias("retained"), reason.alias("reason"))
