"""Forward returns of signals at fixed horizons, measured for all (signal, horizon) pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exact

from .joins import nearest, overlapping

#: Horizons in minutes (fixed values).
HORIZONS = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "24h": 1440}
MINUTE = 60_000_000
RETURN_LIMIT = 1e14  # percent that a stored return can hold


def pairs(signals: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """One row for each signal and horizon, with its window (both ends belong to it)."""
    table = F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.lit(v * MINUTE).cast("long").alias("span")) for k, v in horizons.items())))
    return signals.withColumn("_h", table).select(*signals.columns, "_h.horizon", "_h.span").withColumnsRenamed({"t": "start"}).withColumn("end", F.col("start") + F.col("span"))


def trade_price() -> Column:
    """Price of a trade from its own amounts; null without base amount or at zero."""
    return F.nullif(F.try_divide(F.abs(F.col("amount1")).cast("double"), F.abs(F.col("amount0")).cast("double")), F.lit(0.0))


def price_series(trades: DataFrame, quotes: DataFrame, max_age: int) -> DataFrame:
    """Trades with trade_price: dollars for a unit of the base token, exact to 18 places; null where it can't be known.

    trades: trade_id (of a row), pool_id, t, block_number, log_index, amount0, amount1 (signed), base_is_token0, base_decimals,
    quote_decimals, fixed_usd (text, or null) and quote_token; quotes: token_id, t, price (text). Without a fixed rate the
    nearest sample within ``max_age`` counts. A trade that moved none of the base token prices nothing.
    """
    amount = lambda first: F.when(F.col("base_is_token0") == first, F.col("amount0")).otherwise(F.col("amount1")).cast("string")
    asked = trades.filter("fixed_usd IS NULL").select(F.col("quote_token").alias("token_id"), "trade_id", F.col("t").alias("at"))
    rates = nearest(asked, quotes.select("token_id", "t", F.col("price").alias("_rate")), ["token_id"], "trade_id", "_rate", max_age)
    rows = trades.join(rates.select("trade_id", "_rate"), "trade_id", "left")
    price = exact.fused_usd(amount(True), amount(False), F.col("base_decimals"), F.col("quote_decimals"), F.coalesce("fixed_usd", "_rate"))
    return rows.withColumn("trade_price", price.cast("decimal(38,18)")).drop("_rate")


def _merged(n, priced, last, high, low, created) -> list[Column]:
    return [F.sum(n).alias("n"), F.sum(priced).alias("priced"), F.max(last).alias("last"), F.max(high).alias("high"), F.min(low).alias("low"), F.max(created).alias("created")]


_PARTS = ("n", "priced", "last", "high", "low", "created")


def outcome_path(windows: DataFrame, trades: DataFrame) -> DataFrame:
    """trades, priced, last, highest and lowest price within each window, and when its last row was written; a pair without trades has zeros and nulls.

    Trades (pool_id, t, block_number, log_index, created_t, trade_price) are summed up by minute, minutes by hour. A window takes the whole
    hours within it, the whole minutes before and after those, and trades one by one only in the minutes that it cuts, so
    what meets a window is bounded by its length however many trades a pool has; all horizons go through the same three
    joins, each by equality of pool and minute, hour or day.
    """
    order = F.struct("block_number", "log_index", F.col("trade_price").alias("price"))
    known = F.col("trade_price").isNotNull()
    points = trades.select("pool_id", "t", F.expr(f"t div {MINUTE}").alias("minute"), F.lit(1).cast("long").alias("n"), known.cast("long").alias("priced"), F.when(known, order).alias("last"), F.col("trade_price").alias("high"), F.col("trade_price").alias("low"), F.col("created_t").alias("created"))
    minutes = points.groupBy("pool_id", "minute").agg(*_merged(*_PARTS)).withColumn("hour", F.expr("minute div 60"))
    hours = minutes.groupBy("pool_id", "hour").agg(*_merged(*_PARTS)).withColumn("day", F.expr("hour div 24"))
    key = ["signal_id", "horizon"]
    # whole minutes [m, n) and whole hours [g, h) of a window
    w = windows.select(*key, "pool_id", "start", "end", F.expr(f"(start + {MINUTE - 1}) div {MINUTE}").alias("m"), F.expr(f"(end + 1) div {MINUTE}").alias("n"))
    w = w.withColumns({"g": F.expr("(m + 59) div 60"), "h": F.expr("n div 60")})
    edges = lambda first, last, a, b: F.explode(F.array_distinct(F.filter(F.array(first, last), lambda c: (a >= b) | (c < a) | (c >= b))))
    m, n, g, h = (F.col(c) for c in "mngh")
    cut = w.select(*key, "pool_id", "start", "end", edges(F.expr(f"start div {MINUTE}"), F.expr(f"end div {MINUTE}"), m, n).alias("minute"))
    part = w.filter(m < n).select(*key, "pool_id", F.col("m").alias("first"), F.col("n").alias("past"), edges(F.expr("m div 60"), F.expr("(n - 1) div 60"), g, h).alias("hour"))
    full = w.filter(g < h).select(*key, "pool_id", F.col("g").alias("first"), F.col("h").alias("past"), F.explode(F.sequence(F.expr("g div 24"), F.expr("(h - 1) div 24"))).alias("day"))
    met = [
        cut.join(points, ["pool_id", "minute"]).filter(F.col("t").between(F.col("start"), F.col("end"))),
        part.join(minutes, ["pool_id", "hour"]).filter((F.col("minute") >= F.col("first")) & (F.col("minute") < F.col("past"))),
        full.join(hours, ["pool_id", "day"]).filter((F.col("hour") >= F.col("first")) & (F.col("hour") < F.col("past"))),
    ]
    # each window is a row of its own, with nothing in it, so no join with the windows is needed
    own = [c for c in windows.columns if c not in key]
    rows = windows.select(*key, F.struct(*own).alias("_own"))
    for found in met:
        rows = rows.unionByName(found.select(*key, *_PARTS), allowMissingColumns=True)
    whole = rows.groupBy(*key).agg(F.first("_own", ignorenulls=True).alias("_own"), *_merged(*_PARTS))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return whole.select(*key, "_own.*", zero(F.col("n")).alias("trade_count"), zero(F.col("priced")).alias("priced_count"), F.col("last.price").alias("last_price"), F.col("high").alias("max_price"), F.col("low").alias("min_price"), F.col("created").alias("last_created_t"))


def metrics(paths: DataFrame, least_priced: float = 0.8) -> DataFrame:
    """return_pct, max_runup_pct, max_drawdown_pct and the reason why they are null.

    The signal's own price leads the path. No trades means no move: three zeros.
    """
    p = F.col("price")
    pct = lambda x: (x - p) / p * 100
    share = F.try_divide(F.col("priced_count").cast("double"), F.col("trade_count").cast("double"))
    moved = pct(F.col("last_price"))
    reason = F.when(p.isNull() | (p <= 0), "no_signal_price").when(F.col("trade_count") == 0, F.lit(None)).when(share < least_priced, "insufficient_quote_coverage").when(F.abs(moved) > RETURN_LIMIT, "return_out_of_range")
    rows = paths.withColumn("failure_reason", reason)
    measured, quiet = F.col("failure_reason").isNull(), F.col("trade_count") == 0
    value = lambda x: F.when(measured, F.when(quiet, F.lit(0.0)).otherwise(x))
    return rows.withColumns({"return_pct": value(moved), "max_runup_pct": value(pct(F.greatest("max_price", "price"))), "max_drawdown_pct": value(pct(F.least("min_price", "price")))})


def coverage_decision(end: Column, watermark: Column, now: Column, defer: int, most: int) -> Column:
    """ready, defer or give_up: whether the tail has provably passed a window's end. An unknown watermark hasn't."""
    return F.when(watermark.isNotNull() & (watermark >= end), "ready").when(now - end < most, "defer").otherwise("give_up")


def due(windows: DataFrame, outcomes: DataFrame, now: Column | int) -> DataFrame:
    """Pairs whose window is over and that have no outcome."""
    return windows.filter(F.col("end") <= now).join(outcomes.select("signal_id", "horizon"), ["signal_id", "horizon"], "left_anti")


def damaged(outcomes: DataFrame, rollbacks: DataFrame, width: int) -> DataFrame:
    """Outcomes to measure again and why: reorg, then incomplete, then late.

    outcomes: signal_id, horizon, start, end, evaluated_t, failure_reason and last_created_t (when the last trade of the window was
    written, which is late after the evaluation); rollbacks: from_t, to_t, occurred_t. Both meet in time buckets of ``width``.
    """
    key = ["signal_id", "horizon"]
    reorg = overlapping(outcomes, rollbacks.select("from_t", "to_t", "occurred_t"), width, F.col("occurred_t") > F.col("evaluated_t")).select(*key).distinct().withColumn("reorg", F.lit(1))
    reason = F.when(F.col("reorg") == 1, "reorg").when(F.col("failure_reason") == "incomplete_tail_coverage", "incomplete").when(F.col("last_created_t") > F.col("evaluated_t"), "late")
    return outcomes.join(reorg, key, "left").withColumn("repair", reason).filter(F.col("repair").isNotNull())


def repair(old: DataFrame, new: DataFrame, values: list[str]) -> DataFrame:
    """Insert or replace by (signal_id, horizon): replaced rows take the new values and the next revision."""
    key = ["signal_id", "horizon"]
    fresh = new.select(*key, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_new"))
    rows = old.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")
    take = {v: F.when(F.col("_new"), F.col(f"_{v}")).otherwise(F.col(v)) for v in values}
    take["revision"] = F.when(F.col("_old").isNull(), 0).when(F.col("_new"), F.col("revision") + 1).otherwise(F.col("revision")).cast("long")
    return rows.withColumns(take).select(*key, *values, "revision")
