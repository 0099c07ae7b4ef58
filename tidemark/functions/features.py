"""Pool features as column expressions. What can't be measured is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import nearest


def growth(now: Column, past: Column) -> Column:
    """Relative change; null where the past is under 1 or unknown."""
    return F.when(past >= 1, (now - past) / past)


def cap_to_liquidity(cap: Column, liquidity: Column) -> Column:
    return F.when(cap.isNotNull() & liquidity.isNotNull(), cap / F.greatest(liquidity, F.lit(1.0)))


def acceleration(now: Column, priors: list[Column], least: int = 3) -> Column:
    """Volume against the mean of the first ``least`` known priors; null with fewer or without volume in them."""
    known = F.filter(F.array(*priors), lambda x: x.isNotNull())
    mean = F.aggregate(F.slice(known, 1, least), F.lit(0.0), lambda a, x: a + x) / least
    return F.when((F.size(known) >= least) & (mean > 0), F.try_divide(now, mean))


def buy_sell_ratio(buys: Column, sells: Column) -> Column:
    return F.when(buys + sells > 0, buys.cast("double") / F.greatest(sells, F.lit(1)))


def velocity(buys: Column, sells: Column, minutes: float) -> Column:
    return (buys + sells).cast("double") / minutes if minutes > 0 else F.lit(None).cast("double")


def buyer_growth(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before).cast("double") / before)


def holder_rate(now: Column, before: Column, minutes: Column) -> Column:
    """New holders a minute since the last reading."""
    return F.when(minutes > 0, (now - before) / minutes)


def wallet_score(parts: list[Column]) -> Column:
    """Weighted quality of a wallet in 0..1; what isn't finite counts as 0. Weights are fixed values."""
    total = F.lit(0.0)
    for x, weight in zip(parts, (0.20, 0.15, 0.20, 0.25, 0.20)):
        sound = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        total = total + F.when(sound, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0) * weight
    return total


def stability(snapshots: DataFrame, span: int = 30 * 86_400_000_000) -> DataFrame:
    """By pool: 1 less the mean relative step between positive liquidity readings, in 0..1.

    Null under three such readings; 0 if the last reading of all is missing or not positive. Steps are taken within
    spans of time, so that a pool's history is never ordered in one task, and from each span's last reading to the next one's first.
    """
    rows = snapshots.withColumns({"_span": F.floor(F.col("t") / span), "_x": F.when(F.col("liquidity") > 0, F.col("liquidity"))})
    place = F.struct("t", "snapshot_id")
    before = F.last("_x", ignorenulls=True).over(Window.partitionBy("pool_id", "_span").orderBy("t", "snapshot_id").rowsBetween(Window.unboundedPreceding, -1))
    step = lambda x, y: F.abs(x - y) / y
    known = F.when(F.col("_x").isNotNull(), place)
    spans = rows.withColumn("_step", step(F.col("_x"), before)).groupBy("pool_id", "_span").agg(
        F.count("_x").alias("n"), F.sum("_step").alias("steps"), F.min_by("_x", known).alias("first"), F.max_by("_x", known).alias("end"), F.max_by("liquidity", place).alias("last")
    )
    ends = F.last("end", ignorenulls=True).over(Window.partitionBy("pool_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    whole = spans.withColumn("_cross", step(F.col("first"), ends)).groupBy("pool_id").agg(F.sum("n").alias("readings"), (F.coalesce(F.sum("steps"), F.lit(0.0)) + F.coalesce(F.sum("_cross"), F.lit(0.0))).alias("total"), F.max_by("last", "_span").alias("last"))
    calm = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.try_divide(F.col("total"), F.col("readings") - 1)))
    value = F.when(F.col("readings") < 3, F.lit(None)).when(F.col("last").isNull() | (F.col("last") <= 0), 0.0).otherwise(calm)
    return whole.select("pool_id", value.alias("stability"))


def liquidity_growth(snapshots: DataFrame, back: int, tolerance: int) -> DataFrame:
    """Growth of each snapshot's liquidity since the reading nearest to ``back`` before it."""
    rows = snapshots.withColumn("at", F.col("t") - back)
    past = snapshots.filter(F.col("liquidity").isNotNull()).select("pool_id", "t", F.col("liquidity").alias("past"))
    met = nearest(rows, past, ["pool_id"], "snapshot_id", "past", tolerance)
    return met.select("snapshot_id", growth(F.col("liquidity"), F.col("past")).alias("liquidity_growth"))
