"""Sinks as set operations: insert if absent, monotone cursors, gaps, rollbacks, guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import first_by


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: the first of each key that ``old`` lacks."""
    rest = [c for c in new.columns if c not in keys]
    return first_by(new, keys, order, rest).join(old.select(*keys).distinct(), keys, "left_anti")


def advance(states: DataFrame, by: str) -> DataFrame:
    """Monotone cursors from all reports: highest block and time, and the last hash reported for that block.

    states: block, t, hash, seq. The hash is null if the block advanced without one.
    """
    top = F.max(F.struct(F.col("block"), F.when(F.col("hash").isNull(), -1).otherwise(F.col("seq")).alias("seq"), F.col("hash"))).alias("_top")
    return states.groupBy(by).agg(F.max("t").alias("t"), top).select(by, F.col("_top.block").alias("block"), "t", F.col("_top.hash").alias("hash"))


def reseed(cursors: DataFrame, target: Column) -> DataFrame:
    """Cursors skipped forward; the time stays, the hash goes."""
    ahead = target > F.col("block")
    return cursors.withColumns({"hash": F.when(~ahead, F.col("hash")), "block": F.when(ahead, target).otherwise(F.col("block"))})


def rewind(cursors: DataFrame, block: Column, t: Column) -> DataFrame:
    return cursors.withColumns({"block": block, "t": t, "hash": F.lit(None).cast("string")})


def plan_range(cursor: Column, head: Column, confirmations: int, backfill: int, overlap: int, first: Column) -> tuple[Column, Column]:
    """Blocks to fetch next, both ends included: from the cursor (some again on the first drain) or a backfill."""
    safe = F.greatest(head - confirmations, F.lit(0))
    start = F.when(cursor.isNull(), F.greatest(safe - backfill, F.lit(0))).otherwise(F.greatest(cursor + 1 - F.when(first, overlap).otherwise(0), F.lit(0)))
    return start, safe


def chunk_range(start: Column, end: Column, size: int) -> Column:
    """Chunks [from, to] of at most ``size`` blocks; none where the end is before the start."""
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    starts = F.when(end >= start, F.sequence(start, F.greatest(end, start), F.lit(size).cast("long")))
    return F.when(end >= start, F.transform(starts, lambda x: F.struct(x.alias("from"), F.least(x + size - 1, end).alias("to")))).otherwise(none)


def reorg(cursors: DataFrame, observed: DataFrame, depth: int = 32) -> DataFrame:
    """Cursors whose hash differs from the chain's at their block, and where to go back to. An unknown hash can't tell."""
    met = cursors.join(observed.select("block", F.col("hash").alias("seen")), "block")
    return met.filter(F.col("hash") != F.col("seen")).withColumn("back_to", F.greatest(F.col("block") - depth, F.lit(0)))


def rolled_back(rows: DataFrame, events: DataFrame, width: int = 10_000) -> DataFrame:
    """Rows that no rollback took away: those of later blocks that were written before it are gone.

    A rollback concerns the rest of its own range of ``width`` blocks, row by row, and all later ranges whole, where only the
    last time counts: both meet by equality of the range.
    """
    block = lambda c: F.floor(F.col(c) / width)
    last = rows.agg(F.max("block_number").alias("_last"))  # one row
    marked = events.select("rewound", "occurred_t", block("rewound").alias("_range"))
    later = marked.crossJoin(F.broadcast(last)).filter(F.col("_range") < block("_last")).select(F.explode(F.sequence(F.col("_range") + 1, block("_last"))).alias("_range"), "occurred_t").groupBy("_range").agg(F.max("occurred_t").alias("occurred_t"))
    left = rows.withColumn("_range", block("block_number")).alias("x")
    kept = left.join(later.alias("r"), (F.col("x._range") == F.col("r._range")) & (F.col("created_t") <= F.col("occurred_t")), "left_anti").alias("x")
    gone = (F.col("x._range") == F.col("r._range")) & (F.col("block_number") > F.col("rewound")) & (F.col("created_t") <= F.col("occurred_t"))
    return kept.join(marked.alias("r"), gone, "left_anti").drop("_range")


def backfilled_gaps(gaps: DataFrame, block: Column, t: Column) -> DataFrame:
    """Gaps that the tail has passed get their end time; known ends stay."""
    return gaps.withColumn("to_t", F.when(F.col("to_t").isNull() & (F.col("to_block") <= block), t).otherwise(F.col("to_t")))


def alert_status(status: Column, delivered: Column) -> Column:
    """Only a pending alert becomes sent or failed."""
    return F.when(status == "PENDING", F.when(delivered, "SENT").otherwise("FAILED")).otherwise(status)
