"""The ingestion tail: micro-batches of decoded swaps become trades, once each, and the watermark moves.

A reorganisation never rewinds a checkpoint: it is a retraction row, and readers leave out what it took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.upserts import insert_if_absent

from .ledger import RANGE, table


def silver(swaps: DataFrame, pools: DataFrame, blocks: DataFrame) -> DataFrame:
    """Trades of known pools in blocks of known time, with the side from the pool's view."""
    rows = swaps.join(pools.select("pool", "pool_id"), "pool").join(blocks.dropDuplicates(["block_number"]), "block_number")
    return rows.withColumn("side", F.when(F.col("amount0").startswith("-"), "OUT0").otherwise("OUT1"))


def writer(path: str, pools: DataFrame, blocks: DataFrame, keys: tuple[str, ...] = ("tx_hash", "log_index")):
    """For ``foreachBatch``: appends the rows of a batch whose key the table lacks, so a replayed batch adds nothing.

    The table has a folder a range of blocks; only those that a batch touches are read, so a batch costs the same however
    long the table has grown. A log stays in its block, so a key is never in another range.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = silver(batch, pools, blocks).withColumn("range", F.floor(F.col("block_number") / RANGE)).persist()
        try:
            touched = [r[0] for r in rows.select("range").distinct().collect()]  # a few ranges a batch
            old = table(batch.sparkSession, path)
            old = rows.select(*keys).limit(0) if old is None else old.filter(F.col("range").isin(touched)).select(*keys)
            order = sorted(set(rows.columns) - set(keys))
            insert_if_absent(old, rows, list(keys), order).write.mode("append").partitionBy("range").parquet(path)
        finally:
            rows.unpersist()

    return write


def watermark(runs: DataFrame) -> DataFrame:
    """By source: the time up to which every address batch of a drain succeeded; it never goes back.

    runs: source, drain, t, ok (null counts as failed).
    """
    whole = runs.groupBy("source", "drain").agg(F.min("t").alias("t"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    return whole.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("t"))).alias("watermark_t"))
