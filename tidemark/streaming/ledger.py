"""Transfers to balances, each transfer once: a ledger of what was applied, and a batch's net changes.

Both are tables with a folder a batch. A batch that is run again writes its folders anew from what earlier batches hold, so
neither a replayed batch nor blocks that are read twice count twice. Balances are the fold of all batches' changes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import holders

#: Addresses that hold nothing (fixed values): zero and the dead address.
NOBODY = ["0x0000000000000000000000000000000000000000", "0x000000000000000000000000000000000000dead"]
RANGE = 10_000  # blocks of a ledger folder
KEY = ["tx_hash", "log_index"]


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or none where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def writer(path: str, tokens: DataFrame, blocks: DataFrame):
    """For ``foreachBatch`` over decoded transfers (token, source, target, value, block_number, tx_hash, log_index).

    tokens: token, token_id; blocks: block_number, t. A transfer of an unknown token or block is claimed without a change.
    Only ledger folders of the block ranges that a batch touches are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("range", F.floor(F.col("block_number") / RANGE)).dropDuplicates(KEY).persist()
        try:
            touched = [r[0] for r in rows.select("range").distinct().collect()]  # a few ranges a batch
            done = table(spark, f"{path}/ledger")
            if done is not None:
                done = done.filter((F.col("batch") < number) & F.col("range").isin(touched)).select(*KEY)
                fresh = rows.join(done, KEY, "left_anti")
            else:
                fresh = rows
            known = fresh.join(tokens.select("token", "token_id"), "token").join(blocks.dropDuplicates(["block_number"]).select("block_number", "t"), "block_number")
            changes = holders.netted(known).filter(~F.col("wallet").isin(NOBODY))
            # changes first: the ledger's folder is what makes a batch count as done
            changes.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
            fresh.select(*KEY, "range").write.mode("overwrite").partitionBy("range").parquet(f"{path}/ledger/batch={number}")
        finally:
            rows.unpersist()

    return write


def appender(path: str):
    """For ``foreachBatch``: an append-only table with a folder a batch; history is never rewritten, a replayed batch takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def balances(spark: SparkSession, path: str) -> DataFrame | None:
    """token_id, wallet, balance (text), partially_observed after all batches."""
    changes = table(spark, f"{path}/changes")
    return None if changes is None else holders.balances(changes.select("token_id", "wallet", "batch", "change"))
