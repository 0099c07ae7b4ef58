"""Trade windows anchored at arbitrary times: (end - length, end]."""

from __future__ import annotations

import decimal
import math
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType


def oriented(trades: DataFrame, base_is_token0) -> DataFrame:
    """Trades with base and quote amounts and the side as seen by a buyer of the base token."""
    base, quote = F.when(base_is_token0, F.col("amount0")).otherwise(F.col("amount1")), F.when(base_is_token0, F.col("amount1")).otherwise(F.col("amount0"))
    rows = trades.withColumns({"base_is_token0": base_is_token0, "base_amount": F.abs(base), "quote_amount": F.abs(quote)})
    return rows.withColumn("trade_side", F.when(base < 0, "BUY").otherwise("SELL"))


_FOUND = ("buys", "sells", "unique_buyers", "quote_volume")
CELL = 4  # lengths of a window in a cell of time: a trade in four goes to the next cell too


def _swept(length: int, names: list[str], volume: pa.DataType):
    """A task's windows. Rows come by pool and cell in the order of time, trades before the anchors of their time; each trade enters and leaves once."""
    summed = pa.types.is_floating(volume)  # of floats nothing is taken away again

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal.getcontext().prec = 80
        key, inside = None, deque()
        for batch in batches:
            pools, cells, times, bases, sides, wallets, firsts, seconds = (batch.column(i).to_pylist() for i in range(8))
            kinds = batch.column(8).to_pylist()
            rows, found = [], []
            for i, anchor in enumerate(kinds):
                if (pools[i], cells[i]) != key:
                    key = pools[i], cells[i]
                    inside.clear()
                    known, of, who, totals, amounts = 0, defaultdict(int), defaultdict(dict), [0, 0], [0, 0]
                now = times[i]
                while inside and inside[0][0] <= now - length:
                    _, side, wallet, first, second = inside.popleft()
                    if side is not None:
                        known -= 1
                        of[side] -= 1
                        if wallet is not None:
                            held = who[side]
                            if held[wallet] > 1:
                                held[wallet] -= 1
                            else:
                                del held[wallet]
                    if first is not None:
                        amounts[0] -= 1
                        totals[0] -= abs(first)
                    if second is not None:
                        amounts[1] -= 1
                        totals[1] -= abs(second)
                if anchor:
                    buy, side = (1, "OUT0") if bases[i] else (0, "OUT1")
                    total = totals[buy] if amounts[buy] else None
                    if summed and total is not None:
                        total = math.fsum(abs(x[3 + buy]) for x in inside if x[3 + buy] is not None)
                    rows.append(i)
                    found.append((of[side], known - of[side], len(who[side]), total))
                else:
                    side, wallet, first, second = sides[i], wallets[i], firsts[i], seconds[i]
                    inside.append((now, side, wallet, first, second))
                    if side is not None:
                        known += 1
                        of[side] += 1
                        if wallet is not None:
                            held = who[side]
                            held[wallet] = held.get(wallet, 0) + 1
                    if first is not None:
                        amounts[0] += 1
                        totals[0] += abs(first)
                    if second is not None:
                        amounts[1] += 1
                        totals[1] += abs(second)
            if rows:
                carried = batch.column(9).take(pa.array(rows)).flatten()
                yield pa.RecordBatch.from_arrays([*carried, *(pa.array([f[j] for f in found], volume if j == 3 else pa.int64()) for j in range(4))], [*names, *_FOUND])

    return sweep


def _windows(trades: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """Each anchor (pool_id, base_is_token0, and end, the last time of its window) with what is in its window.

    Rows go to cells of time by pool, an anchor to that of its window's end and a trade to its own and, near its end, the next. They
    are swept in order, so the work grows with the rows, not with the pairs of anchors and trades, and a hot pool is spread over its cells.
    """
    cell = lambda x: F.floor(x / (CELL * length))
    volume = trades.agg(F.sum(F.abs(F.when(F.lit(True), F.col("amount1")).otherwise(F.col("amount0")))).alias("v")).schema["v"].dataType
    spread = F.explode(F.sequence(cell(F.col("t")), cell(F.col("t") + length - 1)))
    points = trades.filter(F.col("pool_id").isNotNull() & F.col("t").isNotNull()).select("pool_id", spread.alias("_cell"), "t", F.lit(None).cast("boolean").alias("_base"), "side", "wallet", "amount0", "amount1", F.lit(False).alias("_is"))
    ends = anchors.select("pool_id", cell(F.col("end")).alias("_cell"), F.col("end").alias("t"), F.col("base_is_token0").alias("_base"), F.lit(True).alias("_is"), F.struct(*anchors.columns).alias("_anchor"))
    rows = points.unionByName(ends, allowMissingColumns=True)
    fields = [*anchors.schema.fields, *(StructField(c, LongType()) for c in _FOUND[:3]), StructField(_FOUND[3], volume)]
    return rows.repartition("pool_id", "_cell").sortWithinPartitions("pool_id", "_cell", "t", "_is").mapInArrow(_swept(length, anchors.columns, to_arrow_type(volume)), StructType(fields))


def trade_window(trades: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """buys, sells, unique_buyers and quote_volume of the window that ends at each anchor (pool_id, at, base_is_token0).

    An empty window has counts of 0 and a null volume.
    """
    return _windows(trades, anchors.withColumn("end", F.col("at")), length).drop("end")


def consecutive_windows(trades: DataFrame, anchors: DataFrame, length: int, n: int) -> DataFrame:
    """The n windows before each anchor, number 0 being the last one; empty ones appear."""
    every = anchors.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return _windows(trades, every.withColumn("end", F.col("at") - F.col("k") * length), length).drop("end")
