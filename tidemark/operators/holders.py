"""Holder balances from transfers, concentration, retention, clusters of wallets, smart money."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exact

from .joins import first_by, top_by


def unique_transfers(transfers: DataFrame) -> DataFrame:
    """One row a (tx, log_index): the first by its other columns."""
    rest = ["token_id", "source", "target", "value", "t"]
    return first_by(transfers, ["tx", "log_index"], rest, rest)


def netted(transfers: DataFrame, *by: str) -> DataFrame:
    """Net change of each (token, wallet): what came in less what went out, last block time and first seen.

    Values may be whole numbers of any Spark type, or text up to 256 bits; the change is exact and of the same kind.
    """
    text = dict(transfers.dtypes)["value"] == "string"
    gone = F.when(F.col("value").startswith("-"), F.substring("value", 2, 100)).otherwise(F.concat(F.lit("-"), "value")) if text else -F.col("value")
    legs = F.explode(F.array(F.struct(F.col("target").alias("wallet"), F.col("value").alias("change")), F.struct(F.col("source").alias("wallet"), gone.alias("change"))))
    rows = transfers.withColumn("_leg", legs).select("token_id", *by, "t", "_leg.*").groupBy("token_id", "wallet", *by)
    times = F.max("t").alias("last_t"), F.min("t").alias("first_t")
    if not text:
        return rows.agg(F.sum("change").alias("change"), *times)
    sums = rows.agg(*exact.limb_sums(F.col("change")), *times)
    limbs = [f"_limb{i}" for i in range(exact.LIMBS)]
    return sums.withColumn("change", exact.joined(F.array(*limbs))).select("token_id", "wallet", *by, "change", "last_t", "first_t")


def balances(changes: DataFrame) -> DataFrame:
    """Balance after all batches, clamped at zero after each, and whether it ever was.

    Clamping as one goes equals the running sum less its running minimum below zero, so two window
    functions do for the loop. changes: token_id, wallet, batch, change; text changes are folded exactly (``_folded``).
    """
    if dict(changes.dtypes)["change"] == "string":
        return _folded(changes)
    order = Window.partitionBy("token_id", "wallet").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    rows = changes.withColumn("sum", F.sum("change").over(order))
    totals = rows.groupBy("token_id", "wallet").agg(F.max_by("sum", "batch").alias("sum"), F.min("sum").alias("low"))
    return totals.select("token_id", "wallet", (F.col("sum") - F.least(F.col("low"), F.lit(0))).alias("balance"), (F.col("low") < 0).alias("partially_observed"))


def _folded(changes: DataFrame) -> DataFrame:
    """``balances`` of text: sorted by wallet and batch, a task goes through its rows once and keeps two numbers of the wallet at hand."""
    types = dict(changes.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, low = None, 0, 0
        done = []
        for frame in frames:
            for token, wallet, change in zip(frame["token_id"], frame["wallet"], frame["change"]):
                if (token, wallet) != at:
                    if at is not None:
                        done.append((*at, str(total - low), low < 0))
                    at, total, low = (token, wallet), 0, 0
                total += int(change)
                low = min(low, total)
            yield pd.DataFrame(done, columns=names)
            done = []
        if at is not None:
            yield pd.DataFrame([(*at, str(total - low), low < 0)], columns=names)

    names = ["token_id", "wallet", "balance", "partially_observed"]
    ordered = changes.select("token_id", "wallet", "batch", "change").repartition("token_id", "wallet").sortWithinPartitions("token_id", "wallet", "batch")
    return ordered.mapInPandas(fold, f"token_id {types['token_id']}, wallet {types['wallet']}, balance string, partially_observed boolean")


def eligible(holders: DataFrame, excluded: DataFrame, dust: int = 0) -> DataFrame:
    """Holders above dust that are neither pools nor on the exclusion list (wallet)."""
    return holders.filter(F.col("balance") > dust).join(excluded.select("wallet").distinct(), "wallet", "left_anti")


def concentration(holders: DataFrame, supply: DataFrame, n: int = 10) -> DataFrame:
    """Share of supply of the n largest holders, cut to six places; null without supply or holders."""
    top = top_by(holders, ["token_id"], [F.desc("balance"), F.col("wallet")], n).groupBy("token_id").agg(F.sum("balance").alias("held"))
    share = F.floor(F.col("held").cast("decimal(38,0)") * 1_000_000 / F.nullif(F.col("supply"), F.lit(0)).cast("decimal(38,0)")).cast("double") / 1_000_000
    return supply.join(top, "token_id", "left").select("token_id", F.when(F.col("supply") > 0, share).alias("concentration"))


def retention(cohort: DataFrame, cutoff: int, dust: int = 0) -> DataFrame:
    """Of holders who acquired by the cutoff: the share that still holds; null without a cohort."""
    early = cohort.filter(F.col("first_t") <= cutoff).groupBy("token_id").agg(F.count("*").alias("_n"), F.count_if(F.col("balance") > dust).alias("_kept"))
    return cohort.select("token_id").distinct().join(early, "token_id", "left").select("token_id", F.try_divide(F.col("_kept").cast("double"), F.col("_n").cast("double")).alias("retention"))


def within_tolerance(a: Column, b: Column, tolerance: float) -> Column:
    """Amounts alike: relative difference, cut to six places, of at most ``tolerance``; zero is like zero alone."""
    large, small = F.greatest(a, b), F.least(a, b)
    gap = F.floor((large - small) * 1_000_000 / F.nullif(large, F.lit(0))).cast("double") / 1_000_000
    return F.when(a == b, True).when((a == 0) | (b == 0), False).otherwise(gap <= tolerance)


#: Wider than what the tolerance spans, so that few rows are copied: widths of a cell in proximities, of a class of amounts on a logarithmic scale.
CELL, CLASS = 8, 1.0
PAIRS = 1 << 20  # pairs held at once
LIST = 1 << 14  # wallets of an anchor in one list


def _like(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """``within_tolerance`` of arrays of longs."""
    large, small = np.maximum(a, b), np.minimum(a, b)
    safe = max(np.abs(large).max(initial=0), np.abs(small).max(initial=0)) < 4 * 10**12
    gap = (large - small) * 1_000_000 if safe else (large.astype(float) - small) * 1e6
    return (a == b) | ((a != 0) & (b != 0) & (np.floor(gap / np.where(large == 0, 1, large)) / 1_000_000 <= tolerance))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first two columns, a table for each pair of values."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if held and key != tuple(keys[:, lo]):
                    yield pa.Table.from_batches(held)
                    held = []
                key = tuple(keys[:, lo])
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _met(proximity: int, tolerance: float, least: int | None, first: bool = False):
    """A task's pairs as rows (anchor, wallets), lists of up to ``LIST``. With ``least``: each wallet once, the anchor with them, anchors of as many wallets alone.

    Anchors go by amount, their wallets from the last by time and wallet: lists that follow each other then begin alike, which a file's compression
    takes out. As files pack numbers by eights, what a list has beyond a multiple of eight comes after all lists.
    With ``first``: of each wallet's anchors in a cell and class the first as text alone, so rows are no more than those that came.
    """
    width, slack = max(proximity, 1), 1 - tolerance - 4e-6

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            table = table.sort_by([("t", "ascending"), ("wallet", "ascending")]).combine_chunks()
            own, t, value = (table[c].to_numpy() for c in ("own", "t", "value"))
            wallets = table["wallet"].combine_chunks()
            rank, unknown = pc.rank(wallets, null_placement="at_start", tiebreaker="dense").to_numpy(), wallets.is_null().to_numpy(zero_copy_only=False)
            of_rank = np.zeros(len(t) + 1, np.int64)
            of_rank[rank] = np.arange(len(t))
            distinct = int(rank.max(initial=0)) == len(t)

            def lists(a: np.ndarray, b: np.ndarray, starts: np.ndarray, wallets: pa.Array = wallets) -> pa.RecordBatch:
                ends = pa.array(np.append(starts, len(b)).astype(np.int32))
                return pa.RecordBatch.from_arrays([wallets.take(pa.array(a[starts])), pa.ListArray.from_arrays(ends, wallets.take(pa.array(b)))], ["anchor", "wallets"])

            if first:
                text = pc.rank(pc.cast(wallets, pa.string()), null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
                of_text = np.zeros(len(t) + 1, np.int64)
                of_text[text] = np.arange(len(t))
                best = np.full(len(t) + 1, len(t) + 1)
            for slot in np.unique(t[own] // width):
                start, middle, last = np.searchsorted(t, [slot * width, (slot + 1) * width, (slot + 2) * width])
                points = start + np.argsort(value[start:last], kind="stable")
                anchors, amounts = start + np.flatnonzero(own[start:middle]), value[points].astype(float)
                anchors = anchors[np.argsort(value[anchors], kind="stable")]
                at = value[anchors].astype(float)
                low, high = np.where(at > 0, at * slack, -np.inf), np.where(at > 0, at / slack, 0)
                lo, hi = np.searchsorted(amounts, low, "left"), np.searchsorted(amounts, high, "right")
                ends = np.cumsum(hi - lo)
                begin = 0
                while begin < len(anchors):
                    done = ends[begin - 1] if begin else 0
                    end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                    n = (hi - lo)[begin:end]
                    i = np.repeat(np.arange(begin, end), n)
                    a, b = anchors[i], points[np.arange(len(i)) + np.repeat(lo[begin:end] - (np.cumsum(n) - n), n)]
                    begin = end
                    gap = t[b] - t[a]
                    keep = (gap >= 0) & (gap <= proximity) & ((gap > 0) | ((rank[b] > rank[a]) & ~unknown[a]))
                    i, a, b = i[keep], a[keep], b[keep]
                    keep = _like(value[a], value[b], tolerance)
                    i, b = i[keep], b[keep]
                    if not len(i):
                        continue
                    if least is not None and not distinct:  # some were funded more than once
                        b = of_rank[rank[b]]
                    if not (first and distinct):
                        pairs = np.sort(i << 32 | (len(t) - b))
                        if least is not None and not distinct:
                            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
                        i, b = pairs >> 32, len(t) - (pairs & 0xFFFFFFFF)
                    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    if least is not None:
                        members = np.diff(np.append(starts, len(i)))
                        enough = members + 1 >= least
                        if not enough.all():
                            keep = np.repeat(enough, members)
                            i, b = i[keep], b[keep]
                            if not len(i):
                                continue
                            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                        if first:
                            np.minimum.at(best, rank[b].astype(np.int64), text[anchors[i]])
                            who = anchors[i[starts]]
                            np.minimum.at(best, rank[who].astype(np.int64), text[who])
                            continue
                        after = np.append(starts[1:], len(i))
                        i, b = np.insert(i, after, i[starts]), np.insert(b, after, anchors[i[starts]])
                        starts = starts + np.arange(len(starts))
                    members = np.diff(np.append(starts, len(i)))
                    over = np.arange(len(i)) - np.repeat(starts, members) >= np.repeat(members & ~7, members)
                    order = np.argsort(over, kind="stable")
                    i, b = i[order], b[order]
                    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    yield lists(anchors[i], b, np.union1d(starts, np.arange(0, len(i), LIST)))
            if first and len(some := np.flatnonzero(best <= len(t))):
                yield lists(of_text[best[some]], of_rank[some], np.arange(len(some)))

    return met


def _near(anchors: DataFrame, fundings: DataFrame, proximity: int, tolerance: float, least: int | None = None, first: bool = False) -> DataFrame:
    """``batches`` of some anchors, with lists of wallets: those of ``fundings`` where the boolean column ``anchors`` holds.

    Wallets meet by time and by classes of amounts: an anchor goes to the cell and class of its own, the wallets to those in which an
    anchor can have them, so that all pairs of an anchor are made in one place and are never shuffled.
    """
    cell, reach = CELL * max(proximity, 1), -math.log(1 - tolerance - 4e-6)
    size = F.log(F.col("value").cast("double"))
    kind = lambda x: F.when(F.col("value") > 0, F.floor(x / CLASS)).otherwise(-1_000_000)
    rows = fundings.filter(F.col("t").isNotNull() & F.col("value").isNotNull())
    rows = rows.select(anchors.alias("_anchor"), "wallet", "t", F.col("value").cast("long").alias("value"))
    rows = rows.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("t") - proximity) / cell), F.floor(F.col("t") / cell))))
    rows = rows.withColumn("_kind", F.explode(F.sequence(kind(size - reach), kind(size + reach))))
    own = F.col("_anchor") & (F.col("_cell") == F.floor(F.col("t") / cell)) & (F.col("_kind") == kind(size))
    rows = rows.select("_cell", "_kind", own.alias("own"), "wallet", "t", "value")
    # a number of partitions, as the rows that are made tell how much work a task has, not those that are read
    parts = int(fundings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wallet = dict(fundings.dtypes)["wallet"]
    return rows.repartition(parts, "_cell", "_kind").sortWithinPartitions("_cell", "_kind").mapInArrow(_met(proximity, tolerance, least, first), f"anchor {wallet}, wallets array<{wallet}>")


def batches(fundings: DataFrame, proximity: int, tolerance: float) -> DataFrame:
    """(anchor, wallet): each wallet with those funded up to ``proximity`` later (ties in wallet order) with like amounts."""
    return _near(F.lit(True), fundings, proximity, tolerance).select("anchor", F.explode("wallets").alias("wallet"))


def clusters(fundings: DataFrame, proximity: int, tolerance: float, least: int = 2, first: bool = False) -> DataFrame:
    """(cluster_key, wallet): groups by funder, by funding transaction, and by batch around an anchor.

    Where a wallet was funded once, its rows are distinct as they are made; only batches around the others are compared with each other.
    With ``first`` for uses that take each wallet's first key alone: batches that can't be it may be left out, and pairs aren't rows.
    """
    again = fundings.groupBy("wallet").agg((F.count("*") > 1).alias("_again")).filter("_again")
    once = again.isEmpty()

    def large(rows: DataFrame, key: str, distinct: bool) -> DataFrame:
        rows = rows.select(key, "wallet").filter(F.col(key).isNotNull())
        rows = rows if distinct else rows.distinct()
        keys = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(key)
        return rows.join(keys, key, "left_semi")

    def keyed(kind: str, key: str, rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("cluster_key"), column)

    def spread(rows: DataFrame) -> DataFrame:  # a list's key is made once, before its rows
        return rows.select(rows.columns[0], F.explode("wallets").alias("wallet"))

    found = [keyed(kind, kind, large(fundings, kind, once), "wallet") for kind in ("funder", "tx")]
    if once:
        found.append(spread(keyed("batch", "anchor", _near(F.lit(True), fundings, proximity, tolerance, least, first), "wallets")))
    else:
        marked = fundings.join(again.withColumnRenamed("wallet", "_w"), F.col("wallet").eqNullSafe(F.col("_w")), "left").withColumn("_again", F.coalesce("_again", F.lit(False)))
        found.append(spread(keyed("batch", "anchor", _near(~F.col("_again"), marked, proximity, tolerance, least, first), "wallets")))
        near = spread(_near(F.col("_again"), marked, proximity, tolerance))
        found.append(keyed("batch", "anchor", large(near.union(near.select("anchor", "anchor")), "anchor", False), "wallet"))
    return reduce(DataFrame.union, found)


def cluster_concentration(members: DataFrame, holders: DataFrame) -> DataFrame:
    """By token: the largest share of positive balances that one cluster holds, cut to six places; null without clusters."""
    positive = holders.filter(F.col("balance") > 0)
    total = positive.groupBy("token_id").agg(F.sum("balance").alias("total"))
    held = members.join(positive, "wallet").groupBy("token_id", "cluster_key").agg(F.sum("balance").alias("held")).groupBy("token_id").agg(F.max("held").alias("held"))
    share = F.floor(F.col("held").cast("decimal(38,0)") * 1_000_000 / F.col("total").cast("decimal(38,0)")).cast("double") / 1_000_000
    return total.join(held, "token_id").select("token_id", share.alias("cluster_concentration"))


def independent(members: DataFrame, wallets: DataFrame) -> DataFrame:
    """How many wallets act alone: one for each cluster that is a wallet's first (by key), one for each wallet in none."""
    first = members.groupBy("wallet").agg(F.min("cluster_key").alias("cluster_key"))
    return wallets.select("wallet").distinct().join(first, "wallet", "left").agg((F.countDistinct("cluster_key") + F.count_if(F.col("cluster_key").isNull())).alias("independent"))


def smart_money(entries: DataFrame, scores: DataFrame, now: int, any_seed: bool) -> DataFrame:
    """By pool: seed wallets that entered, mean of their known scores, minutes since the last entry.

    entries: pool_id, wallet, entered (null where a pool has none). Without seeds all is null.
    """
    rows = entries.join(scores, "wallet", "left").groupBy("pool_id").agg(F.countDistinct("wallet").alias("smart_count"), F.avg("score").alias("smart_quality"), ((now - F.max("entered")) / 60e6).alias("smart_recency"))
    return rows if any_seed else rows.select("pool_id", *(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:]))
