"""Queries of holders, transfers, clusters and smart money."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import decode, features
from tidemark.operators import holders as h
from tidemark.operators import joins
from tidemark.sources.shared import stored
from tidemark.sources.views import DAY

from .registry import query, six

_UNIQUE = ", u AS (SELECT * FROM transfers QUALIFY row_number() OVER (PARTITION BY tx, log_index ORDER BY token_id, source, target, value, t) = 1), legs AS (SELECT token_id, target AS wallet, value AS change, t, tx % 4 AS batch FROM u UNION ALL SELECT token_id, source, -value, t, tx % 4 FROM u)"


@query(_UNIQUE + " SELECT token_id, wallet, CAST(sum(change) AS BIGINT) AS change, max(t) AS last_t, min(t) AS first_t FROM legs GROUP BY 1, 2")
def transfer_net(v):
    return h.netted(h.unique_transfers(v.transfers))


@query(_UNIQUE + """, n AS (SELECT token_id, wallet, batch, CAST(sum(change) AS BIGINT) AS change FROM legs GROUP BY 1, 2, 3), r AS (SELECT *, sum(change) OVER (PARTITION BY token_id, wallet ORDER BY batch) AS s FROM n)
    SELECT token_id, wallet, CAST(arg_max(s, batch) - least(min(s), 0) AS BIGINT) AS balance, min(s) < 0 AS partially_observed FROM r GROUP BY 1, 2""")
def holder_balances(v):
    unique = h.unique_transfers(v.transfers).withColumn("batch", F.col("tx") % 4)
    return h.balances(h.netted(unique, "batch"))


#: Whole amounts become multiples of this, far beyond 64 and 128 bits.
LARGE = 10**60 + 7
_LARGE = "concat(CASE WHEN {0} < 0 THEN '-' ELSE '' END, CASE WHEN {0} = 0 THEN '0' ELSE concat(abs({0}), lpad(CAST(abs({0}) * 7 AS VARCHAR), 60, '0')) END)"


def _large_transfers(v):
    """Transfers as logs with 256-bit amounts, decoded again: value is text."""

    @F.pandas_udf("string")
    def word(x: pd.Series) -> pd.Series:
        return x.map(lambda n: f"{int(n) * LARGE:064x}")

    place = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 64, "0"))
    logs = h.unique_transfers(v.transfers).select(
        place("token_id").alias("address"), F.array(F.lit(decode.TRANSFERRED), place("source"), place("target")).alias("topics"), F.concat(F.lit("0x"), word("value")).alias("data"),
        F.col("t").alias("block_number"), F.col("tx").cast("string").alias("tx_hash"), "log_index",
    )
    number = lambda c: F.conv(F.right(F.col(c), F.lit(15)), 16, 10).cast("long")
    rows = decode.transfers(stored(logs)).select(number("token").alias("token_id"), number("source").alias("source"), number("target").alias("target"), "value", F.col("block_number").alias("t"), F.col("tx_hash").cast("long").alias("tx"), "log_index")
    return rows


@query(_UNIQUE + f" SELECT token_id, wallet, {_LARGE.format('s')} AS change, last_t, first_t FROM (SELECT token_id, wallet, CAST(sum(change) AS BIGINT) AS s, max(t) AS last_t, min(t) AS first_t FROM legs GROUP BY 1, 2)")
def transfer_net_large(v):
    """Netting of amounts of 200 bits and more."""
    return h.netted(_large_transfers(v)).select("token_id", "wallet", "change", "last_t", "first_t")


@query(_UNIQUE + f""", n AS (SELECT token_id, wallet, batch, CAST(sum(change) AS BIGINT) AS change FROM legs GROUP BY 1, 2, 3), r AS (SELECT *, sum(change) OVER (PARTITION BY token_id, wallet ORDER BY batch) AS s FROM n)
    SELECT token_id, wallet, {_LARGE.format('balance')} AS balance, partially_observed FROM (SELECT token_id, wallet, CAST(arg_max(s, batch) - least(min(s), 0) AS BIGINT) AS balance, min(s) < 0 AS partially_observed FROM r GROUP BY 1, 2)""")
def holder_balances_large(v):
    """Decoded logs to balances, exact at any size."""
    rows = _large_transfers(v).withColumn("batch", F.col("tx") % 4)
    return h.balances(h.netted(rows, "batch"))


_EXCLUDED = "SELECT s_suppkey FROM supplier UNION SELECT n_nationkey * 7 FROM nation"


def _excluded(v):
    return v.table("supplier").select(F.col("s_suppkey").alias("wallet")).union(v.table("nation").select((F.col("n_nationkey") * 7).alias("wallet"))).distinct()


@query(f"SELECT n_nationkey AS token_id, count(c.wallet) AS holders FROM nation LEFT JOIN holders c ON c.token_id = n_nationkey AND c.balance > 100 AND c.wallet NOT IN ({_EXCLUDED}) GROUP BY 1")
def holder_count(v):
    counts = h.eligible(v.holders, _excluded(v), 100).groupBy("token_id").agg(F.count("*").alias("holders"))
    return v.table("nation").select(F.col("n_nationkey").alias("token_id")).join(counts, "token_id", "left").na.fill(0, ["holders"])


@query("SELECT token_id, round(CASE WHEN count(*) FILTER (first_t <= 6000000000) > 0 THEN count(*) FILTER (first_t <= 6000000000 AND balance > 0) / CAST(count(*) FILTER (first_t <= 6000000000) AS DOUBLE) END, 6) AS retention FROM holders GROUP BY 1")
def holder_retention(v):
    return h.retention(v.holders, 6_000_000_000).withColumns(six("retention"))


_TOP = f", e AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY balance DESC, wallet) AS r FROM holders WHERE balance > 0 AND wallet NOT IN ({_EXCLUDED}))"


@query(_TOP + " SELECT token_id, wallet, balance, CAST(r AS INTEGER) AS rank FROM e WHERE r <= 50")
def top_holders(v):
    return joins.top_by(h.eligible(v.holders, _excluded(v)), ["token_id"], [F.desc("balance"), F.col("wallet")], 50).select("token_id", "wallet", "balance", "rank")


@query(_TOP + ", s AS (SELECT token_id, CASE WHEN token_id % 6 = 0 THEN 0 ELSE CAST(sum(balance) FILTER (balance > 0) AS BIGINT) END AS supply FROM holders GROUP BY 1) SELECT s.token_id, CASE WHEN supply > 0 THEN floor(held * 1000000.0 / supply) / 1000000 END AS concentration FROM s LEFT JOIN (SELECT token_id, sum(balance) AS held FROM e WHERE r <= 10 GROUP BY 1) t ON s.token_id = t.token_id")
def top10_concentration(v):
    supply = v.holders.groupBy("token_id").agg(F.when(F.col("token_id") % 6 == 0, F.lit(0).cast("long")).otherwise(F.sum(F.when(F.col("balance") > 0, F.col("balance")))).alias("supply"))
    return h.concentration(h.eligible(v.holders, _excluded(v)), supply)


@query(""", c AS (SELECT token_id, first_t // 6000000000 AS reading, count(*) AS n FROM holders WHERE balance > 0 GROUP BY 1, 2), s AS (SELECT token_id, reading, CAST(sum(n) OVER (PARTITION BY token_id ORDER BY reading) AS BIGINT) AS holders FROM c)
    SELECT token_id, reading, holders, CASE WHEN lag(reading) OVER w IS NOT NULL THEN (holders - lag(holders) OVER w) / ((reading - lag(reading) OVER w) * 100.0e0) END AS rate FROM s WINDOW w AS (PARTITION BY token_id ORDER BY reading)""")
def holder_growth(v):
    """New holders a minute since the reading before, a reading every 100 minutes in which a token gained holders."""
    from pyspark.sql import Window

    counts = v.holders.filter("balance > 0").groupBy("token_id", F.floor(F.col("first_t") / 6_000_000_000).alias("reading")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("token_id").orderBy("reading")  # readings, not holders
    rows = counts.select("token_id", "reading", F.sum("n").over(order).alias("holders"))
    minutes = (F.col("reading") - F.lag("reading").over(order)) * 100.0
    return rows.select("token_id", "reading", "holders", features.holder_rate(F.col("holders"), F.lag("holders").over(order), minutes).alias("rate"))


_BATCH = """, fd AS (SELECT * FROM fundings), near AS (SELECT a.wallet AS anchor, b.wallet FROM fd a JOIN fd b ON b.t BETWEEN a.t AND a.t + 86400000000 AND (b.t > a.t OR b.wallet > a.wallet)
    AND (a.value = b.value OR (a.value <> 0 AND b.value <> 0 AND floor((greatest(a.value, b.value) - least(a.value, b.value)) * 1000000.0 / greatest(a.value, b.value)) / 1000000 <= 0.05)))"""
_CLUSTERS = _BATCH + """, members AS (SELECT concat('funder:', funder) AS cluster_key, wallet FROM fd UNION SELECT concat('tx:', tx), wallet FROM fd UNION SELECT concat('batch:', anchor), wallet FROM near UNION SELECT concat('batch:', anchor), anchor FROM near),
    cl AS (SELECT * FROM members WHERE cluster_key IN (SELECT cluster_key FROM members GROUP BY 1 HAVING count(*) >= 2))"""


def _clusters(v, first=False):
    return h.clusters(v.fundings, DAY, 0.05, first=first)


@query(_BATCH + " SELECT anchor, wallet FROM near")
def cluster_batch(v):
    return h.batches(v.fundings, DAY, 0.05)


@query(_CLUSTERS + " SELECT cluster_key, wallet FROM cl")
def clusters(v):
    return _clusters(v)


@query(_CLUSTERS + ", f AS (SELECT wallet, min(cluster_key) AS k FROM cl GROUP BY 1) SELECT count(DISTINCT k) + count(*) FILTER (k IS NULL) AS independent FROM (SELECT fd.wallet, f.k FROM fd LEFT JOIN f ON fd.wallet = f.wallet)")
def independent_count(v):
    return h.independent(_clusters(v, True), v.fundings)


@query(_CLUSTERS + """, p AS (SELECT * FROM holders WHERE balance > 0), g AS (SELECT p.token_id, cluster_key, sum(balance) AS held FROM cl JOIN p ON cl.wallet = p.wallet GROUP BY 1, 2), m AS (SELECT token_id, max(held) AS held FROM g GROUP BY 1)
    SELECT m.token_id, floor(m.held * 1000000.0 / t.total) / 1000000 AS cluster_concentration FROM m JOIN (SELECT token_id, sum(balance) AS total FROM p GROUP BY 1) t ON m.token_id = t.token_id""")
def cluster_concentration(v):
    return h.cluster_concentration(_clusters(v), v.holders)


def first_clusters(v):
    """Each wallet in a cluster with its first cluster by key."""
    return _clusters(v, True).groupBy("wallet").agg(F.min("cluster_key").alias("k"))


@query("SELECT pool_id, wallet, min(t) AS entered FROM trades WHERE wallet IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0) GROUP BY 1, 2")
def smart_entries(v):
    seeds = v.table("customer").filter("c_custkey % 9 = 0").select(F.col("c_custkey").alias("wallet"))
    return v.trades.join(seeds, "wallet", "left_semi").groupBy("pool_id", "wallet").agg(F.min("t").alias("entered"))


@query("""SELECT pool_id, count(DISTINCT e.wallet) AS smart_count, round(avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000 END), 6) AS smart_quality, round((1707000000000000 - max(entered)) / 6e7, 6) AS smart_recency
    FROM (SELECT pool_id, wallet, min(t) AS entered FROM trades WHERE wallet % 9 = 0 GROUP BY 1, 2) e LEFT JOIN customer ON c_custkey = e.wallet GROUP BY 1""")
def smart_money(v):
    entries = v.trades.filter("wallet % 9 = 0").groupBy("pool_id", "wallet").agg(F.min("t").alias("entered"))
    scores = v.table("customer").select(F.col("c_custkey").alias("wallet"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 10000).alias("score"))
    return h.smart_money(entries, scores, 1707000000000000, True).withColumns(six("smart_quality", "smart_recency"))


@query("SELECT p_partkey, 0e0 + least(greatest(p_size / 5e1, 0e0), 1e0) * 2e-1 + least(greatest(p_retailprice / 2e3, 0e0), 1e0) * 15e-2 + CASE WHEN p_partkey % 3 = 0 THEN 0e0 ELSE 5e-1 END * 2e-1 + 1e0 * 25e-2 + least(greatest(CAST(p_partkey % 7 - 3 AS DOUBLE), 0e0), 1e0) * 2e-1 AS score FROM part")
def wallet_alpha(v):
    parts = [F.col("p_size") / 50.0, F.col("p_retailprice") / 2000, F.when(F.col("p_partkey") % 3 != 0, 0.5), F.lit(7.0), (F.col("p_partkey") % 7 - 3).cast("double")]
    return v.table("part").select("p_partkey", features.wallet_score(parts).alias("score"))
