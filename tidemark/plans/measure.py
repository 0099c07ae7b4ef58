"""Queries of measurement: trade windows, features, outcomes, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import features
from tidemark.operators import joins, outcomes, windows
from tidemark.sources.shared import stored
from tidemark.sources.views import DAY, HOUR, MINUTE

from .pricing import scaled_sql
from .registry import query, six

HORIZONS = outcomes.HORIZONS

PATHS = """, hz(horizon, span) AS (VALUES ('1m', 60000000), ('5m', 300000000), ('15m', 900000000), ('30m', 1800000000), ('1h', 3600000000), ('4h', 14400000000), ('24h', 86400000000)),
w AS (SELECT s.*, horizon, span, s.t AS start_t, s.t + span AS end_t FROM signals s, hz),
priced AS (SELECT *, nullif(CAST(abs(amount1) AS DOUBLE) / abs(amount0), 0) AS p FROM trades),
paths AS (SELECT w.signal_id, w.horizon, count(b.block_number) AS trade_count, count(b.p) AS priced_count, arg_max(b.p, b.block_number) AS last_price, max(b.p) AS max_price, min(b.p) AS min_price
          FROM w LEFT JOIN priced b ON b.pool_id = w.pool_id AND b.t BETWEEN w.start_t AND w.end_t GROUP BY 1, 2),
reasons AS (SELECT w.*, trade_count, priced_count, last_price, max_price, min_price,
            CASE WHEN end_t > (SELECT max(t) FROM trades) THEN 'incomplete_tail_coverage' WHEN price IS NULL OR price <= 0 THEN 'no_signal_price' WHEN trade_count = 0 THEN NULL WHEN priced_count / CAST(trade_count AS DOUBLE) < 0.8 THEN 'insufficient_quote_coverage' END AS failure_reason
            FROM w JOIN paths USING (signal_id, horizon)),
samples AS (SELECT *, CASE WHEN failure_reason IS NULL THEN CASE WHEN trade_count = 0 THEN 0 ELSE (last_price - price) / price * 100 END END AS return_pct,
            CASE WHEN failure_reason IS NULL THEN CASE WHEN trade_count = 0 THEN 0 ELSE (greatest(max_price, price) - price) / price * 100 END END AS max_runup_pct,
            CASE WHEN failure_reason IS NULL THEN CASE WHEN trade_count = 0 THEN 0 ELSE (least(min_price, price) - price) / price * 100 END END AS max_drawdown_pct FROM reasons)"""


def shown_price(name: str):
    """A decimal as text without trailing zeros."""
    return F.regexp_replace(F.col(name).cast("string"), r"\.?0+$", "")


def _paths(v):
    return outcomes.outcome_path(outcomes.pairs(v.signals, HORIZONS), v.trades.withColumn("trade_price", outcomes.trade_price()))


def samples(v):
    """All signals at all horizons with their outcome, worked out once and kept; a window that the tail hasn't passed is unmeasured."""
    paths = _paths(v)
    tail = v.trades.agg(F.max("t").alias("watermark"))  # one row
    rows = outcomes.metrics(paths).crossJoin(F.broadcast(tail))
    late = outcomes.coverage_decision(F.col("end"), F.col("watermark"), F.col("watermark"), 0, 0) != "ready"
    gone = {c: F.when(~late, F.col(c)) for c in ("return_pct", "max_runup_pct", "max_drawdown_pct")}
    return stored(rows.withColumns(gone | {"failure_reason": F.when(late, "incomplete_tail_coverage").otherwise(F.col("failure_reason"))}))


@query(PATHS + " SELECT signal_id, horizon, trade_count, priced_count, round(last_price, 6) AS last_price, round(max_price, 6) AS max_price, round(min_price, 6) AS min_price FROM paths")
def outcome_path(v):
    return _paths(v).select("signal_id", "horizon", "trade_count", "priced_count", *(F.round(c, 6).alias(c) for c in ("last_price", "max_price", "min_price")))


@query(PATHS + " SELECT signal_id, horizon, failure_reason, round(return_pct, 6) AS return_pct, round(max_runup_pct, 6) AS max_runup_pct, round(max_drawdown_pct, 6) AS max_drawdown_pct FROM samples")
def outcome_metrics(v):
    return samples(v).select("signal_id", "horizon", "failure_reason", *(F.round(c, 6).alias(c) for c in ("return_pct", "max_runup_pct", "max_drawdown_pct")))


@query(PATHS + """ SELECT signal_id, horizon, CASE WHEN end_t <= 1706000000000000 THEN 'ready' WHEN 1706100000000000 - end_t < 43200000000 THEN 'defer' ELSE 'give_up' END AS decision FROM w""")
def coverage_decision(v):
    rows = outcomes.pairs(v.signals, HORIZONS)
    return rows.select("signal_id", "horizon", outcomes.coverage_decision(F.col("end"), F.lit(1706000000000000), F.lit(1706100000000000), 30_000_000, 12 * HOUR).alias("decision"))


@query(PATHS + " SELECT signal_id, horizon FROM w WHERE end_t <= 1705500000000000 AND (signal_id + length(horizon)) % 3 <> 0")
def due_outcomes(v):
    rows = outcomes.pairs(v.signals, HORIZONS)
    done = rows.filter((F.col("signal_id") + F.length("horizon")) % 3 == 0)
    return outcomes.due(rows, done, F.lit(1705500000000000)).select("signal_id", "horizon")


@query(PATHS + """, e AS (SELECT *, end_t + 60000000 AS evaluated_t FROM samples), rb AS (SELECT epoch_us(ts) - 300000000 AS from_t, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) ELSE epoch_us(ts) + 60000000 END AS to_t, epoch_us(ts) + 7200000000 AS occurred_t FROM events WHERE event_id % 997 = 1),
    f AS (SELECT signal_id, horizon, EXISTS (SELECT 1 FROM rb WHERE rb.from_t <= e.end_t AND rb.to_t >= e.start_t AND rb.occurred_t > e.evaluated_t) AS r, failure_reason = 'incomplete_tail_coverage' AS i,
          EXISTS (SELECT 1 FROM trades x WHERE x.pool_id = e.pool_id AND x.t BETWEEN e.start_t AND e.end_t AND x.created_t > e.evaluated_t) AS l FROM e)
    SELECT signal_id, horizon, CASE WHEN r THEN 'reorg' WHEN i THEN 'incomplete' ELSE 'late' END AS repair FROM f WHERE r OR coalesce(i, false) OR l""")
def damaged_outcomes(v):
    rows = samples(v).withColumn("evaluated_t", F.col("end") + MINUTE)
    us = "unix_micros(CAST(ts AS TIMESTAMP))"
    rollbacks = v.table("events").filter("event_id % 997 = 1").selectExpr(f"{us} - 300000000 AS from_t", f"CASE WHEN event_id % 2 = 0 THEN {us} ELSE {us} + 60000000 END AS to_t", f"{us} + 7200000000 AS occurred_t")
    return outcomes.damaged(rows, rollbacks, 4 * HOUR).select("signal_id", "horizon", "repair")


_SERIES = """, near AS (SELECT x.block_number, q.price, abs(q.t - x.t) AS gap, q.t AS qt FROM trades x JOIN quotes q ON q.token_id = x.pool_id % 5 AND q.t BETWEEN x.t - 300000000 AND x.t + 300000000 WHERE x.pool_id % 5 <> 0),
    best AS (SELECT block_number, price FROM near QUALIFY row_number() OVER (PARTITION BY block_number ORDER BY gap, qt, CAST(price AS VARCHAR)) = 1),
    ser AS (SELECT x.*, nullif(abs(CAST(CASE WHEN x.pool_id % 2 = 0 THEN amount1 ELSE amount0 END AS HUGEINT)) * CASE WHEN x.pool_id % 5 = 0 THEN 100 ELSE CAST(round(b.price * 100) AS HUGEINT) END * 10000000000000000 // nullif(abs(CASE WHEN x.pool_id % 2 = 0 THEN amount0 ELSE amount1 END), 0), 0) AS p
            FROM trades x LEFT JOIN best b USING (block_number))"""


def _series(v):
    """Trades priced by a fixed rate or by the nearest quote, in cents, within five minutes."""
    first, token = F.col("pool_id") % 2 == 0, F.col("pool_id") % 5
    trades = v.trades.withColumns({"trade_id": F.col("block_number"), "base_is_token0": first, "base_decimals": F.lit(6), "quote_decimals": F.lit(6), "fixed_usd": F.when(token == 0, "1"), "quote_token": token})
    cents = F.round(F.col("price") * 100).cast("long")
    shown = F.concat(F.floor(cents / 100), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return outcomes.price_series(trades, v.quotes.select("token_id", "t", shown.alias("price")), 5 * MINUTE)


@query(_SERIES + f" SELECT block_number, {scaled_sql('p')} AS price FROM ser")
def price_series(v):
    return _series(v).select("block_number", shown_price("trade_price").alias("price"))


@query(PATHS.split("priced AS")[0] + _SERIES[2:] + f""", up AS (SELECT w.signal_id, w.horizon, count(b.block_number) AS trade_count, count(b.p) AS priced_count, arg_max(b.p, b.block_number) AS lp, max(b.p) AS hp, min(b.p) AS np
    FROM w LEFT JOIN ser b ON b.pool_id = w.pool_id AND b.t BETWEEN w.start_t AND w.end_t GROUP BY 1, 2)
    SELECT signal_id, horizon, trade_count, priced_count, {scaled_sql('lp')} AS last_price, {scaled_sql('hp')} AS max_price, {scaled_sql('np')} AS min_price FROM up""")
def outcome_path_usd(v):
    """Outcome paths over exact dollar prices."""
    paths = outcomes.outcome_path(outcomes.pairs(v.signals, HORIZONS), _series(v))
    return paths.select("signal_id", "horizon", "trade_count", "priced_count", *(shown_price(c).alias(c) for c in ("last_price", "max_price", "min_price")))


@query(PATHS + """, h AS (SELECT signal_id, horizon, round(return_pct, 6) AS return_pct, failure_reason FROM samples WHERE signal_id % 3 <> 0),
    n AS (SELECT signal_id, horizon, round(return_pct + 1, 6) AS return_pct, 'repaired' AS failure_reason FROM samples WHERE signal_id % 3 <> 1)
    SELECT coalesce(h.signal_id, n.signal_id) AS signal_id, coalesce(h.horizon, n.horizon) AS horizon, CASE WHEN n.signal_id IS NULL THEN h.return_pct ELSE n.return_pct END AS return_pct,
           CASE WHEN n.signal_id IS NULL THEN h.failure_reason ELSE n.failure_reason END AS failure_reason, CAST(CASE WHEN h.signal_id IS NOT NULL AND n.signal_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS revision
    FROM h FULL JOIN n ON h.signal_id = n.signal_id AND h.horizon = n.horizon""")
def outcome_repair_merge(v):
    rows = samples(v)
    old = rows.filter("signal_id % 3 <> 0").select("signal_id", "horizon", F.round("return_pct", 6).alias("return_pct"), "failure_reason", F.lit(0).alias("revision"))
    new = rows.filter("signal_id % 3 <> 1").select("signal_id", "horizon", F.round(F.col("return_pct") + 1, 6).alias("return_pct"), F.lit("repaired").alias("failure_reason"))
    return outcomes.repair(old, new, ["return_pct", "failure_reason"])


def _anchors(v):
    return v.signals.select("signal_id", "pool_id", F.col("t").alias("at"), (F.col("pool_id") % 2 == 0).alias("base_is_token0"))


_WINDOW = """count(*) FILTER (x.side = b) AS buys, count(*) FILTER (x.side <> b) AS sells, count(DISTINCT x.wallet) FILTER (x.side = b) AS unique_buyers,
    CAST(sum(abs(CASE WHEN s.pool_id % 2 = 0 THEN x.amount1 ELSE x.amount0 END)) AS BIGINT)"""
_SIDED = ", s AS (SELECT *, CASE WHEN pool_id % 2 = 0 THEN 'OUT0' ELSE 'OUT1' END AS b FROM signals)"


@query(_SIDED + f" SELECT s.signal_id, {_WINDOW} AS quote_volume FROM s LEFT JOIN trades x ON x.pool_id = s.pool_id AND x.t > s.t - 3600000000 AND x.t <= s.t GROUP BY s.signal_id")
def trade_window(v):
    return windows.trade_window(v.trades, _anchors(v), HOUR).select("signal_id", "buys", "sells", "unique_buyers", "quote_volume")


_WINDOW_OR_ZERO = _WINDOW.replace("CAST(sum(", "coalesce(CAST(sum(") + ", 0)"


@query(_SIDED + f" SELECT s.signal_id, {_WINDOW_OR_ZERO} AS quote_volume FROM s LEFT JOIN trades x ON x.pool_id = s.pool_id AND x.t > s.t - 300000000 AND x.t <= s.t GROUP BY s.signal_id")
def snapshot_trade_stats(v):
    """As a trade window, but an empty one has a volume of 0."""
    return windows.trade_window(v.trades, _anchors(v), 5 * MINUTE).select("signal_id", "buys", "sells", "unique_buyers", F.coalesce("quote_volume", F.lit(0)).alias("quote_volume"))


_CONSECUTIVE = _SIDED + f", c AS (SELECT s.signal_id, k, {_WINDOW} AS quote_volume FROM s CROSS JOIN (SELECT unnest(range(0, 5)) AS k) LEFT JOIN trades x ON x.pool_id = s.pool_id AND x.t > s.t - (k + 1) * 3600000000 AND x.t <= s.t - k * 3600000000 GROUP BY 1, 2)"


def _consecutive(v):
    return windows.consecutive_windows(v.trades, _anchors(v), HOUR, 5)


@query(_CONSECUTIVE + " SELECT signal_id, CAST(k AS BIGINT) AS k, buys, sells, unique_buyers, quote_volume FROM c")
def consecutive_windows(v):
    return _consecutive(v).select("signal_id", "k", "buys", "sells", "unique_buyers", "quote_volume")


@query(_CONSECUTIVE + " SELECT signal_id, CAST(k AS BIGINT) AS k, CASE WHEN signal_id % 7 <> 0 THEN round(quote_volume * 1.5, 6) END AS volume_usd FROM c")
def window_volume_usd(v):
    rate = F.when(F.col("signal_id") % 7 != 0, 1.5)
    return _consecutive(v).select("signal_id", "k", F.round(F.col("quote_volume") * rate, 6).alias("volume_usd"))


_MOMENTUM = _CONSECUTIVE + """, p AS (SELECT signal_id, max(buys) FILTER (k = 0) AS b, max(sells) FILTER (k = 0) AS s, max(unique_buyers) FILTER (k = 0) AS u0, max(unique_buyers) FILTER (k = 1) AS u1, max(quote_volume) FILTER (k = 0) AS v0,
    list(quote_volume ORDER BY k) FILTER (k > 0 AND quote_volume IS NOT NULL) AS l FROM c GROUP BY 1),
    m AS (SELECT signal_id, CASE WHEN len(l) >= 3 AND l[1] + l[2] + l[3] > 0 THEN v0 / ((l[1] + l[2] + l[3]) / 3.0) END AS acceleration, CASE WHEN b + s > 0 THEN b / CAST(greatest(s, 1) AS DOUBLE) END AS buy_sell_ratio, (b + s) / 60.0 AS velocity, CASE WHEN u1 > 0 THEN (u0 - u1) / CAST(u1 AS DOUBLE) END AS buyer_growth FROM p)"""


def momentum(v):
    wide = _consecutive(v).groupBy("signal_id").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(5) for c in ("buys", "sells", "unique_buyers", "quote_volume")))
    known = [F.col(f"quote_volume{k}").cast("double") for k in range(1, 5)]
    return wide.select(
        "signal_id",
        features.acceleration(F.col("quote_volume0").cast("double"), known).alias("acceleration"),
        features.buy_sell_ratio(F.col("buys0"), F.col("sells0")).alias("buy_sell_ratio"),
        features.velocity(F.col("buys0"), F.col("sells0"), 60).alias("velocity"),
        features.buyer_growth(F.col("unique_buyers0"), F.col("unique_buyers1")).alias("buyer_growth"),
    )


_FOUR = ("acceleration", "buy_sell_ratio", "velocity", "buyer_growth")


@query(_MOMENTUM + " SELECT signal_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FOUR) + " FROM m")
def momentum_features(v):
    return momentum(v).withColumns(six(*_FOUR))


@query(_MOMENTUM + " SELECT signal_id, CAST((acceleration IS NOT NULL)::INT + (buy_sell_ratio IS NOT NULL)::INT + (velocity IS NOT NULL)::INT + (buyer_growth IS NOT NULL)::INT AS BIGINT) AS measured, CAST(4 AS BIGINT) AS total FROM m")
def feature_coverage(v):
    values = F.create_map(*(x for c in _FOUR for x in (F.lit(c), F.col(c))))
    rows = momentum(v).withColumn("values", values)
    return rows.select("signal_id", F.size(F.filter(F.map_values("values"), lambda x: x.isNotNull())).cast("long").alias("measured"), F.size("values").cast("long").alias("total"))


@query("""SELECT snapshot_id, round(CASE WHEN market_cap IS NOT NULL AND liquidity IS NOT NULL THEN market_cap / greatest(liquidity, 1) END, 6) AS mc_liquidity FROM snapshots""")
def mc_liquidity(v):
    return v.snapshots.select("snapshot_id", F.round(features.cap_to_liquidity(F.col("market_cap"), F.col("liquidity")), 6).alias("mc_liquidity"))


@query(""", near AS (SELECT a.snapshot_id, b.liquidity AS past, abs(b.t - (a.t - 7776000000000)) AS gap, b.t AS bt FROM snapshots a JOIN snapshots b ON a.pool_id = b.pool_id AND b.liquidity IS NOT NULL AND b.t BETWEEN a.t - 7776000000000 - 2592000000000 AND a.t - 7776000000000 + 2592000000000),
    best AS (SELECT snapshot_id, past FROM near QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY gap, bt, past) = 1)
    SELECT s.snapshot_id, round(CASE WHEN past >= 1 THEN (s.liquidity - past) / past END, 6) AS liquidity_growth FROM snapshots s LEFT JOIN best b ON s.snapshot_id = b.snapshot_id""")
def liquidity_growth(v):
    return features.liquidity_growth(v.snapshots, 90 * DAY, 30 * DAY).withColumns(six("liquidity_growth"))


@query(""", pos AS (SELECT pool_id, liquidity, lag(liquidity) OVER (PARTITION BY pool_id ORDER BY t, snapshot_id) AS before FROM snapshots WHERE liquidity > 0),
    st AS (SELECT pool_id, count(*) AS n, avg(abs(liquidity - before) / before) AS step FROM pos GROUP BY 1),
    la AS (SELECT pool_id, liquidity AS last FROM snapshots QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY t DESC, snapshot_id DESC) = 1)
    SELECT la.pool_id, round(CASE WHEN coalesce(n, 0) < 3 THEN NULL WHEN last IS NULL OR last <= 0 THEN 0 ELSE greatest(0, 1 - least(1, step)) END, 6) AS stability FROM la LEFT JOIN st ON la.pool_id = st.pool_id""")
def liquidity_stability(v):
    return features.stability(v.snapshots).withColumns(six("stability"))


@query("SELECT pool_id, snapshot_id, liquidity FROM snapshots QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY t DESC, snapshot_id DESC) = 1")
def latest_snapshot(v):
    return joins.latest_by(v.snapshots, ["pool_id"], ["t", "snapshot_id"], ["liquidity"]).select("pool_id", "snapshot_id", "liquidity")


@query("SELECT o_custkey AS token_id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_risk(v):
    return joins.latest_by(v.table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select(F.col("o_custkey").alias("token_id"), F.col("o_orderstatus").alias("status"))


@query("""SELECT s.pool_id, max(s.liquidity) AS peak, arg_max(coalesce(s.liquidity, -1), CAST(s.t AS HUGEINT) * 1000000 + s.snapshot_id) AS latest, (SELECT max(t) FROM trades x WHERE x.pool_id = s.pool_id) AS last_trade_t FROM snapshots s GROUP BY s.pool_id""")
def pool_context(v):
    trades = v.trades.groupBy("pool_id").agg(F.max("t").alias("last_trade_t"))
    snaps = v.snapshots.groupBy("pool_id").agg(F.max("liquidity").alias("peak"), F.max_by(F.coalesce("liquidity", F.lit(-1.0)), F.struct("t", "snapshot_id")).alias("latest"))
    return snaps.join(trades, "pool_id", "left")

