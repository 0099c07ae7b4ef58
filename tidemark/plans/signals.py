"""Queries of scoring, risk, signal states, alerts and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import features, scoring, text
from tidemark.operators import delivery, joins, risk, states
from tidemark.sources.shared import stored
from tidemark.sources.views import DAY, MINUTE

from . import measure, wallets
from .measure import _MOMENTUM, momentum
from .registry import ORACLE_SQL, query, six

_CLAMP = "least(greatest({}, 0), 100)"


@query("SELECT event_id, round(" + _CLAMP.format("100 - (value - 10) / 190.0 * 100") + ", 6) AS score FROM events")
def normalize_minmax(v):
    return v.table("events").select("event_id", F.round(scoring.min_max(F.col("value"), 10, 200, True), 6).alias("score"))


@query("SELECT event_id, round(" + _CLAMP.format("(log10(greatest(value, 1.0)) - log10(1.0)) / (log10(300.0) - log10(1.0)) * 100") + ", 6) AS score FROM events")
def normalize_log(v):
    return v.table("events").select("event_id", F.round(scoring.log_scale(F.col("value"), 1.0, 300.0), 6).alias("score"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN " + _CLAMP.format("CASE WHEN c_acctbal >= 3000 THEN 50 + (c_acctbal - 3000) / 5000 * 50 ELSE c_acctbal / 3000 * 50 END") + " END, 6) AS score FROM customer")
def normalize_ratio(v):
    return v.table("customer").select("c_custkey", F.round(scoring.bounded_ratio(F.col("c_acctbal"), 3000, 8000), 6).alias("score"))


_PARTS = _MOMENTUM + """, sc AS (SELECT signal_id, CASE WHEN acceleration IS NOT NULL THEN least(greatest(acceleration / 5 * 100, 0), 100) END AS a, CASE WHEN buy_sell_ratio IS NOT NULL THEN least(greatest(buy_sell_ratio / 4 * 100, 0), 100) END AS b, CASE WHEN velocity IS NOT NULL THEN least(greatest(velocity / 0.5 * 100, 0), 100) END AS c, CASE WHEN buyer_growth IS NOT NULL THEN least(greatest((buyer_growth + 1) / 3 * 100, 0), 100) END AS d FROM m),
    cs AS (SELECT *, (a IS NOT NULL)::INT * 0.4 + (b IS NOT NULL)::INT * 0.6 AS w1, (c IS NOT NULL)::INT * 0.7 + (d IS NOT NULL)::INT * 0.3 AS w2 FROM sc),
    co AS (SELECT signal_id, CASE WHEN w1 > 0 THEN (coalesce(a * 0.4, 0) + coalesce(b * 0.6, 0)) / CAST(w1 AS DOUBLE) END AS flow, CAST(w1 AS DOUBLE) AS flow_share, CASE WHEN w2 > 0 THEN (coalesce(c * 0.7, 0) + coalesce(d * 0.3, 0)) / CAST(w2 AS DOUBLE) END AS pace FROM cs)"""


def _components(v):
    rows = momentum(v)
    a, b = scoring.min_max(F.col("acceleration"), 0, 5), scoring.min_max(F.col("buy_sell_ratio"), 0, 4)
    c, d = scoring.min_max(F.col("velocity"), 0, 0.5), scoring.min_max(F.col("buyer_growth"), -1, 2)
    flow, share = scoring.component([(a, 0.4), (b, 0.6)])
    pace, _ = scoring.component([(c, 0.7), (d, 0.3)])
    return rows.select("signal_id", flow.alias("flow"), share.alias("flow_share"), pace.alias("pace"))


@query(_PARTS + " SELECT signal_id, round(flow, 6) AS flow, round(flow_share, 6) AS flow_share, round(pace, 6) AS pace FROM co")
def component_scores(v):
    return _components(v).select("signal_id", *(F.round(c, 6).alias(c) for c in ("flow", "flow_share", "pace")))


_ALPHA = _PARTS + """, al AS (SELECT signal_id, least(greatest(CASE WHEN flow IS NULL AND pace IS NULL THEN 0 ELSE (coalesce(flow * 0.55, 0) + coalesce(pace * 0.45, 0)) / CAST((flow IS NOT NULL)::INT * 0.55 + (pace IS NOT NULL)::INT * 0.45 AS DOUBLE) END - (signal_id % 4) / 100.0 * 20, 0), 100) AS score,
    CAST((flow IS NOT NULL)::INT * 0.55 + (pace IS NOT NULL)::INT * 0.45 AS DOUBLE) AS coverage FROM co)"""


def _alpha(v):
    score, coverage = scoring.alpha([(F.col("flow"), 0.55), (F.col("pace"), 0.45)], scoring.penalty((F.col("signal_id") % 4).cast("double"), 20))
    return _components(v).select("signal_id", score.alias("score"), coverage.alias("coverage"))


@query(_ALPHA + " SELECT signal_id, round(score, 6) AS score, round(coverage, 6) AS coverage, coverage >= 0.5 AS sufficient FROM al")
def alpha_score(v):
    return _alpha(v).select("signal_id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"), (F.col("coverage") >= 0.5).alias("sufficient"))


def _nested(name: str) -> str:
    """Another query's SQL as a table."""
    return f"({ORACLE_SQL[name]})"


_FEATURE_SET = f"""SELECT s.signal_id, la.liquidity AS liquidity_usd, lg.liquidity_growth, st.stability AS liquidity_stability, mc.mc_liquidity, mo.acceleration, mo.buy_sell_ratio, mo.velocity, mo.buyer_growth, s.holder_count,
    round(CASE WHEN minutes > 0 THEN (s.holder_count - before) / minutes END, 6) AS holder_growth, tc.concentration AS top10_concentration, hr.retention AS holder_retention, cc.cluster_concentration, si.smart_count, sm.smart_recency, sm.smart_quality
    FROM (SELECT *, lag(holder_count) OVER w AS before, (t - lag(t) OVER w) / 6e7 AS minutes FROM (SELECT signal_id, pool_id, t, signals.token_id % 25 AS token_id, hc.holders AS holder_count FROM signals JOIN {_nested("holder_count")} hc ON hc.token_id = signals.token_id % 25) WINDOW w AS (PARTITION BY pool_id ORDER BY t, signal_id)) s
    JOIN {_nested("momentum_features")} mo USING (signal_id) LEFT JOIN (SELECT s.signal_id, x.snapshot_id, x.liquidity FROM signals s JOIN snapshots x ON x.pool_id = s.pool_id AND x.t <= s.t QUALIFY row_number() OVER (PARTITION BY s.signal_id ORDER BY x.t DESC, x.snapshot_id DESC) = 1) la ON la.signal_id = s.signal_id LEFT JOIN {_nested("liquidity_growth")} lg ON lg.snapshot_id = la.snapshot_id LEFT JOIN {_nested("mc_liquidity")} mc ON mc.snapshot_id = la.snapshot_id
    LEFT JOIN {_nested("liquidity_stability")} st ON st.pool_id = s.pool_id LEFT JOIN {_nested("top10_concentration")} tc ON tc.token_id = s.token_id LEFT JOIN {_nested("holder_retention")} hr ON hr.token_id = s.token_id LEFT JOIN {_nested("cluster_concentration")} cc ON cc.token_id = s.token_id
    LEFT JOIN {_nested("smart_money")} sm ON sm.pool_id = s.pool_id LEFT JOIN (SELECT pool_id, count(DISTINCT coalesce(k, concat('wallet:', e.wallet))) AS smart_count FROM {_nested("smart_entries")} e LEFT JOIN (SELECT wallet, min(cluster_key) AS k FROM {_nested("clusters")} GROUP BY 1) f ON f.wallet = e.wallet GROUP BY 1) si ON si.pool_id = s.pool_id"""


def _features(v):
    """The sixteen features of every signal: by its pool, its token and the trades before it.

    The parts are written one after another: in one plan of them all, the driver would hold every stage and broadcast at once.
    """
    order = Window.partitionBy("pool_id").orderBy("t", "signal_id")
    counts = wallets.holder_count(v).select("token_id", F.col("holders").alias("holder_count"))
    rows = v.signals.select("signal_id", "pool_id", "t", (F.col("token_id") % 25).alias("token_id")).join(counts, "token_id")
    rate = features.holder_rate(F.col("holder_count"), F.lag("holder_count").over(order), (F.col("t") - F.lag("t").over(order)) / 6e7)
    rows = stored(rows.withColumn("holder_growth", F.round(rate, 6)).join(momentum(v).withColumns(six("acceleration", "buy_sell_ratio", "velocity", "buyer_growth")), "signal_id"))
    # the snapshot that was there when the signal came, not the last of all
    last = joins.latest_before(rows.select("signal_id", "pool_id", F.col("t").alias("at")), v.snapshots, ["pool_id"], ["snapshot_id", "liquidity"], ["snapshot_id"], 365 * DAY)
    last = stored(last.select("signal_id", "snapshot_id", F.col("liquidity").alias("liquidity_usd")))
    last = stored(last.join(measure.liquidity_growth(v), "snapshot_id", "left").join(measure.mc_liquidity(v), "snapshot_id", "left").drop("snapshot_id"))
    keys = {key: stored(rows.select(key).distinct()) for key in ("pool_id", "token_id")}
    rows = rows.join(last.hint("merge"), "signal_id", "left")
    alone = wallets.smart_entries(v).join(wallets.first_clusters(v), "wallet", "left").groupBy("pool_id").agg(F.countDistinct(F.coalesce("k", F.concat(F.lit("wallet:"), "wallet"))).alias("smart_count"))
    by_pool = [measure.liquidity_stability(v).withColumnRenamed("stability", "liquidity_stability"), wallets.smart_money(v).drop("smart_count"), alone]
    by_token = [wallets.top10_concentration(v).withColumnRenamed("concentration", "top10_concentration"), wallets.holder_retention(v).withColumnRenamed("retention", "holder_retention"), wallets.cluster_concentration(v)]
    for key, tables in (("pool_id", by_pool), ("token_id", by_token)):
        for table in tables:
            rows = rows.join(stored(table.join(keys[key], key, "left_semi")), key, "left")
    return rows.drop("pool_id", "token_id", "t")


@query(_FEATURE_SET)
def feature_set(v):
    return _features(v)


def _sql_scale(kind, x: str, low: float, high: float, falling: bool = False) -> str:
    place = {scoring.min_max: f"({x} - ({low}e0)) / ({high}e0 - ({low}e0)) * 100", scoring.log_scale: f"(log10(greatest({x}, {low}e0)) - log10({low}e0)) / (log10({high}e0) - log10({low}e0)) * 100", scoring.bounded_ratio: f"CASE WHEN {x} >= 0 THEN CASE WHEN {x} >= {low} THEN 50 + ({x} - {low}e0) / ({high}e0 - {low}e0) * 50 ELSE {x} / {low}e0 * 50 END END"}[kind]
    inside = f"CASE WHEN {x} IS NOT NULL AND ({place}) IS NOT NULL THEN least(greatest({place}, 0e0), 100e0) END"
    return f"100 - {inside}" if falling else inside


def _sql_mean(parts: dict[str, float]) -> str:
    total, weight = (" + ".join(f"CASE WHEN {x} IS NOT NULL THEN {y} ELSE 0e0 END" for x, y in ((x, f"{x} * {w}e0" if i == 0 else f"{w}e0") for x, w in parts.items())) for i in (0, 1))
    return f"CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) END"


_SCALED = ", ".join(f"{_sql_scale(kind, c, *bounds)} AS {c}_n" for parts in [*scoring.COMPONENTS.values(), scoring.PENALTIES] for c, (_, kind, *bounds) in parts.items())
_MEANS = ", ".join(_sql_mean({f"{c}_n": spec[0] for c, spec in parts.items()}) + f" AS {name}" for name, parts in scoring.COMPONENTS.items())
_SHARE = " + ".join(f"CASE WHEN {name} IS NOT NULL THEN {w}e0 ELSE 0e0 END" for name, w in scoring.WEIGHTS.items())


@query(f"""SELECT signal_id, {", ".join(f"round({c}, 6) AS {c}" for c in scoring.WEIGHTS)}, round(least(greatest(coalesce({_sql_mean(scoring.WEIGHTS)}, 0) - coalesce(cluster_concentration_n, 0) / 100 * 25, 0), 100), 6) AS score, round({_SHARE}, 6) AS coverage, {_SHARE} >= 0.6e0 AS sufficient
    FROM (SELECT signal_id, cluster_concentration_n, {_MEANS} FROM (SELECT signal_id, {_SCALED} FROM ({_FEATURE_SET})))""")
def strategy_score(v):
    """The first strategy's score of every signal, from all its features."""
    rows = scoring.strategy(_features(v)).select("signal_id", *scoring.WEIGHTS, "score", "coverage")
    return rows.withColumn("sufficient", F.col("coverage") >= 0.6).withColumns(six(*scoring.WEIGHTS, "score", "coverage"))


def _findings(v):
    return v.table("documents").select("doc_id", "n_chars").join(v.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")


@query("SELECT doc_id, toxic = 1 AS flagged FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)")
def tri_state(v):
    return _findings(v).select("doc_id", risk.tri(F.col("toxic").cast("string")).alias("flagged"))


_ANSWERED = """, fi AS (SELECT doc_id, n_chars % 10 AS k, CASE WHEN quality IS NOT NULL THEN doc_id % 50 = 0 END AS honeypot, CASE WHEN doc_id % 7 <> 3 THEN false END AS unsellable, toxic = 1 AS blacklist, doc_id % 11 = 0 AS paused, quality = 0 AS mintable,
        CASE WHEN doc_id % 13 = 0 THEN true END AS hidden, doc_id % 17 = 0 AS changes, CASE WHEN n_chars % 4 = 1 THEN 0.05e0 END AS buy_tax, CASE WHEN doc_id % 3 = 0 THEN 0.1e0 END AS sell_tax, CASE WHEN doc_id % 19 = 0 THEN 0e0 ELSE 12e0 END AS lp, CASE WHEN doc_id % 5 <> 0 THEN 9 * (n_chars % 10) / 100e0 END AS top10
    FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
    fx AS (SELECT *, honeypot IS NULL AND mintable IS NULL AND buy_tax IS NULL AND sell_tax IS NULL AS unindexed FROM fi)"""
_FLAGGED = _ANSWERED + """, fl AS (SELECT doc_id, code, message FROM (SELECT doc_id, unnest(CASE WHEN unindexed THEN [{'code': 'UNKNOWN_SECURITY_DATA', 'message': 'security provider has not indexed this token yet'}] ELSE list_filter([
    CASE WHEN honeypot IS NULL OR unsellable IS NULL OR blacklist IS NULL OR mintable IS NULL THEN {'code': 'UNKNOWN_SECURITY_DATA', 'message': concat('security provider omitted: ', array_to_string(list_filter([CASE WHEN honeypot IS NULL THEN 'is_honeypot' END, CASE WHEN unsellable IS NULL THEN 'cannot_sell_all' END, CASE WHEN blacklist IS NULL THEN 'is_blacklisted' END, CASE WHEN mintable IS NULL THEN 'is_mintable' END], lambda x: x IS NOT NULL), ', '))} END,
    CASE WHEN honeypot THEN {'code': 'HONEYPOT', 'message': 'provider reports honeypot'} END, CASE WHEN blacklist THEN {'code': 'BLACKLIST_CAPABILITY', 'message': 'contract can blacklist addresses'} END, CASE WHEN paused THEN {'code': 'TRADING_RESTRICTION', 'message': 'transfers can be paused'} END,
    CASE WHEN mintable THEN {'code': 'OWNER_CAN_MINT', 'message': 'owner can mint additional supply'} END, CASE WHEN hidden THEN {'code': 'OWNER_PRIVILEGES', 'message': 'ownership can be reclaimed or is hidden'} END, CASE WHEN changes THEN {'code': 'OWNER_PRIVILEGES', 'message': 'owner can modify balances'} END,
    CASE WHEN lp = 0 THEN {'code': 'LP_CONCERN', 'message': 'no LP holders reported'} END, CASE WHEN top10 >= 0.4 THEN {'code': 'HOLDER_CONCENTRATION', 'message': concat('top 10 hold ', CAST(9 * k AS BIGINT), '.0% of supply')} END], lambda x: x IS NOT NULL) END) AS u FROM fx), LATERAL (SELECT u.code AS code, u.message AS message))"""


def _answers(v):
    """Documents as tokens with a provider's answer, in JSON as it is sent: text, with blanks and gaps."""
    labels = v.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = v.table("documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    on = lambda n: F.when(F.col("doc_id") % n == 0, "1")
    share = F.struct(F.concat(F.lit(" 0.0"), F.col("n_chars") % 10, F.lit(" ")).alias("percent"))
    blank = F.struct(F.lit("").alias("percent"))
    answer = F.to_json(F.struct(
        F.when(F.col("quality").isNull(), "").otherwise(F.coalesce(on(50), F.lit("0"))).alias("is_honeypot"),
        F.when(F.col("doc_id") % 7 != 3, "0").alias("cannot_sell_all"),
        F.col("toxic").cast("string").alias("is_blacklisted"),
        F.coalesce(on(11), F.lit("0")).alias("transfer_pausable"),
        F.when(F.col("quality") == 0, "1").when(F.col("quality") == 1, "0").alias("is_mintable"),
        F.coalesce(on(13), F.lit("")).alias("hidden_owner"),
        on(17).alias("owner_change_balance"),
        F.when(F.col("n_chars") % 4 == 0, "").when(F.col("n_chars") % 4 == 1, "0.05").when(F.col("n_chars") % 4 == 2, "abc").otherwise(" ").alias("buy_tax"),
        F.when(F.col("doc_id") % 3 == 0, "0.1").alias("sell_tax"),
        F.when(F.col("doc_id") % 19 == 0, "0").otherwise("12").alias("lp_holder_count"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<struct<percent:string>>")).otherwise(F.concat(F.array(blank), F.array_repeat(share, 11))).alias("holders"),
    ))
    read = risk.once(rows.select("doc_id", answer.alias("answer")), p=risk.parsed(F.col("answer")))
    return risk.once(read.select("doc_id", "p"), f=risk.found(F.col("p"))).select("doc_id", "f")


@query(_ANSWERED + " SELECT doc_id, honeypot, unsellable, blacklist, paused, mintable, hidden, buy_tax, sell_tax, lp, round(top10, 6) AS top10, unindexed FROM fx")
def provider_findings(v):
    names = {"is_honeypot": "honeypot", "cannot_sell_all": "unsellable", "is_blacklisted": "blacklist", "transfer_pausable": "paused", "is_mintable": "mintable", "hidden_owner": "hidden", "buy_tax": "buy_tax", "sell_tax": "sell_tax", "lp_holder_count": "lp", "unindexed": "unindexed"}
    return _answers(v).select("doc_id", *(F.col("f")[c].alias(n) for c, n in names.items()), F.round(F.col("f")["top10_percent"], 6).alias("top10"))


def _flags(v):
    return _answers(v).select("doc_id", risk.provider_flags(F.col("f")).alias("flags"))


@query(_FLAGGED + " SELECT doc_id, code, message FROM fl")
def risk_flags(v):
    return _flags(v).select("doc_id", F.explode("flags").alias("f")).select("doc_id", "f.code", "f.message")


_SIMULATED = "CASE WHEN doc_id % 23 = 0 THEN 'UNKNOWN_TRADEABILITY' WHEN doc_id % 31 = 0 THEN 'HONEYPOT' WHEN doc_id % 29 = 0 THEN 'UNKNOWN_TRADEABILITY' WHEN doc_id % 40 >= 10 THEN 'UNUSUAL_TAX' END"


@query(_FLAGGED + f""", al AS (SELECT doc_id, code FROM fl WHERE doc_id % 37 <> 0 UNION ALL SELECT doc_id, 'UNKNOWN_SECURITY_DATA' FROM documents WHERE doc_id % 37 = 0 UNION ALL SELECT doc_id, code FROM (SELECT doc_id, {_SIMULATED} AS code FROM documents) WHERE code IS NOT NULL),
    w AS (SELECT DISTINCT doc_id, code, CASE WHEN code IN ('HONEYPOT', 'BLACKLIST_CAPABILITY', 'TRADING_RESTRICTION') THEN 100 WHEN code IN ('OWNER_CAN_MINT', 'HOLDER_CONCENTRATION', 'UNUSUAL_TAX') THEN 30 WHEN code = 'UNKNOWN_SECURITY_DATA' THEN 5 ELSE 15 END AS weight FROM al)
    SELECT d.doc_id, count(code) AS flags, CASE WHEN bool_or(weight = 100) THEN 'FAIL' WHEN count(code) > 0 THEN 'WARNING' ELSE 'PASS' END AS status, CAST(least(100, coalesce(sum(weight), 0)) AS BIGINT) AS score FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY 1""")
def risk_decision(v):
    """Flags of a simulated trade and of the provider together, and what they come to; every 37th answer of the provider is missing."""
    key = F.col("doc_id")
    can_sell = F.when(key % 31 == 0, False).when(key % 29 != 0, True)
    simulated = risk.simulation_flags(key % 23 != 0, can_sell, (key % 40) / 100, F.lit(None).cast("string"))
    rows = risk.once(_answers(v), all=risk.evaluated(simulated, F.when(key % 37 != 0, F.col("f"))))
    return risk.once(rows, v=risk.verdict(F.col("all"))).select("doc_id", "v.*")


@query("""SELECT o_orderkey, code FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN_TRADEABILITY' WHEN o_orderkey % 7 = 0 THEN 'HONEYPOT' WHEN o_orderkey % 11 = 0 THEN 'UNKNOWN_TRADEABILITY' WHEN o_orderkey % 40 >= 10 THEN 'UNUSUAL_TAX' END AS code FROM orders) WHERE code IS NOT NULL""")
def simulation_flags(v):
    key = F.col("o_orderkey")
    can_sell = F.when(key % 7 == 0, False).when(key % 11 != 0, True)
    found = risk.simulation_flags(key % 5 != 0, can_sell, (key % 40) / 100, F.lit(None).cast("string"))
    return v.table("orders").select("o_orderkey", F.explode(found).alias("f")).select("o_orderkey", "f.code")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('0x', lpad(lower(to_hex(s_suppkey)), 40, 'a')) END AS address, CASE WHEN s_suppkey % 3 <> 0 THEN concat(substr(concat('0x', lpad(lower(to_hex(s_suppkey)), 40, 'a')), 1, 6), '…', right(concat('0x', lpad(lower(to_hex(s_suppkey)), 40, 'a')), 4)) END AS short FROM supplier")
def canonical_address(v):
    raw = F.concat(F.lit("  0X"), F.lpad(F.hex("s_suppkey"), 40, "A"), F.when(F.col("s_suppkey") % 3 == 0, "z").otherwise(" "))
    return v.table("supplier").select("s_suppkey", text.canonical(raw).alias("address")).withColumn("short", text.shorten(F.col("address")))


@query("SELECT doc_id, nullif(substr(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g')), 1, 128), '') AS clean FROM documents")
def sanitize_text(v):
    return v.table("documents").select("doc_id", text.sanitize(F.col("text")).alias("clean"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def escape_html(v):
    return v.table("pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@query(r"""SELECT page_id, concat('GET ', regexp_replace(url, '(https?|wss?)://([^/\s"'']+)/[^\s"'']*', '\1://\2/[REDACTED]', 'g'), ' by [REDACTED] with [REDACTED]') AS clean, md5(regexp_replace(replace(html, 'the-known-secret', '[REDACTED]'), '(https?|wss?)://([^/\s"'']+)/[^\s"'']*', '\1://\2/[REDACTED]', 'g')) AS body FROM pages""")
def redact(v):
    line = F.concat(F.lit("GET "), F.col("url"), F.lit(" by bot123456:" + "Ab-9" * 8 + " with the-known-secret"))
    known = ("the-known-secret", "short")
    return v.table("pages").select("page_id", text.redact(line, known).alias("clean"), F.md5(text.redact(F.col("html"), known).cast("binary")).alias("body"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'history' WHEN 1 THEN 'range' WHEN 2 THEN 'rate' ELSE 'transient' END END AS class FROM events")
def classify_error(v):
    message = F.when(F.col("event_id") % 4 == 0, "state is PRUNED").when(F.col("event_id") % 4 == 1, "Block range too wide").when(F.col("event_id") % 4 == 2, "HTTP 429").otherwise("socket closed")
    return v.table("events").select("event_id", F.when(F.col("event_type") == "error", text.error_class(message)).alias("class"))


@query(r"""SELECT page_id, regexp_replace(url, '(https?|wss?)://([^/\s"'']+)/[^\s"'']*', '\1://\2/[REDACTED]', 'g') AS first, 'key [REDACTED]' AS second, page_id * 2 AS n FROM pages""")
def redact_nested(v):
    """Secrets within structs, arrays and maps."""
    rows = v.table("pages").select("page_id", F.struct(F.array(F.struct(F.col("url").alias("u"))).alias("list"), F.create_map(F.lit("k"), F.lit("key the-known-secret")).alias("map"), (F.col("page_id") * 2).alias("n")).alias("x"))
    clean = rows.select("page_id", text.redact_deep(F.col("x"), rows.schema["x"].dataType, ("the-known-secret",)).alias("x"))
    return clean.select("page_id", F.col("x.list")[0]["u"].alias("first"), F.col("x.map")["k"].alias("second"), F.col("x.n").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN event_id % 2 = 0 AND event_id % 4 = 0 ELSE coalesce(status IN (401, 403, 404) OR (status = 400 AND event_id % 3 = 0), false) END AS everywhere, CASE WHEN status IS NULL THEN 'TypeError' ELSE concat('HTTP_', status) END AS code
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 400 WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 500 END AS status FROM events)""")
def delivery_failure(v):
    """Which failed deliveries count toward the circuit, and their codes."""
    key = F.col("event_id")
    status = F.when(key % 5 == 0, 400).when(key % 5 == 1, 401).when(key % 5 == 2, 404).when(key % 5 == 3, 500)
    hint = delivery.transport_fault(status, F.when(key % 3 == 0, "Bad Request: CHAT not found").otherwise("can't parse entities"))
    return v.table("events").select("event_id", delivery.global_failure(key % 6 == 0, key % 4 == 0, hint, status).alias("everywhere"), delivery.failure_code(status, F.lit("TypeError")).alias("code"))


@query("SELECT c_custkey, CASE WHEN m < 0 THEN 'not measured' WHEN m < 60 THEN concat(m, 'm') WHEN m % 60 = 0 THEN concat(m // 60, 'h') ELSE concat(m // 60, 'h ', m % 60, 'm') END AS age FROM (SELECT c_custkey, c_custkey * 17 % 5000 - 60 AS m FROM customer)")
def format_age(v):
    return v.table("customer").select("c_custkey", text.age((F.col("c_custkey") * 17 % 5000 - 60).cast("double")).alias("age"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'not measured' WHEN x = 0 THEN '$0.00' ELSE concat('$', CASE WHEN k % 10 = 0 THEN CAST(k // 10 AS VARCHAR) ELSE format('{:.1f}', k / 10.0e0) END, unit) END AS money
    FROM (SELECT o_orderkey, x, CAST(floor(x / d * 10 + 0.5e0) AS BIGINT) AS k, CASE d WHEN 1e6 THEN 'M' WHEN 1e3 THEN 'K' ELSE '' END AS unit FROM (SELECT *, CASE WHEN x >= 1e6 THEN 1e6 WHEN x >= 1e3 THEN 1e3 ELSE 1e0 END AS d FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 5) AS x FROM orders)))""")
def format_money(v):
    return v.table("orders").select("o_orderkey", text.money(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") * (F.col("o_orderkey") % 5))).alias("money"))


@query("SELECT s.signal_id, s.token_id, n.n_name AS token_name FROM signals s JOIN customer c ON c.c_custkey = s.token_id JOIN nation n ON n.n_nationkey = c.c_nationkey")
def signal_context(v):
    pools = v.table("customer").select(F.col("c_custkey").alias("token_id"), "c_nationkey")
    return v.signals.join(pools, "token_id").join(F.broadcast(v.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("signal_id", "token_id", F.col("n_name").alias("token_name"))


_STATE = "CASE WHEN alpha >= 75 THEN 'STRONG_SIGNAL' WHEN alpha >= 60 THEN 'INTERESTING' ELSE 'WATCHING' END"


def _state():
    return F.when(F.col("alpha") >= 75, "STRONG_SIGNAL").when(F.col("alpha") >= 60, "INTERESTING").otherwise("WATCHING")


@query(f"SELECT token_id, signal_id, {_STATE} AS state FROM signals QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY signal_id DESC) = 1")
def current_signal(v):
    return joins.latest_by(v.signals.withColumn("state", _state()), ["token_id"], ["signal_id"], ["state"]).select("token_id", "signal_id", "state")


@query("SELECT token_id, signal_id, alpha FROM signals WHERE alpha >= 60 AND signal_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY signal_id DESC) = 1")
def last_alert(v):
    return joins.latest_by(v.signals.filter("alpha >= 60 AND signal_id % 3 <> 0"), ["token_id"], ["signal_id"], ["alpha"]).select("token_id", "signal_id", "alpha")


@query(f"SELECT signal_id, CASE state WHEN 'STRONG_SIGNAL' THEN 'STRONG' WHEN 'INTERESTING' THEN 'INTERESTING' ELSE 'NONE' END AS level, state <> 'EXPIRED' AS active FROM (SELECT signal_id, CASE WHEN signal_id % 9 = 0 THEN 'EXPIRED' ELSE {_STATE} END AS state FROM signals)")
def alert_level(v):
    state = F.when(F.col("signal_id") % 9 == 0, "EXPIRED").otherwise(_state())
    return v.signals.select("signal_id", text.alert_level(state).alias("level"), text.is_active(state).alias("active"))


@query("""SELECT s.signal_id, n.n_name AS name, l.liquidity, r.status FROM signals s JOIN customer c ON c.c_custkey = s.token_id JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN (SELECT pool_id, liquidity FROM snapshots QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY t DESC, snapshot_id DESC) = 1) l ON l.pool_id = s.token_id
    LEFT JOIN (SELECT o_custkey, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) r ON r.o_custkey = s.token_id WHERE s.alpha >= 60""")
def alert_payload(v):
    tokens = v.table("customer").select(F.col("c_custkey").alias("token_id"), "c_nationkey").join(F.broadcast(v.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))), "c_nationkey")
    snaps = joins.latest_by(v.snapshots, ["pool_id"], ["t", "snapshot_id"], ["liquidity"]).select(F.col("pool_id").alias("token_id"), "liquidity")
    risks = joins.latest_by(v.table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select(F.col("o_custkey").alias("token_id"), F.col("o_orderstatus").alias("status"))
    return v.signals.filter("alpha >= 60").join(tokens, "token_id").join(snaps, "token_id", "left").join(risks, "token_id", "left").select("signal_id", "name", "liquidity", "status")


def _sql_money(x: str) -> str:
    scale = f"CASE WHEN {x} >= 1e6 THEN 1e6 WHEN {x} >= 1e3 THEN 1e3 ELSE 1e0 END"
    k = f"CAST(floor({x} / {scale} * 10 + 0.5e0) AS BIGINT)"
    return f"CASE WHEN {x} IS NULL THEN 'not measured' ELSE concat('$', CASE WHEN {k} % 10 = 0 THEN CAST({k} // 10 AS VARCHAR) ELSE format('{{:.1f}}', {k} / 10.0e0) END, CASE WHEN {x} >= 1e6 THEN 'M' WHEN {x} >= 1e3 THEN 'K' ELSE '' END) END"


_PLACE = "concat('0x', lpad(lower(to_hex(signal_id)), 40, '0'))"


@query(f""", pay AS (SELECT * FROM ({ORACLE_SQL["alert_payload"]}))
    SELECT signal_id, array_to_string(list_concat(['🚨 STRONG SIGNAL (score moved)', concat('TOKEN: $', name), concat('CA: <code>', {_PLACE}, '</code>'), 'Age: 1h 15m', concat('MC: ', {_sql_money("(liquidity * 10)")}), concat('Liquidity: ', {_sql_money("liquidity")}), 'Score: 80/100', '', 'Why:',
        '• Liquidity: 80/100', '• Smart Money: not measured', '• Evidence coverage: 75%', '', 'Risk:'],
        CASE WHEN status = 'F' AND liquidity IS NULL THEN ['🛑 sells &lt;fail&gt;', 'ℹ no liquidity'] WHEN status = 'F' THEN ['🛑 sells &lt;fail&gt;'] WHEN liquidity IS NULL THEN ['ℹ no liquidity'] WHEN status IS NULL THEN ['• not yet evaluated'] ELSE [concat('• ', status, ', no warnings')] END,
        ['', concat('<a href="https://dexscreener.com/base/', {_PLACE}, '">DexScreener</a> | <a href="https://www.geckoterminal.com/base/pools/', {_PLACE}, '">GeckoTerminal</a>')]), chr(10)) AS text FROM pay""")
def render_alert(v):
    rows = alert_payload(v)
    note = lambda severity, message: F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    notes = F.array_compact(F.array(F.when(F.col("status") == "F", note("CRITICAL", "sells <fail>")), F.when(F.col("liquidity").isNull(), note("LOW", "no liquidity"))))
    parts = F.array(F.struct(F.lit("liquidity").alias("name"), F.lit(80.0).alias("raw")), F.struct(F.lit("smartMoney").alias("name"), F.lit(None).cast("double").alias("raw")))
    place = F.lpad(F.lower(F.hex("signal_id")), 40, "0")
    alert = F.struct(F.lit("STRONG").alias("level"), F.lit("SCORE_MOVED").alias("trigger"), F.col("name").alias("symbol"), F.concat(F.lit("0x"), place).alias("token"), F.concat(F.lit("0x"), place).alias("pool"), F.lit(75.0).alias("age"), (F.col("liquidity") * 10).alias("market_cap"), F.col("liquidity"), F.lit(80.4).alias("score"), F.lit(0.75).alias("coverage"), parts.alias("components"), F.col("status"), notes.alias("flags"))
    return rows.select("signal_id", text.render_alert(alert).alias("text"))


def evaluations(v):
    """Every event as an evaluation of its user's token."""
    base = 1704067200000000
    return v.table("events").select(
        F.col("user_id").alias("token_id"), F.col("event_id").alias("seq"), ((F.unix_micros(F.col("ts").cast("timestamp")) - base) / MINUTE).alias("minute"), F.get_json_object("props", "$.k").cast("double").alias("alpha"), (F.col("event_id") % 3 != 0).alias("sufficient"),
        F.when(F.col("event_id") % 101 == 0, "FAIL").otherwise("PASS").alias("risk"), (F.col("event_id") % 400).cast("double").alias("age"), F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 31).cast("double")).alias("idle"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("liquidity"), F.lit(100.0).alias("peak"),
    )


#: The fold, a step a recursion: rn is a token's n-th evaluation; at_* is what the last alert left.
_FOLDED = """, ev AS (SELECT user_id AS token_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, (epoch_us(ts) - 1704067200000000) / 6e7 AS minute, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS alpha, event_id % 3 <> 0 AS sufficient,
        event_id % 101 = 0 AS failed, event_id % 400 AS age, CASE WHEN event_id % 5 <> 0 THEN event_id % 31 END AS idle, CASE WHEN event_id % 7 <> 0 THEN value END AS liquidity FROM events),
    fo(token_id, seq, rn, state, changed, reason, level, sent, alert, at_level, at_score, at_minute) AS (
        SELECT DISTINCT user_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 'NEW', false, '', 'NONE', false, '', 0, 0e0, 0e0 FROM events
        UNION ALL SELECT token_id, seq, rn, state, state <> before, reason, level, alert NOT IN ('no_alert_level', 'suppressed_duplicate'), alert, CASE WHEN alert NOT IN ('no_alert_level', 'suppressed_duplicate') THEN power ELSE at_level END,
               CASE WHEN alert NOT IN ('no_alert_level', 'suppressed_duplicate') THEN alpha ELSE at_score END, CASE WHEN alert NOT IN ('no_alert_level', 'suppressed_duplicate') THEN minute ELSE at_minute END
        FROM (SELECT *, CASE WHEN power = 0 THEN 'no_alert_level' WHEN at_level = 0 THEN 'first_alert' WHEN power > at_level THEN 'level_upgraded' WHEN abs(alpha - at_score) >= 10 THEN 'score_moved' WHEN minute - at_minute >= 60 THEN 'cooldown_elapsed' ELSE 'suppressed_duplicate' END AS alert
        FROM (SELECT *, CASE state WHEN 'INTERESTING' THEN 'INTERESTING' WHEN 'STRONG_SIGNAL' THEN 'STRONG' ELSE 'NONE' END AS level, CASE state WHEN 'INTERESTING' THEN 1 WHEN 'STRONG_SIGNAL' THEN 2 ELSE 0 END AS power
        FROM (SELECT *, CASE WHEN why IN ('risk_fail', 'age_limit', 'inactivity', 'liquidity_collapse') THEN 'EXPIRED' WHEN why = 'risk_cleared' THEN 'WATCHING' WHEN why = 'up' THEN goal ELSE before END AS state, CASE WHEN why = 'up' THEN concat('alpha_', lower(goal)) ELSE why END AS reason
        FROM (SELECT *, CASE WHEN before = 'EXPIRED' THEN 'already_expired' WHEN failed THEN 'risk_fail' WHEN age > 360 THEN 'age_limit' WHEN idle > 30 THEN 'inactivity' WHEN liquidity < 20 THEN 'liquidity_collapse' WHEN before = 'NEW' THEN 'risk_cleared'
            WHEN list_position(['WATCHING', 'INTERESTING', 'STRONG_SIGNAL'], goal) > list_position(['WATCHING', 'INTERESTING', 'STRONG_SIGNAL'], before) THEN 'up' ELSE 'no_change' END AS why
        FROM (SELECT ev.*, fo.state AS before, at_level, at_score, at_minute, CASE WHEN alpha >= 75 AND sufficient THEN 'STRONG_SIGNAL' WHEN alpha >= 60 THEN 'INTERESTING' ELSE 'WATCHING' END AS goal FROM fo JOIN ev ON ev.token_id = fo.token_id AND ev.rn = fo.rn + 1)))))) """


@query(_FOLDED + " SELECT token_id, seq, state, changed, reason FROM fo WHERE rn > 0")
def signal_states(v):
    return states.signal_states(evaluations(v)).select("token_id", "seq", "state", "changed", "reason")


@query(_FOLDED + " SELECT token_id, seq, level, sent, alert FROM fo WHERE rn > 0")
def alert_dedupe(v):
    return states.signal_states(evaluations(v)).select("token_id", "seq", "level", "sent", "alert")


@query(""", att AS (SELECT user_id % 16 AS notifier, event_id AS seq, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS rn, epoch_us(ts) / 6e7 AS minute, event_type <> 'error' AS ok, event_id % 2 = 0 AS everywhere FROM events),
    ci(notifier, seq, rn, allowed, probe, state, failures, edge, reopen, opened) AS (
        SELECT DISTINCT user_id % 16, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false, false, 'CLOSED', CAST(0 AS BIGINT), '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM events
        UNION ALL SELECT notifier, seq, rn, allowed, probe, CASE WHEN NOT allowed THEN was WHEN ok THEN 'CLOSED' WHEN NOT everywhere THEN was WHEN opens THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN NOT allowed THEN n WHEN ok THEN 0 WHEN NOT everywhere THEN n ELSE n + 1 END,
               CASE WHEN NOT allowed THEN 'held' WHEN ok THEN CASE WHEN was <> 'CLOSED' THEN 'closed' ELSE 'none' END WHEN everywhere AND opens AND was = 'CLOSED' THEN 'opened' ELSE 'none' END,
               CASE WHEN NOT allowed THEN reopen WHEN ok THEN NULL WHEN NOT everywhere THEN reopen WHEN opens THEN minute + 5 END, CASE WHEN NOT allowed THEN opened WHEN ok THEN NULL WHEN NOT everywhere THEN opened WHEN opens THEN CASE WHEN was <> 'CLOSED' THEN opened ELSE minute END END
        FROM (SELECT att.*, ci.state AS was, ci.failures AS n, ci.reopen, ci.opened, ci.state <> 'CLOSED' AND minute >= ci.reopen AS probe, ci.state = 'CLOSED' OR minute >= ci.reopen AS allowed, ci.state <> 'CLOSED' OR ci.failures + 1 >= 3 AS opens FROM ci JOIN att ON att.notifier = ci.notifier AND att.rn = ci.rn + 1))
    SELECT notifier, seq, allowed, coalesce(probe, false) AS probe, state, failures, edge, opened FROM ci WHERE rn > 0""")
def circuit_breaker(v):
    attempts = v.table("events").select((F.col("user_id") % 16).alias("notifier"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / MINUTE).alias("minute"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 2 == 0).alias("everywhere"))
    return states.circuit_breaker(attempts)
