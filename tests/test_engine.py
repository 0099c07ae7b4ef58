"""Fixed values, folds against plain loops, and rewrites against their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import decode, exact, features, scoring, text
from tidemark.operators import evaluation as ev
from tidemark.operators import holders, joins, outcomes, report, risk, states, upserts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("values, q, want", [([1, 2, 3, 4], 0.5, 2.5), ([1, 2, 3, 4], 0.25, 1.75), ([1, 2, 3, 4, 5], 0.25, 2.0)])
def test_quantiles(spark, values, q, want):
    assert spark.createDataFrame([(float(v),) for v in values], "x double").agg(F.percentile("x", F.lit(q))).first()[0] == want


def test_distribution_and_wilson(spark):
    row = ev.distribution(spark.createDataFrame([(float(v),) for v in (-50, -20, -5, 2, 4000)], "x double"), [], "x").first()
    assert (row.median, row["mean"], row.lowest, row.highest) == (-5.0, 785.4, -50.0, 4000.0)
    low, high = (one(spark, c) for c in ev.wilson(F.lit(5), F.lit(10))[1:])
    assert (round(low, 4), round(high, 4)) == (0.2366, 0.7634)


@pytest.mark.parametrize("values, want", [([10, 20, -10], (3.0, "finite")), ([5, 10], (None, "infinite")), ([-5, -10], (0.0, "finite")), ([0, 0], (None, "flat"))])
def test_profit_factor(spark, values, want):
    gain, loss = sum(v for v in values if v > 0), -sum(v for v in values if v <= 0)
    assert tuple(one(spark, c) for c in ev.profit_factor(F.lit(float(gain)), F.lit(float(loss)), F.lit(len(values)))) == want


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, 39.9, 40.0, 60.0, 75.0, 90.0, 100.0)], "x double").select(ev.band(F.col("x")).alias("b")).collect()
    assert [r.b for r in rows] == [None, "IGNORE", "WATCHING", "INTERESTING", "STRONG", "HIGH_CONVICTION", "HIGH_CONVICTION"]


def test_spearman_of_constants_and_few(spark):
    rows = [("a", 1.0, 5.0), ("a", 2.0, 5.0), ("a", 3.0, 5.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 4.0), ("c", 3.0, 9.0), ("c", None, 1.0)]
    got = {r.g: (r.n, r.rho) for r in ev.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["a"] == (3, None) and got["b"] == (2, None) and got["c"][0] == 3 and got["c"][1] == pytest.approx(1.0)


def test_metrics(spark):
    rows = [("up", 10.0, 3, 3, 12.0, 30.0, 5.0), ("falls", 10.0, 2, 2, 4.0, 8.0, 4.0), ("quiet", 10.0, 0, 0, None, None, None), ("dead", 0.0, 1, 1, 1.0, 1.0, 1.0), ("thin", 10.0, 10, 7, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id string, price double, trade_count long, priced_count long, last_price double, max_price double, min_price double")
    got = {r.id: (r.failure_reason, r.return_pct, r.max_runup_pct, r.max_drawdown_pct) for r in outcomes.metrics(df).collect()}
    assert got["up"] == (None, 20.0, 200.0, -50.0)
    assert got["falls"] == (None, -60.0, 0.0, -60.0)
    assert got["quiet"] == (None, 0.0, 0.0, 0.0)
    assert got["dead"][:2] == ("no_signal_price", None) and got["thin"][:2] == ("insufficient_quote_coverage", None)


def test_exact_arithmetic(spark):
    rate = exact.parse("2462.309482")
    assert exact.fused_price(-1838405276892001700105232, 15677718585, 18, 18, rate) == 20998305
    assert exact.cut(-7, 2) == -3 and exact.cut(7, -2) == -3 and exact.cut(1, 0) is None
    assert exact.render(exact.parse("-0.0500")) == "-0.05" and exact.parse("1.0000000000000000019") == 10**18 + 1
    with pytest.raises(ValueError):
        exact.parse("1e5")
    df = spark.createDataFrame([("1.5", "2"), ("1", "0"), (None, "1")], "a string, b string")
    assert [r.d for r in df.select(exact.scaled_div("a", "b").alias("d")).collect()] == ["0.75", None, None]
    assert one(spark, exact.word_signed(F.lit("f" * 64))) == "-1"


def test_decoders(spark):
    word = lambda n: f"{n % (1 << 256):064x}"
    a, b = "0x" + "00" * 12 + "11" * 20, "0x" + "00" * 12 + "22" * 20
    names = {v: k for k, v in decode.SWAPPED.items()}
    logs = [
        ("0xAA", [names["uniswap-v2"], a, b], "0x" + word(5) + word(0) + word(0) + word(10**30), 7, "0xF0", 1),
        ("0xAB", [names["uniswap-v3"], a, b], "0x" + word(10**40) + word(-(10**40) - 1) + word(1) + word(2) + word(3), 7, "0xF1", 2),
        ("0xAC", ["0x" + "12" * 32], "0x", 7, "0xF2", 3),
        ("0xAD", [names["aerodrome"], a, b], "0x" + word(1) * 4, None, "0xF3", 4),
        ("0xAE", [decode.TRANSFERRED, a, b], "0x" + word(1 << 200), 8, "0xF4", 5),
    ]
    df = spark.createDataFrame(logs, "address string, topics array<string>, data string, block_number long, tx_hash string, log_index int")
    got = {r.dex: r for r in decode.swaps(df).collect()}
    assert set(got) == {"uniswap-v2", "uniswap-v3"}
    assert (got["uniswap-v2"].amount0, got["uniswap-v2"].amount1, got["uniswap-v2"].wallet) == ("5", str(-(10**30)), "0x" + "22" * 20)
    assert (got["uniswap-v3"].amount0, got["uniswap-v3"].amount1) == (str(10**40), str(-(10**40) - 1))
    (moved,) = decode.transfers(df).collect()
    assert moved.value == str(1 << 200) and moved.source == "0x" + "11" * 20
    made = {v: k for k, v in decode.CREATED.items()}
    pools = [("0x1", [made["uniswap-v3"], a, b, "0x" + word(100)], "0x" + word(1) + "00" * 12 + "33" * 20, 1, "0xf", 0), ("0x1", [made["aerodrome"], a, b, "0x" + word(0)], "0x" + "00" * 12 + "44" * 20 + word(9), 1, "0xf", 1)]
    got = {r.dex: r for r in decode.pools(spark.createDataFrame(pools, df.schema)).collect()}
    assert (got["uniswap-v3"].fee, got["uniswap-v3"].pool, got["aerodrome"].stable, got["aerodrome"].pool) == (100, "0x" + "33" * 20, False, "0x" + "44" * 20)


def test_clamped_balances_equal_the_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for wallet in range(30):
        balance, low = 0, False
        for batch in range(12):
            change = rng.randint(-50, 40)
            rows.append((1, wallet, batch, change))
            low, balance = low or balance + change < 0, max(0, balance + change)
        want[wallet] = (balance, low)
    got = {r.wallet: (r.balance, r.partially_observed) for r in holders.balances(spark.createDataFrame(rows, "token_id long, wallet long, batch long, change long")).collect()}
    assert got == want


def test_range_and_nearest_joins_equal_loops(spark):
    rng = random.Random(2)
    windows = [(i, rng.randrange(3), s := rng.randrange(1000), s + rng.randrange(-5, 200)) for i in range(40)]
    points = [(rng.randrange(3), rng.randrange(1200), i) for i in range(300)]
    w, p = spark.createDataFrame(windows, "id long, k long, start long, end long"), spark.createDataFrame(points, "k long, t long, v long")
    got = sorted((r.id, r.v) for r in joins.range_join(w, p, ["k"], 37).collect())
    assert got == sorted((i, v) for i, k, s, e in windows for q, t, v in points if k == q and s <= t <= e)
    left = w.select("id", "k", F.col("start").alias("at"))
    got = {r.id: r.v for r in joins.nearest(left, p, ["k"], "id", "v", 10).collect()}
    for i, k, s, _ in windows:
        near = min(((abs(t - s), t, v) for q, t, v in points if q == k and abs(t - s) <= 10), default=(0, 0, None))
        assert got[i] == near[2]


def test_sinks(spark):
    start, end = upserts.plan_range(F.lit(None).cast("long"), F.lit(100), 5, 20, 10, F.lit(True))
    assert (one(spark, start), one(spark, end)) == (75, 95)
    start, _ = upserts.plan_range(F.lit(90), F.lit(100), 5, 20, 10, F.lit(True))
    assert one(spark, start) == 81
    chunks = one(spark, upserts.chunk_range(F.lit(1).cast("long"), F.lit(25).cast("long"), 10))
    assert [(c["from"], c["to"]) for c in chunks] == [(1, 10), (11, 20), (21, 25)]
    assert one(spark, upserts.chunk_range(F.lit(5).cast("long"), F.lit(4).cast("long"), 10)) == []
    seen = spark.createDataFrame([("s", 5, 10, "h5", 1), ("s", 7, 12, "h7", 2), ("s", 7, 11, None, 3), ("u", 4, 9, "h", 1), ("u", 6, 8, None, 2)], "source string, block long, t long, hash string, seq long")
    assert {r.source: (r.block, r.t, r.hash) for r in upserts.advance(seen, "source").collect()} == {"s": (7, 12, "h7"), "u": (6, 9, None)}


def test_scores(spark):
    low, share = scoring.component([(F.lit(None).cast("double"), 0.5), (F.lit(100.0), 0.5)])
    assert (one(spark, low), one(spark, share)) == (100.0, 0.5)
    zero, _ = scoring.component([(F.lit(None).cast("double"), 0.7), (F.lit(100.0), 0.3)], "zero")
    assert one(spark, zero) == pytest.approx(30.0)
    _, coverage = scoring.alpha([(F.lit(50.0), 0.2), (F.lit(None).cast("double"), 0.3), (F.lit(50.0), 0.2), (F.lit(50.0), 0.3)], F.lit(0.0))
    assert one(spark, coverage) == pytest.approx(0.7)
    assert one(spark, features.acceleration(F.lit(50000.0), [F.lit(10000.0), F.lit(12000.0), F.lit(8000.0)])) == 5.0
    assert one(spark, features.acceleration(F.lit(5.0), [F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0)])) is None
    neutral, bare = scoring.component([(F.lit(None).cast("double"), 0.5)], "neutral")
    assert (one(spark, neutral), one(spark, bare)) == (50.0, 0.0)
    ratios = [(-1.0, 1, 4, None), (0.0, 1, 4, 0.0), (0.5, 1, 4, 25.0), (1.0, 1, 4, 50.0), (2.5, 1, 4, 75.0), (9.0, 1, 4, 100.0), (1.0, 0, 4, None), (1.0, 4, 4, None), (float("inf"), 1, 4, None)]
    assert [one(spark, scoring.bounded_ratio(F.lit(x), n, top)) for x, n, top, _ in ratios] == [r[-1] for r in ratios]
    assert one(spark, scoring.bounded_ratio(F.lit(0.5), 1, 4, falling=True)) == 75.0
    assert one(spark, scoring.log_scale(F.lit(10.0), 1, 100, True)) == pytest.approx(50.0) and one(spark, scoring.log_scale(F.lit(0.0), 1, 5)) == 0.0
    assert one(spark, scoring.min_max(F.lit(5.0), 3.0, 3.0)) is None


def test_text(spark):
    assert one(spark, text.escape_html(F.lit("a<b>&c"))) == "a&lt;b&gt;&amp;c"
    assert one(spark, text.sanitize(F.lit(" \x07\n "))) is None
    assert one(spark, text.canonical(F.lit(" 0xAB" + "cd" * 19))) == "0xab" + "cd" * 19
    assert one(spark, text.redact(F.lit("see wss://node.example/v2/abc?x=1, bot123456:" + "Az-9" * 8 + " 0xsecretkey end"), ("0xsecretkey", "end"))) == "see wss://node.example/[REDACTED] [REDACTED] [REDACTED] end"
    ages = [None, -1.0, float("nan"), 0.9, 59.0, 60.0, 61.5, 1500.0]
    assert [one(spark, text.age(F.lit(x).cast("double"))) for x in ages] == ["not measured"] * 3 + ["0m", "59m", "1h", "1h 1m", "25h"]
    sums = [None, float("inf"), 0.0, 1.0, 1.25, 950.0, 420_000.0, 1_240_000.0, 3e9, 0.5, 0.0123456, 0.00001234, 1.234e-7, -1500.0]
    assert [one(spark, text.money(F.lit(x).cast("double"))) for x in sums] == ["not measured", "not measured", "$0.00", "$1", "$1.3", "$950", "$420K", "$1.2M", "$3B", "$0.500", "$0.0123", "$0.0000123", "$1.23e-7", "$-1.5K"]
    assert [one(spark, text.error_class(F.lit(x))) for x in ("State unavailable", "up to a 10 block range", "ETIMEDOUT", "boom", None)] == ["history", "range", "rate", "transient", "transient"]


def test_alert_text(spark):
    schema = "a struct<level string, trigger string, symbol string, token string, pool string, age double, market_cap double, liquidity double, score double, coverage double, components array<struct<name string, raw double>>, status string, flags array<struct<severity string, message string>>>"
    rows = [(("STRONG", "LEVEL_UPGRADED", "<X>", "0xaa", "0xbb", 61.0, None, 1500.0, 80.5, 0.75, [("liquidity", 80.2), ("smartMoney", None), ("own", 1.0)], "FAIL", [("CRITICAL", "a&b"), ("LOW", "c")]),), (("INTERESTING", "FIRST_ALERT", None, "0xaa", "0xbb", 5.0, 1.0, 1.0, 60.0, 1.0, [], None, []),)]
    links = '<a href="https://dexscreener.com/base/0xbb">DexScreener</a> | <a href="https://www.geckoterminal.com/base/pools/0xbb">GeckoTerminal</a>'
    strong, other = (r.x.split("\n") for r in spark.createDataFrame(rows, schema).select(text.render_alert(F.col("a")).alias("x")).collect())
    assert strong == ["\U0001f6a8 STRONG SIGNAL (upgraded)", "TOKEN: $&lt;X&gt;", "CA: <code>0xaa</code>", "Age: 1h 1m", "MC: not measured", "Liquidity: $1.5K", "Score: 81/100", "", "Why:", "• Liquidity: 80/100", "• Smart Money: not measured", "• own: 1/100", "• Evidence coverage: 75%", "", "Risk:", "\U0001f6d1 a&amp;b", "ℹ c", "", links]
    assert other[:2] == ["\U0001f440 INTERESTING", "TOKEN: $UNKNOWN"] and other[7:] == ["", "Why:", "", "Risk:", "• not yet evaluated", "", links]


def test_provider_answers(spark):
    full = '{"is_honeypot":"0","cannot_sell_all":"0","is_blacklisted":"0","transfer_pausable":"0","is_mintable":"1","buy_tax":" 0.05","holders":[' + ",".join(['{"percent":"0.05"}'] * 12) + '],"lp_holder_count":"0"}'
    rows = [(0, full), (1, "{}"), (2, "not json"), (3, None), (4, '{"buy_tax":"0","is_honeypot":"1","holders":[{"percent":"x"}]}'), (5, full.replace("0.05", "6"))]
    got = spark.createDataFrame(rows, "k int, j string").select("k", risk.findings(F.col("j")).alias("f")).select("k", "f", risk.provider_flags(F.col("f")).alias("flags")).orderBy("k").collect()
    assert [r.f.unindexed for r in got] == [False, True, True, True, False, False]
    assert (got[0].f.buy_tax, round(got[0].f.top10_percent, 9), got[4].f.top10_percent, got[1].f.top10_percent) == (0.05, 0.5, 0.0, None)
    assert [f.code for f in got[0].flags] == ["OWNER_CAN_MINT", "LP_CONCERN", "HOLDER_CONCENTRATION"] and got[0].flags[2].message == "top 10 hold 50.0% of supply"
    assert [f.code for r in got[1:4] for f in r.flags] == ["UNKNOWN_SECURITY_DATA"] * 3
    assert [f.message for f in got[4].flags] == ["security provider omitted: cannot_sell_all, is_blacklisted, transfer_pausable, is_mintable", "provider reports honeypot"]
    assert got[5].flags[-1].message == "top 10 hold 60.0% of supply"


def test_simulations(spark):
    rows = [(None, None, None, None), (False, None, None, "thin"), (True, False, 0.5, "x"), (True, None, 0.5, None), (True, True, 0.25, None), (True, True, 0.1, None), (True, True, 0.09, None), (True, True, None, None)]
    got = spark.createDataFrame(rows, "b boolean, s boolean, t double, r string").coalesce(1).select(risk.simulation_flags(*map(F.col, "bstr")).alias("f")).collect()
    assert [[(f.code, f.severity, f.action) for f in r.f] for r in got] == [[("UNKNOWN_TRADEABILITY", "MEDIUM", "WARNING")], [("UNKNOWN_TRADEABILITY", "MEDIUM", "WARNING")], [("HONEYPOT", "CRITICAL", "FAIL")], [("UNKNOWN_TRADEABILITY", "MEDIUM", "WARNING")], [("UNUSUAL_TAX", "HIGH", "WARNING")], [("UNUSUAL_TAX", "HIGH", "WARNING")], [], []]
    assert [r.f[0].message if r.f else None for r in got][4:6] == ["round-trip token tax 25.0% at or above the fail threshold", "round-trip token tax 10.0%"]


def evaluation(**more):
    return {"token_id": 1, "seq": 1, "minute": 0.0, "alpha": 50.0, "sufficient": True, "risk": "PASS", "age": 1.0, "idle": None, "liquidity": None, "peak": None} | more


def test_report(spark):
    from tidemark.plans import measure
    from tidemark.sources.views import Views

    schema = "version string, horizon string, token_id long, alpha double, coverage double, return_pct double, max_runup_pct double, max_drawdown_pct double, failure_reason string, features map<string,double>"
    rows = [("v1", "1h", i, 80.0, 0.9, float(i + 1), float(i + 2), -1.0, None, {"x": float(i), "same": 1.0}) for i in range(4)]
    rows += [("v1", "5m", 9, 10.0, 0.1, -2.5, 0.0, -3.0, None, {}), ("v1", "1h", 9, 80.0, 0.9, None, None, None, "incomplete_tail_coverage", {}), ("v1", "1h", 9, 80.0, 0.9, None, None, None, None, None), ("v2", "1h", 1, 80.0, 0.9, 1.0, 1.0, 1.0, None, {})]
    shown = report.render(spark.createDataFrame(rows, schema), "v1", "now", 4)
    lines = [" ".join(x.split()) for x in shown.split("\n")]
    assert "STRONG 1h 6 (5 tok) 4 100% [51–100] +2.5% +2.5% +1.3% / +3.7% +3.5% / -1.0% ∞ (no losses yet)" in lines
    assert "IGNORE 5m 1 (1 tok) 1 INSUFFICIENT — need more outcomes" in lines and "x 1h 4/4 1.00" in lines and "same 1h 4/4 — (no variation)" in lines
    assert any(x.startswith("!! 1 of 7 samples (14.3%)") for x in lines) and "incomplete_tail_coverage 1" in lines and "unknown 1" in lines
    assert report.render(spark.createDataFrame(rows, schema), "v3", "now") == ""
    whole = measure.samples(Views(spark, "/root/testdata/sf0.001")).withColumn("features", F.create_map(F.lit("coverage"), F.col("coverage")))
    assert "Outcomes by score band" in report.render(whole, "v1", "now")


def test_overlaps_equal_the_loop(spark):
    rng = random.Random(5)
    windows = [(i, s, s + rng.randint(0, 50)) for i in range(60) for s in [rng.randint(-100, 400)]]
    spans = [(a, None if rng.random() < 0.1 else (a or 0) + rng.randint(0, 30)) for _ in range(25) for a in [None if rng.random() < 0.1 else rng.randint(-150, 450)]]
    for part in (spans, spans[:3], []):
        got = joins.overlapping(spark.createDataFrame(windows, "k int, start long, end long"), spark.createDataFrame(part, "from_t long, to_t long"), 20, F.col("k") > 2)
        want = {k for k, s, e in windows if k > 2 and any((a is None or a <= e) and (b is None or b >= s) for a, b in part)}
        assert {r.k for r in got.collect()} == want


def test_signal_machine():
    policy = states.Policy()
    kept, told = states.step(states.Signal(), evaluation(alpha=90.0), policy)
    assert (kept.state, told["reason"], told["alert"]) == ("WATCHING", "risk_cleared", "no_alert_level")
    kept, told = states.step(kept, evaluation(alpha=80.0, sufficient=False, minute=1.0), policy)
    assert (kept.state, told["alert"], told["sent"]) == ("INTERESTING", "first_alert", True)
    kept, told = states.step(kept, evaluation(alpha=70.5, minute=2.0), policy)
    assert (told["reason"], told["alert"]) == ("no_change", "suppressed_duplicate")
    kept, told = states.step(kept, evaluation(alpha=70.0, minute=3.0), policy)
    assert told["alert"] == "score_moved"
    kept, told = states.step(kept, evaluation(alpha=76.0, minute=4.0), policy)
    assert (kept.state, told["alert"]) == ("STRONG_SIGNAL", "level_upgraded")
    kept, told = states.step(kept, evaluation(alpha=76.0, minute=64.0), policy)
    assert told["alert"] == "cooldown_elapsed"
    kept, told = states.step(kept, evaluation(liquidity=1.0, peak=10.0), policy)
    assert (kept.state, told["reason"]) == ("EXPIRED", "liquidity_collapse")
    assert states.step(kept, evaluation(risk="FAIL"), policy)[1]["reason"] == "already_expired"


def test_circuit():
    kept = states.Circuit()
    for minute in range(3):
        kept, told = states.attempt(kept, float(minute), False, True)
    assert (kept.state, told["edge"]) == ("OPEN", "opened")
    assert not states.attempt(kept, 3.0, True, True)[1]["allowed"]
    again, told = states.attempt(kept, 7.0, False, True)
    assert told["probe"] and again.state == "OPEN" and again.reopen == 12.0
    assert states.attempt(again, 12.0, True, True)[1]["edge"] == "closed"
    assert states.attempt(states.Circuit("CLOSED", 2), 0.0, False, False)[0].failures == 2


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import machines

    rng = random.Random(3)
    rows = [tuple(evaluation(token_id=rng.randrange(5), seq=i, minute=float(i), alpha=float(rng.randrange(100)), age=float(rng.randrange(380)), idle=float(rng.randrange(32))).values()) for i in range(200)]
    schema = "token_id long, seq long, minute double, alpha double, sufficient boolean, risk string, age double, idle double, liquidity double, peak double"
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in/*"))
    query = machines.signal_states(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(tuple(r) for r in states.signal_states(spark.createDataFrame(rows, schema)).collect())
    assert sorted(tuple(r) for r in spark.table("states").collect()) == want


def test_tail_appends_once(spark, tmp_path):
    from tidemark.streaming import tail

    pools, blocks = spark.createDataFrame([("p", 1)], "pool string, pool_id long"), spark.createDataFrame([(1, 10), (2, 20)], "block_number long, t long")
    swaps = spark.createDataFrame([("x", 0, "p", 1, "-5"), ("x", 0, "p", 1, "-5"), ("y", 0, "q", 1, "1"), ("z", 1, "p", 9, "1"), ("w", 1, "p", 2, "1")], "tx_hash string, log_index long, pool string, block_number long, amount0 string")
    write = tail.writer(str(tmp_path / "trades"), pools, blocks)
    write(swaps, 0)
    write(swaps, 1)
    assert sorted((r.tx_hash, r.side, r.t) for r in spark.read.parquet(str(tmp_path / "trades")).collect()) == [("w", "OUT1", 20), ("x", "OUT0", 10)]


def test_clusters_take_all_fundings(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.plans.catalog import QUERIES

    rng = random.Random(14)
    at = [datetime(2024, 1, 1) + timedelta(hours=rng.randrange(240)) for _ in range(60)]
    rows = [(i + 1, 100 + rng.randrange(40), at[i], float(rng.choice([0, 100, 104, 107, 250, 300])), rng.choice("ab")) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    owners = [(i % 3, i + 1, rng.randrange(-50, 500) / 1.0) for i in range(60)]
    spark.createDataFrame(owners, "c_nationkey long, c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    near, groups = set(), {}
    for w, f, t, x, k in rows:
        groups.setdefault(f"funder:{f}", set()).add(w)
        groups.setdefault(f"tx:{t}{k}", set()).add(w)
        for o, _, u, y, _ in rows:
            if t <= u <= t + timedelta(days=1) and (u > t or o > w) and (x == y or x and y and (max(x, y) - min(x, y)) / max(x, y) <= 0.05):
                near.add((w, o))
                groups.setdefault(f"batch:{w}", {w}).add(o)
    groups = {k: ws for k, ws in groups.items() if len(ws) > 1}
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, run("cluster_batch"))) == sorted(near)
    found = {}
    for r in run("clusters"):
        found.setdefault("tx" if r.cluster_key.startswith("tx:") else r.cluster_key, []).append(r.wallet)
    own = lambda tx: sorted(w for k, ws in groups.items() if k.startswith("tx:") == tx for w in ws)
    assert sorted(found.pop("tx", [])) == own(True)
    assert {k: sorted(ws) for k, ws in found.items()} == {k: sorted(ws) for k, ws in groups.items() if not k.startswith("tx:")}
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) * 10**6
    named = {k if not k.startswith("tx:") else f"tx:{us(datetime.fromisoformat(k[3:-1]))}{k[-1]}": ws for k, ws in groups.items()}
    first = {w: min(k for k, ws in named.items() if w in ws) for ws in named.values() for w in ws}
    (alone,) = run("independent_count")
    assert alone.independent == len(set(first.values())) + 60 - len(first)
    held = {w: (n, round(b * 100)) for n, w, b in owners if b > 0}
    want = {n: max(sum(held[w][1] for w in ws if w in held and held[w][0] == n) for ws in groups.values()) * 10**6 // sum(b for m, b in held.values() if m == n) / 10**6 for n in range(3)}
    assert {r.token_id: r.cluster_concentration for r in run("cluster_concentration")} == want


def test_repairs_at_all_horizons(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.plans.catalog import QUERIES

    at = datetime(2024, 1, 1)
    hours = lambda h: at + timedelta(hours=h)
    # a signal, which is a trade written six minutes later, a trade of its pool written as late just before 4h, a rollback found after 24h, the tail
    rows = [(20, 1, "signup", at), (160, 2, "view", hours(4) - timedelta(minutes=1)), (998, 3, "view", hours(23)), (3, 4, "view", hours(25))]
    data = [(i, u, k, t, 5.0, '{"k": "1"}') for i, u, k, t in rows]
    spark.createDataFrame(data, "event_id long, user_id long, event_type string, ts timestamp, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in QUERIES["damaged_outcomes"](spark, str(tmp_path)).collect()} == {(20, "1m", "late"), (20, "4h", "late"), (20, "24h", "reorg")}
