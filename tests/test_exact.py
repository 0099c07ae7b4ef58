import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import decode, exact, text
from tidemark.operators import evaluation as ev
from tidemark.operators import holders, joins, outcomes, risk, upserts

WORD = lambda n: f"{n % 2**256:064x}"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_prices_of_pools(spark):
    # a dollar token of 6 places against one of 18: the price of the second is in the low thousands
    root = 3961408125713216879677198
    got = one(spark, exact.price_of_sqrt("s", "a", "b"), s=str(root), a=18, b=6)
    want = root * root * 10**18 // 2**192 * 10**12
    assert exact.parse(got) == want and 1000 < float(got) < 3000
    assert one(spark, exact.price_of_sqrt("s", "a", "b"), s="0", a=18, b=6) is None
    assert one(spark, exact.price_of_reserves("r", "q", "a", "b"), r=str(10**18), q="2500000000", a=18, b=6) == "2500"
    assert one(spark, exact.price_of_reserves("r", "q", "a", "b"), r="0", q="1", a=18, b=6) is None
    assert one(spark, exact.inverted("p"), p="4") == "0.25" and one(spark, exact.inverted("p"), p="0") is None
    assert one(spark, exact.to_usd("p", "q"), p="0.000000000000000001", q="0.5") is None
    assert one(spark, exact.market_cap("s", "d", "p"), s=str(10**27), d=18, p="0.000002") == "2000" and one(spark, exact.market_cap("s", "d", "p"), s="0", d=18, p="1") is None
    assert one(spark, exact.liquidity("b", "q", "x", "y", "p", "r"), b=str(10**18), q="3000000", x=18, y=6, p="2", r="1") == "5"
    assert one(spark, exact.liquidity("b", "q", "x", "y", "p", "r"), b="1", q="1", x=18, y=6, p=None, r="1") is None


def test_empty_sides_have_no_price_even_with_a_tick(spark):
    state = dict(s=str(2**96), a="0", b="5", f=True, x=6, y=6)
    price = exact.price_in_quote("s", "a", "b", "f", "x", "y")
    assert one(spark, price, **state) is None
    assert one(spark, price, **state | {"a": "1", "s": str(2**97)}) == "4"
    assert one(spark, price, **state | {"a": "1", "s": str(2**97), "f": False}) == "0.25"
    assert one(spark, price, **state | {"a": "10", "s": None}) == "0.5"


def test_sums_and_balances_beyond_128_bits(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), i // 3, i % 3, rng.randrange(6), rng.randrange(6), str(rng.randrange(2**250)), i) for i in range(120)]
    df = spark.createDataFrame(rows, "token_id long, tx long, log_index int, source long, target long, value string, t long").withColumn("batch", F.col("tx") % 7)
    net, kept = {}, {}
    for k, tx, _, s, d, v, _ in rows:
        for w, x in ((d, int(v)), (s, -int(v))):
            net[k, w, tx % 7] = net.get((k, w, tx % 7), 0) + x
    got = holders.netted(df, "batch")
    assert {(r.token_id, r.wallet, r.batch): int(r.change) for r in got.collect()} == net
    for (k, w, _), x in sorted(net.items()):
        total, low = kept.get((k, w), (0, False))
        kept[k, w] = max(total + x, 0), low or total + x < 0
    assert {(r.token_id, r.wallet): (int(r.balance), r.partially_observed) for r in holders.balances(got).collect()} == kept


def test_series_of_prices(spark):
    """Amounts as logged; a price far below 1e-18 of the quote is still a price in dollars."""
    columns = "trade_id int, pool_id int, t long, block_number int, log_index int, amount0 string, amount1 string, base_is_token0 boolean, base_decimals int, quote_decimals int, fixed_usd string, quote_token int"
    rows = [
        (1, 1, 100, 1, 0, "-1838405276892001700105232", "15677718585", True, 18, 18, "2462.309482", 0),
        (2, 1, 100, 1, 1, str(-(10**28)), str(10**9), True, 18, 18, "2462.309482", 0),
        (3, 1, 100, 1, 2, "0", "5", True, 18, 18, "1", 0),
        (4, 1, 100, 1, 3, "-2", "6", True, 0, 0, None, 7),
        (5, 1, 400, 1, 4, "6", "-2", False, 0, 0, None, 7),
        (6, 1, 100, 1, 5, "-2", "6", True, 0, 0, None, 8),
    ]
    quotes = spark.createDataFrame([(7, 90, "2"), (7, 110, "3"), (7, 390, "5")], "token_id int, t long, price string")
    found = {r.trade_id: r.trade_price for r in outcomes.price_series(spark.createDataFrame(rows, columns), quotes, 15).collect()}
    assert int(found[1] * 10**18) == 20998305 and int(found[2] * 10**18) == 246
    assert found[3] is None and found[4] == 6 and found[5] == 15 and found[6] is None


def test_paths_equal_brute_force(spark):
    rng, minute = random.Random(6), 60_000_000
    trades = [(p, t, b, 0, t + rng.randrange(minute), rng.choice([None, rng.random()])) for b in range(500) for p, t in [(rng.randrange(2), rng.randrange(30 * 60) * minute + rng.choice([0, 1, minute - 1, rng.randrange(minute)]))]]
    signals = [(i, rng.randrange(3), rng.choice([trades[i][1], rng.randrange(28 * 60 * minute)]), 1.0) for i in range(25)]
    windows = outcomes.pairs(spark.createDataFrame(signals, "signal_id int, pool_id int, t long, price double"))
    got = outcomes.outcome_path(windows, spark.createDataFrame(trades, "pool_id int, t long, block_number int, log_index int, created_t long, trade_price double")).collect()
    assert len(got) == 25 * 7
    for r in got:
        own = [x for x in trades if x[0] == r.pool_id and r.start <= x[1] <= r.end]
        prices = [(x[2], x[5]) for x in own if x[5] is not None]
        assert (r.trade_count, r.priced_count) == (len(own), len(prices))
        assert r.last_price == (max(prices)[1] if prices else None) and r.last_created_t == max((x[4] for x in own), default=None)
        assert (r.max_price, r.min_price) == ((max(p for _, p in prices), min(p for _, p in prices)) if prices else (None, None))


def test_ranges_of_values_give_the_same_ranks_and_quantiles(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice([rng.randrange(9), rng.gauss(0, 1000)])), rng.random()) for _ in range(700)] + [("c", 1.0, 2.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")

    def found():
        ranks = sorted((str(r.g), r.x or 0, r.y, r.rank or 0) for r in ev.average_rank(df, ["g"], "x", "rank").collect())
        rho = sorted((str(r.g), r.n, None if r.rho is None else round(r.rho, 9)) for r in ev.spearman(df, ["g"], "x", "y").collect())
        cuts = sorted((str(r.g), round(r.p10, 9), round(r.median, 9), round(r.p90, 9)) for r in ev.quantiles(df, ["g"], "x").collect())
        return ranks, rho, cuts

    few = found()
    monkeypatch.setattr(ev, "FEW", 0)
    assert found() == few
    own = sorted(x for g, x, _ in rows if g == "a" and x is not None)
    place = (len(own) - 1) / 2
    middle = own[int(place)] + (own[min(int(place) + 1, len(own) - 1)] - own[int(place)]) * (place % 1)
    assert dict((g, m) for g, _, m, _ in few[2])["a"] == pytest.approx(middle)


def test_last_row_before(spark):
    rng = random.Random(9)
    points = [(rng.choice("ab"), rng.randrange(300), i, rng.choice([None, i * 1.5])) for i in range(40)]
    asked = [(i, rng.choice("abc"), rng.randrange(-20, 320)) for i in range(60)]
    want = {}
    for i, k, at in asked:
        before = [(t, n, x) for g, t, n, x in points if g == k and t <= at]
        want[i] = max(before, key=lambda p: p[:2])[1:] if before else (None, None)
    for span in (7, 100, 10_000):
        got = joins.latest_before(spark.createDataFrame(asked, "row int, k string, at long"), spark.createDataFrame(points, "k string, t long, n int, x double"), ["k"], ["n", "x"], ["n"], span)
        assert {r.row: (r.n, r.x) for r in got.collect()} == want


def test_rollbacks_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(b, rng.randrange(1000)) for b in range(0, 400, 3)]
    events = [(rng.randrange(420), rng.randrange(1000)) for _ in range(6)]
    want = sorted(r for r in rows if not any(r[0] > a and r[1] <= t for a, t in events))
    for width in (1, 50, 1000):
        got = upserts.rolled_back(spark.createDataFrame(rows, "block_number long, created_t long"), spark.createDataFrame(events, "rewound long, occurred_t long"), width)
        assert sorted(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], "rewound long, occurred_t long")
    assert upserts.rolled_back(spark.createDataFrame(rows, "block_number long, created_t long"), none).count() == len(rows)


def test_verdicts_take_the_worst_of_each_code(spark):
    flag = "array<struct<code: string, severity: string, action: string, message: string>>"
    rows = [([("A", "LOW", "WARNING", "1"), ("A", "HIGH", "WARNING", "2"), ("B", "MEDIUM", "WARNING", "3")],), ([("A", "CRITICAL", "FAIL", "1"), ("B", "HIGH", "WARNING", "2")],), ([],)]
    got = spark.createDataFrame(rows, f"flags {flag}").select(risk.verdict(F.col("flags")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [(2, "WARNING", 45), (2, "FAIL", 100), (0, "PASS", 0)]


def test_taxes(spark):
    rows = [("uniswap-v2", None, 0.994009, 0.0), ("uniswap-v3", 10000, 0.9801, 0.0), ("uniswap-v3", None, 0.5, 1 - 0.5 / 0.994009), ("aerodrome", 500, 1.0, 0.0), ("uniswap-v2", None, None, None)]
    df = spark.createDataFrame(rows, "dex string, tier int, kept double, want double")
    for r in df.select(risk.token_tax(F.col("kept"), F.col("dex"), F.col("tier")).alias("tax"), "want").collect():
        assert r.tax == r.want if r.want is None else r.tax == pytest.approx(r.want, abs=1e-12)


def test_answers_of_calls(spark):
    data = "0x" + WORD(32) + WORD(2) + WORD(5) + WORD(2**255 + 3)
    assert one(spark, decode.last_amount(F.col("d")), d=data) == str(2**255 + 3)
    assert one(spark, decode.last_amount(F.col("d")), d="0x12") is None
    name = "Ünit ✓".encode()
    calls = [("t", "0x" + WORD(32) + WORD(len(name)) + name.hex().ljust(64, "0"), "0x" + WORD(32) + WORD(90) + "00" * 32, "0x" + WORD(18), None, None), ("u", "0xzz", "0x" + WORD(32) + WORD(1) + "ff".ljust(64, "0"), None, "0x" + WORD(2**200), "429")]
    got = decode.token_metadata(spark.createDataFrame(calls, "token string, symbol string, name string, decimals string, supply string, error string")).collect()
    assert [tuple(r) for r in got] == [("t", "Ünit ✓", None, 18, None, "0"), ("u", None, None, None, "rate", str(2**200))]


def test_nested_secrets(spark):
    df = spark.createDataFrame([({"a": ["https://x.org/key/1", None], "n": 5},), (None,)], "x struct<a: array<string>, n: int>")
    got = df.select(text.redact_deep(F.col("x"), df.schema["x"].dataType).alias("x")).collect()
    assert got[0].x.a == ["https://x.org/[REDACTED]", None] and got[0].x.n == 5 and got[1].x is None
