"""Plans that hold at size: what is copied is never broadcast, what is paired is never shuffled; results against loops."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import holders as h
from tidemark.operators import joins, windows
from tidemark.plans import catalog


def plan(df):
    """The plan as run, and the rows."""
    rows = [tuple(r) for r in df.collect()]
    return df._jdf.queryExecution().executedPlan().toString(), rows


def funded(spark, repeated=False):
    rng = random.Random(7)
    amounts = [0, 0, -5, -3, *(int(1.03**i * 1000) for i in range(40))]
    rows = [(str(w % (60 if repeated else 1000)), rng.choice("abc"), f"tx{rng.randrange(30)}", rng.randrange(-30, 120), rng.choice(amounts)) for w in range(150)]
    return rows, spark.createDataFrame([*rows, ("x", None, None, None, 7), ("y", None, "tx0", 5, None)], "wallet string, funder string, tx string, t long, value long")


def paired(rows, proximity, tolerance):
    def like(a, b):
        large, small = max(a, b), min(a, b)
        return a == b or (a != 0 and b != 0 and (large - small) * 1_000_000 // large / 1_000_000 <= tolerance)

    return [(a, b) for a, _, _, s, x in rows for b, _, _, t, y in rows if s <= t <= s + proximity and (t > s or b > a) and like(x, y)]


def test_batches_are_made_in_one_place(spark):
    rows, df = funded(spark)
    text, got = plan(h.batches(df, 10, 0.05))
    assert "Join" not in text and text.count("MapInArrow") >= 1
    assert sorted(got) == sorted(paired(rows, 10, 0.05)) and len(got) > 50


def test_clusters_with_wallets_funded_once_and_again(spark):
    for repeated in (False, True):
        rows, df = funded(spark, repeated)
        for least in (2, 4):
            near = paired(rows, 10, 0.05)
            want = {f"batch:{a}": {a} for a, _ in near}
            for a, b in near:
                want[f"batch:{a}"].add(b)
            for wallet, funder, tx, *_ in [*rows, ("y", None, "tx0")]:
                if funder:
                    want.setdefault(f"funder:{funder}", set()).add(wallet)
                want.setdefault(f"tx:{tx}", set()).add(wallet)
            _, got = plan(h.clusters(df, 10, 0.05, least))
            assert sorted(got) == sorted((k, w) for k, ws in want.items() if len(ws) >= least for w in ws)


def test_first_clusters_without_rows_for_pairs(spark):
    for repeated in (False, True):
        _, df = funded(spark, repeated)
        for least in (2, 4):
            first = lambda found: sorted(map(tuple, found.groupBy("wallet").agg(F.min("cluster_key")).collect()))  # noqa: E731, B023
            found = h.clusters(df, 10, 0.05, least, first=True)
            assert first(found) == first(h.clusters(df, 10, 0.05, least))
    crowd = spark.createDataFrame([(i, None, None, 5, 1000) for i in range(300)], "wallet long, funder string, tx string, t long, value long")
    found = h.clusters(crowd, 10, 0.05, first=True).collect()
    assert len(found) <= 600 and {min(r.cluster_key for r in found if r.wallet == w) for w in (1, 2, 299)} == {"batch:0"}


def test_pairs_are_written_in_little_space(spark, tmp_path):
    rng = random.Random(3)
    for name, spread in (("alike", 1), ("apart", 997)):
        rows = [(w, None, None, rng.randrange(2), 10**5 * 2 ** rng.randrange(5) + rng.randrange(spread)) for w in rng.sample(range(10**6), 4000)]
        df = spark.createDataFrame(rows, "wallet long, funder string, tx string, t long, value long")
        for kind, found in (("clusters", h.clusters(df, 1, 0.05)), ("batches", h.batches(df, 1, 0.05))):
            path = tmp_path / f"{name}-{kind}"
            found.write.parquet(str(path))
            n = spark.read.parquet(str(path)).count()
            groups = [sum(x[3] == t and x[4] // 10**5 == 2**g for x in rows) for t in (0, 1) for g in range(5)]
            pairs = sum(x * (x - 1) // 2 for x in groups) + sum(groups[g] * groups[g + 5] for g in range(5))
            assert n - pairs in ((0,) if kind == "batches" else range(3900, 4001))
            assert sum(p.stat().st_size for p in path.rglob("*.parquet")) / n < 0.5


def windowed(trades, at, length, base):
    inside = [x for x in trades if at is not None and at - length < x[1] <= at]
    buy = "OUT0" if base else "OUT1"
    volumes = [abs(x[5] if base else x[4]) for x in inside if (x[5] if base else x[4]) is not None]
    return sum(x[2] == buy for x in inside), sum(x[2] not in (buy, None) for x in inside), len({x[3] for x in inside if x[2] == buy} - {None}), sum(volumes) if volumes else None


def test_windows_are_swept_not_joined(spark):
    rng = random.Random(5)
    trades = [(rng.choice([0, 1, None]), rng.randrange(-40, 90), rng.choice(["OUT0", "OUT1", None]), rng.choice(["a", "b", "c", None]), rng.choice([None, -4, 9]), rng.choice([None, 2**61, -7])) for _ in range(200)]
    anchors = [(i, rng.choice([0, 1, 2, None]), rng.choice([None, *range(-45, 120)]), rng.choice([True, False, None])) for i in range(60)]
    left = spark.createDataFrame(trades, "pool_id long, t long, side string, wallet string, amount0 long, amount1 long").withColumn("amount1", F.col("amount1").cast("decimal(20,0)"))
    left, right = left.withColumn("amount0", F.col("amount0").cast("decimal(20,0)")), spark.createDataFrame(anchors, "row long, pool_id long, at long, base_is_token0 boolean")
    text, got = plan(windows.consecutive_windows(left, right, 7, 3))
    assert "Join" not in text
    want = [(i, pool, at, base, k, *windowed([x for x in trades if x[0] == pool and pool is not None], None if at is None else at - 7 * k, 7, base)) for i, pool, at, base in anchors for k in range(3)]
    assert sorted(got, key=lambda r: (r[0], r[4])) == want
    _, got = plan(windows.trade_window(left, right, 7))
    assert sorted(got, key=lambda r: r[0]) == [(*r[:4], *r[5:]) for r in want if r[4] == 0]


def test_backfill_as_its_sql_with_large_ids(spark, tmp_path):
    with duckdb.connect() as db:
        db.execute("CREATE TABLE orders AS SELECT i * 700001 + 5 AS o_orderkey, i % 3 AS o_custkey, 13.0e0 AS o_totalprice, 'O' AS o_orderstatus, '1' AS o_orderpriority, TIMESTAMP '2024-01-01' + INTERVAL (i % 50) DAY AS o_orderdate FROM range(200) r(i)")
        db.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
        for t in ("customer", "lineitem", "events"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
        want = db.execute(catalog.ORACLE_SQL["distinct_on_backfill"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["distinct_on_backfill"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 200


def test_copies_are_never_broadcast(spark):
    topk = pytest.importorskip("tidemark.llm.topk")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    text, got = plan(topk.topk(vectors, vectors.filter("vec_id % 100 = 0"), 3))
    assert "Broadcast" not in text and len(got) == 9
    spans = spark.createDataFrame([(1, 0, 500), (2, 90, 95)], "key long, start long, end long")
    points = spark.createDataFrame([(1, 7, "a"), (1, 501, "b"), (2, 95, "c")], "key long, t long, name string")
    text, got = plan(joins.range_join(spans, points, ["key"], 1))
    assert "Broadcast" not in text and sorted(r[-1] for r in got) == ["a", "c"]


def test_scores_are_made_in_steps(spark):
    names = [c for parts in [*scoring.COMPONENTS.values(), scoring.PENALTIES] for c in parts]
    rows = spark.createDataFrame([(1, *[0.5] * len(names)), (2, *[None] * len(names))], "signal_id long, " + ", ".join(f"{c} double" for c in names))
    found = scoring.strategy(rows)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    some, none = sorted(found.collect())
    # a half of each: floored at 1000, 2 of 3, a half, floored at 1; and 25 points off for 0.4 of 0.5
    assert round(some.liquidity, 6) == round(20 * 2 / 3 + 10 + 20, 6) and round(some.smart_money, 6) == round(5 + 20 * (1 - 0.5 / 60) + 0.15, 6)
    assert some.coverage == 1 and round(some.score, 6) == round(some.liquidity * 0.2 + some.momentum * 0.3 + some.holder * 0.2 + some.smart_money * 0.3 - 20, 6)
    assert (none.liquidity, none.score, none.coverage) == (None, 0, 0)


def test_parts_of_features_are_written_one_after_another(spark):
    text = catalog.QUERIES["feature_set"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Window", "MapInArrow", "Generate", "Aggregate"))
