import numpy as np

from tidemark.llm import topk as t


def brute(vectors, queries, k):
    out = []
    for q, x in queries:
        scores = sorted((-int(np.floor(1024 * np.array(x, float)).astype(int)[: min(len(x), len(y))] @ np.floor(1024 * np.array(y, float)).astype(int)[: min(len(x), len(y))]), i) for i, y in vectors if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_equals_brute_force_with_ties_nulls_and_short_vectors(spark):
    rng = np.random.default_rng(4)
    sound = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 20)]) for i in range(300)]
    sound += [(300 + i, sound[i][1]) for i in range(5)] + [(400, [0.5, -0.25]), (401, [0.0] * 20), (505, []), sound[7]]
    odd = [(500, None), (501, [1.0, None]), (502, [float("nan")] * 20), (503, [float("inf")] * 20), (None, [1.0] * 20)]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in sound + odd], "vec_id long, embedding array<float>, n int, ids string, columns string").repartition(3)
    got = t.topk(df, df.filter("vec_id % 50 = 0"), 10)
    rows = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())
    assert rows == brute(sound, [(i, v) for i, v in sound if i % 50 == 0], 10)


def test_fewer_rows_than_k_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in t.topk(df, df, 10).orderBy("query_id").collect()] == [(0, 1, 1, 1024 * 2048), (1, 1, 0, 2048 * 1024)]
    none = spark.createDataFrame([], schema)
    assert t.topk(none, none).collect() == []


def test_pruning_keeps_ties():
    rng = np.random.default_rng(5)
    columns = rng.integers(-50, 50, (24, 500))
    columns[:, 100:120] = columns[:, :1]
    mass = np.sqrt(np.concatenate([np.cumsum(np.add.reduceat(columns.astype(float) ** 2, [0, 8, 16], axis=0)[::-1], axis=0)[::-1], np.zeros((1, 500))]))
    for seed in range(20):
        q = np.random.default_rng(seed).integers(-50, 50, 24)
        ids, scores = t.best(q, -1, columns, mass, np.arange(500), 10)
        order = np.lexsort((np.arange(500), -(q @ columns)))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == (q @ columns)[order].tolist()


def test_large_components_are_exact(spark):
    rows = [(0, [200.0, 1.0]), (1, [1e6, 0.0]), (2, [2e6, 0.0]), (3, [2e6, -1.0]), (4, [1e12, 3.0]), (5, [-1e300, 1.0]), (6, [1e300, 0.0]), (7, [1e300, 5.0]), (8, [1.7e308, 0.0]), *((i, [float(i), 1.0]) for i in range(20, 60))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    whole = {i: [int(x * 2**10) if abs(x) < 1e300 else int(x) * 2**10 for x in v] for i, v in rows}
    limit = 2**63 - 1
    for ask in (0, 8):
        exact = sorted((-sum(a * b for a, b in zip(whole[ask], v)), i) for i, v in whole.items() if i != ask)[:10]
        got = [(r["rank"], r.vec_id, r.score) for r in t.topk(df, df.filter(f"vec_id = {ask}"), 10).orderBy("rank").collect()]
        assert got == [(n + 1, i, max(min(-s, limit), -limit - 1)) for n, (s, i) in enumerate(exact)]


def test_pruning_of_large_numbers_keeps_ties():
    rng = np.random.default_rng(6)
    columns = rng.integers(-50, 50, (24, 300)).astype(object) * 10**30 + 1
    columns[:, 100:120] = columns[:, :1]
    units = 1 << 110, 1 << 110
    for seed in range(5):
        q = np.random.default_rng(seed).integers(-50, 50, 24).astype(object) * 10**30
        ids, scores = t.best(q, -1, columns, t.masses(columns / units[1]), np.arange(300), 10, units)
        order = sorted(range(300), key=lambda i: (-(q @ columns)[i], i))[:10]
        assert ids.tolist() == order and scores.tolist() == [(q @ columns)[i] for i in order]
