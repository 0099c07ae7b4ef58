import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import minhash as m

from .helpers import documents, frame, sentence


def grams(text):
    words = (text or "").lower().split()
    return [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))] if words else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[-1], before[j + 1]))
    return row[-1]


def brute(rows):
    """Least id by union-find over all pairs."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    g = {i: grams(t) for i, t in rows}
    for i, _ in rows:
        for j, _ in rows:
            if j < i:
                n, k = len(g[i]), len(g[j])
                if g[i] == g[j] or n and k and sum((Counter(g[i]) & Counter(g[j])).values()) >= 0.8 / 1.8 * (n + k) - 1e-9 and lcs(g[i], g[j]) >= 0.8 / 1.8 * (n + k) - 1e-9:
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {i: find(i) for i in parent}


def noisy(seed=8):
    rng = random.Random(seed)
    rows = [r for r in documents(seed) if len(r[1] or "") < 5000]
    base = sentence(rng, 120).split()
    for _ in range(25):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.random():.5f}"
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), "new")
        rows.append((len(rows) + 200, " ".join(words)))
    moved = base[60:] + base[:60]
    return [*rows, (900, " ".join(moved)), (901, " ".join(base).upper())]


def test_classes_equal_brute_force(spark):
    rows = noisy()
    got = {r.doc_id: r.class_id for r in m.classes(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, None), (7, ""), (None, "lonely text")]
    got = sorted(((r.doc_id or -1), (r.class_id or -1)) for r in m.classes(frame(spark, rows)).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (6, 6), (7, 6)]
    kept = sorted((r.doc_id or -1) for r in m.keep_first(frame(spark, rows)).collect())
    assert kept == [-1, -1, 5, 6]
    assert m.classes(frame(spark, [])).collect() == []


def test_alignment_is_exact_within_the_band():
    rng = np.random.default_rng(9)
    for _ in range(200):
        base = rng.integers(0, 10**6, 60).astype(np.uint32)
        keep = rng.random(60) < 0.8
        want = lcs(base.tolist(), base[keep].tolist())
        assert m.aligned(base, base[keep], len(base) - want) == want == keep.sum()
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint32), rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint32)
        want = lcs(a.tolist(), b.tolist())
        left = len(a) + len(b) - 2 * want
        assert m.aligned(a, b, left) == want
        assert m.aligned(a, b, 60) == want
        assert m.aligned(a, b, 2) <= want


def test_sketches_follow_order():
    text = " ".join(f"w{i}" for i in range(200))
    swapped = " ".join(f"w{i}" for i in [*range(100, 200), *range(100)])
    data, offsets = m._folded(pa.array([text, swapped]))
    found, ends = m.kmers(data, offsets)
    marked = m.labelled(found, ends)
    one, two = (m.sketch(marked[a:b]) for a, b in zip(ends[:-1], ends[1:]))
    assert (one == two).mean() < 0.6  # the same k-mers but for four, in another order


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.least for r in m.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


def test_links_without_a_leader_in_large_groups(spark):
    rng = random.Random(15)
    common = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(120):
        own = [f"o{i}x{j}" for j in range(20)]
        rows.append((i, " ".join(common + own)))
        rows.append((1000 + i, " ".join(common + own[:9] + [f"p{i}x{j}" for j in range(11)])))
    rng.shuffle(rows)
    data, offsets = m._folded(pa.array([t for _, t in rows]))
    found, ends = m.kmers(data, offsets)
    texts = [found[s:e] for s, e in zip(ends[:-1], ends[1:])]
    links = [(i, j) for (i, _), x in zip(rows, texts) for (j, _), y in zip(rows, texts) if i < j and m.similar(x, y, 0.8)]
    assert links and all(j == i + 1000 for i, j in links)
    got = {r.doc_id: r.class_id for r in m.classes(frame(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows} | {j: i for i, j in links}


@pytest.mark.parametrize("changed", [1, 8])
def test_all_twins_in_boilerplate_are_found(spark, changed):
    """600 documents with 88 words in common and 12 of their own; a twin has other words in place of the last own ones."""
    rng = random.Random(changed)
    common, rows = [f"c{i}" for i in range(88)], []
    for i in range(300):
        own = [f"o{i}x{j}" for j in range(12)]
        rows += [(i, " ".join(common + own)), (1000 + i, " ".join(common + own[: 12 - changed] + [f"p{i}x{j}" for j in range(changed)]))]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in m.classes(frame(spark, rows)).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def test_versions_of_an_id_stay_together(spark):
    rng = random.Random(4)
    one, two, other = (sentence(rng, 40) for _ in range(3))
    rows = [(3, one), (3, two + " end"), (3, two + " end"), (5, two + " end"), (6, one), (7, other), (8, two + " end more")]
    got = sorted((r.doc_id, r.class_id) for r in m.classes(frame(spark, rows)).collect())
    assert len(got) == len(rows) and len({c for i, c in got if i == 3}) == 1
    assert {(7, 7)} == {x for x in got if x[0] == 7}
    kept = sorted((r.doc_id, r.text) for r in m.keep_first(frame(spark, rows)).collect())
    assert kept.count((3, one)) == 1 and kept.count((3, two + " end")) == 1
    assert kept == sorted((r.doc_id, r.text) for r in m.keep_first(frame(spark, rows[::-1], 5)).collect())
