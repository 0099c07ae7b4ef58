import random

import numpy as np
import pytest

from tidemark.llm import quality, toxicity

from .helpers import documents, frame, sentence


def test_toxic_documents_are_told_apart(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words = sentence(rng, rng.randint(20, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilebrat", "scumling", "Grubface,", "mudbrain"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "clash"))
    rows += [(1000, None), (1001, ""), (None, "no id"), (1002, "!!! 123")]
    labels += [(3, None, "x"), (None, 1, "x"), (5, 1, "again")]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    held = F.col("doc_id") % 7 == 0
    got = toxicity.score(frame(spark, rows), marks, held).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    judged = [((r.score >= 0.5), r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 7 == 0]
    assert np.mean([a == b for a, b in judged]) > 0.97
    assert {r.doc_id: r.score for r in got}[1000] < 0.5
    again = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows, 5), marks, held).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in got}, abs=1e-6)
    # models learn from all labelled rows, whatever bounds the curve; equal texts count once, as the least id says
    few = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), marks, held, 40).collect()}
    assert np.mean([(few[i] >= 0.5) == (i % 5 == 0) for i in range(0, 600, 7)]) > 0.97
    copies = frame(spark, rows + [(2000 + i, rows[1][1]) for i in range(50)])
    more = marks.union(spark.createDataFrame([(2000 + i, 1, "copy") for i in range(50)], marks.schema))
    assert {r.doc_id: r.score for r in toxicity.score(copies, more, held).collect()}[1] < 0.5


def test_toxicity_without_labels(spark):
    from pyspark.sql import functions as F

    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    got = toxicity.score(frame(spark, documents()), marks, F.lit(False)).collect()
    assert {r.score for r in got} == {0.0}
    assert toxicity.score(frame(spark, []), marks, F.lit(False)).collect() == []


def test_words_seen_once_count(spark):
    rows = [(kind, word, word * 3, word * 5, word * 7, n) for kind, word, n in ((0, 1 << 50, 4), (0, 3 << 50, 1), (1, 5 << 50, 1), (1, 7 << 50, 3))]
    model = toxicity.Model(spark.createDataFrame(rows, toxicity.COUNTS))
    assert model.word[1][(5 << 50) >> 64 - toxicity.WORDS] == pytest.approx((1 - toxicity.DISCOUNT) / 4)


def test_ratios_equal_kneser_ney_by_hand(spark):
    """Every expression's ratio from counts in dictionaries: discounts, continuation counts, the base that both classes share."""
    import math
    import re
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(12)
    rows = [(int(i % 3 == 0), sentence(rng, rng.randint(3, 25)) + (" vilebrat scumling mudbrain" if i % 3 == 0 and i % 2 else "")) for i in range(40)]
    counted = spark.createDataFrame([(t, k) for k, t in rows], "text string, toxic int").repartition(3).mapInArrow(toxicity._count, toxicity.COUNTS)
    model = toxicity.Model(counted)
    words = lambda t: re.findall(r"[a-z]+", t.lower())
    own, d = {k: Counter() for k in (0, 1)}, toxicity.DISCOUNT
    for k, t in rows:
        own[k].update(set(words(t)))
    seven, five, four = toxicity.PREFIXES
    base = Counter(four_ for _, four_ in {(w[:five], w[:four]) for c in own.values() for w in c})
    whole = sum(base.values()) + 0.5 * (1 << toxicity.STARTS)

    def chance(k, word):
        levels, keys = [own[k]], set(own[k])
        for size in toxicity.PREFIXES:
            levels.append(Counter(x[:size] for x in keys))
            keys = set(levels[-1])
        total, left = 0.0, 1.0
        for counts, size in zip(levels, (len(word), *toxicity.PREFIXES)):
            n = sum(counts.values())
            total += left * max(counts[word[:size]] - d, 0) / n
            left *= d * len(counts) / n
        return total + left * (base[word[:four]] + 0.5) / whole

    text = rows[3][1] + " neverseen vilebratty " + rows[4][1]
    data, offsets = toxicity.text_buffer(pa.array([text]))
    ratio, first = model.ratios(data, offsets)
    want = [math.log(chance(1, w) / chance(0, w)) for w in words(text)]
    assert first.tolist() == [0, len(want)] and ratio.tolist() == pytest.approx(want, abs=1e-4)
    likelihood, evidence = model.evidence(data, offsets)
    assert likelihood[0] == pytest.approx(np.mean(want), abs=1e-4) and min(want) < 0 < max(want)
    assert evidence[0] == pytest.approx(np.mean([max(x - model.margin, 0) for x in want]), abs=1e-4)


def junk(rng, kind, words):
    if kind == 0:
        return " ".join(w + rng.choice(["***", "$$$", "&&&"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join([words[0]] * len(words))


def test_quality_learns_from_labellers(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        words = sentence(rng, 40).split()
        rows.append((i, junk(rng, i // 6 % 4, words) if i % 6 == 0 else " ".join(words).capitalize() + "."))
    rows += [(900, None), (901, ""), (None, "No id is here but the text reads well enough."), (5, rows[5][1])]
    got = quality.classify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert np.mean([r.keep == (r.doc_id % 6 != 0) for r in got if r.doc_id is not None and r.doc_id < 400]) > 0.97
    kept = quality.keep_rows(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.keep)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((i if i is not None else -1) for i, _ in rows if by[i])
    assert quality.classify(frame(spark, [])).collect() == []


def test_em_finds_accuracies():
    rng = np.random.default_rng(13)
    good = rng.random(20000) < 0.8
    m = len(quality.LABELLERS)
    code = np.zeros(len(good), np.int64)
    for _ in range(m):
        right = np.where(good, quality.GOOD, quality.BAD)
        wrong = np.where(good, quality.BAD, quality.GOOD)
        vote = np.where(rng.random(len(good)) < 0.3, quality.ABSTAIN, np.where(rng.random(len(good)) < np.where(good, 0.98, 0.7), right, wrong))
        code = code * 3 + vote
    pattern, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    posterior, chance, share = quality.estimate(pattern, count.astype(float))
    assert ((posterior[inverse] >= 0.5) == good).mean() > 0.98
    assert abs(share - 0.8) < 0.03 and abs(chance[0, 0, quality.BAD] - 0.49) < 0.05
