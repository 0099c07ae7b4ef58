"""Quality by weak supervision: overlapping heuristic labellers, EM, and a hashed linear scorer.

Each labeller looks at one trait of a text and votes good, bad or nothing. The votes of all documents are
counted by pattern, and expectation-maximisation over these counts estimates how often good and bad
documents get each vote, and so the posterior of each pattern; the patterns of ten labellers with
three votes are a bounded table, whatever the corpus. A logistic model over hashed four-grams of
character classes and a few hashed traits learns the posteriors on at most ``max_rows`` documents (those
with the least hash of their id) and scores every document, whole.

Edge cases: null and empty texts get votes from the labellers of length alone, and score as such; very
long texts are read in full; equal texts get equal scores; null ids are carried through; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lean, mix, row_blocks, text_buffer, word_hashes

BLOCK = 1 << 18
DIMS = 2048
EXTRA = 64  # of them for traits
ABSTAIN, GOOD, BAD = 0, 1, 2

#: Classes of bytes: white space, digit, capital, small letter or non-ASCII, then marks by kind.
CLASS = np.full(256, 4, np.uint8)
CLASS[SPACE] = 0
CLASS[48:58] = 1
CLASS[65:91] = 2
CLASS[97:123] = CLASS[128:] = 3
for _i, _marks in enumerate((b".,;:", b"!?", b"|", b"*$%&#@^~=+<>", b"'\"()-")):
    CLASS[list(_marks)] = 5 + _i


def traits(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and shares by row."""
    kinds = CLASS[data] if len(data) else np.zeros(0, np.uint8)

    def total(mask: np.ndarray, edges: np.ndarray = offsets) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[edges[1:]] - sums[edges[:-1]]

    words, first = word_hashes(data, offsets)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words)), n_words)
    same = np.append(False, (words[1:] == words[:-1]) & (row[1:] == row[:-1])) if len(words) else np.zeros(0, bool)
    order = np.lexsort((words, row))
    new = np.append(True, (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])) if len(words) else np.zeros(0, bool)
    solid = np.maximum(total(kinds > 0), 1)
    n = np.maximum(n_words, 1)
    letters = np.maximum(total((kinds == 2) | (kinds == 3)), 1)
    return {
        "words": n_words,
        "letters": total((kinds == 2) | (kinds == 3)),
        "odd": total(kinds == 8) / solid,
        "marks": total(kinds >= 4) / solid,
        "capitals": total(kinds == 2) / letters,
        "shouts": total(kinds == 6) / n,
        "bars": total(kinds == 7) / n,
        "repeats": total(same, first) / n,
        "distinct": total(new, first) / n,
        "length": solid / n,
        "stops": total(kinds == 5) / n,
        "digits": total(kinds == 1) / solid,
    }


#: Name, trait, (bad from, good up to) or, reversed, (bad up to, good from); the words a text needs.
LABELLERS = [
    ("odd marks", "odd", 0.08, 0.01, 1),
    ("all marks", "marks", 0.20, 0.08, 1),
    ("capitals", "capitals", 0.50, 0.25, 3),
    ("shouting", "shouts", 0.30, 0.05, 3),
    ("bars", "bars", 0.20, 0.02, 5),
    ("repeats", "repeats", 0.20, 0.05, 5),
    ("few words again and again", "distinct", 0.15, 0.40, 30),
    ("long words", "length", 14.0, 9.0, 5),
    ("digits", "digits", 0.30, 0.10, 1),
    ("length", "words", 0.5, 3.0, 0),
]


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """Of each row: the votes of all labellers as digits of base 3."""
    code = np.zeros(len(found["words"]), np.int64)
    for _, trait, bad, good, least in LABELLERS:
        x = found[trait]
        up = bad > good
        vote = np.where(x >= bad if up else x <= bad, BAD, np.where(x <= good if up else x >= good, GOOD, ABSTAIN))
        code = code * 3 + np.where(found["words"] >= least, vote, ABSTAIN)
    return code


def features(data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features as (row * DIMS + slot, value)."""
    rows = len(offsets) - 1
    out = []
    if len(data) >= 4:
        kinds = CLASS[data].astype(np.uint32)
        gram = kinds[:-3] << 12 | kinds[1:-2] << 8 | kinds[2:-1] << 4 | kinds[3:]
        slot = SLOTS[gram]
        row = np.repeat(np.arange(rows), np.diff(offsets))
        inside = row[3:] == row[:-3]
        cells = np.bincount((row[:-3] * DIMS + slot)[inside], minlength=rows * DIMS)
        at = np.flatnonzero(cells)
        grams = np.maximum(np.diff(offsets) - 3, 1)
        out.append((at, np.sqrt(cells[at] / grams[at // DIMS])))
    for i, name in enumerate(("repeats", "distinct", "length", "capitals", "odd", "bars")):
        level = np.clip(found[name] * (0.5 if name == "length" else 8), 0, 8).astype(np.int64)
        out.append((np.arange(rows) * DIMS + DIMS - EXTRA + 9 * i + level, np.ones(rows)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


SLOTS = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) % np.uint64(DIMS - EXTRA)).astype(np.int64)


def _blocks(batch: pa.RecordBatch, column: int):
    data, offsets = text_buffer(batch.column(column))
    for a, b in row_blocks(offsets, BLOCK):
        for c in range(a, b, 256):
            d = min(c + 256, b)
            part, edges = data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]
            yield c, d, part, edges, traits(part, edges)


@lean
def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *_, found in _blocks(batch, 0):
            code, n = np.unique(votes(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["pattern", "n"])


@lean
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, part, edges, found in _blocks(batch, 0):
            at, value = features(part, edges, found)
            row, slot = at // DIMS, (at % DIMS).astype(np.uint16)
            code = votes(found)
            cells = [(slot[row == i].tobytes(), value[row == i].astype(np.float32).tobytes()) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], ["pattern", "slots", "cells"])


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(good) by pattern, P(vote | class) by labeller, and the share of good."""
    m = len(LABELLERS)
    vote = np.stack([pattern // 3 ** (m - 1 - j) % 3 for j in range(m)], 1)
    good = np.where((vote == BAD).any(1), 0.1, 0.9)
    chance, share = np.zeros((m, 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([count * (1 - good), count * good], 1)
        for v in range(3):
            chance[:, :, v] = ((vote == v)[:, :, None] * weight[:, None, :]).sum(0) + 0.5
        chance /= chance.sum(2, keepdims=True)
        share = (weight[:, 1].sum() + 1) / (weight.sum() + 2)
        log = np.stack([np.log(chance[np.arange(m), c, vote]).sum(1) for c in (0, 1)], 1) + np.log([1 - share, share])
        fresh = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(fresh - good).max() < 1e-9:
            good = fresh
            break
        good = fresh
    return good, chance, float(share)


def train(grid: np.ndarray, target: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Weights and intercept of a logistic regression on soft targets, by accelerated gradient steps."""
    n = max(len(grid), 1)
    w = np.zeros(grid.shape[1] + 1, np.float32)
    ahead, momentum = w.copy(), 1.0
    rate = 1.0 / (0.25 * (float((grid**2).sum(1).max(initial=1.0)) + 1) + 1e-4)
    for _ in range(rounds):
        z = grid @ ahead[:-1] + ahead[-1]
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target).astype(np.float32)
        slope = np.append(grid.T @ gap / n + 1e-5 * ahead[:-1], gap.mean()).astype(np.float32)
        fresh = ahead - rate * slope
        following = (1 + float(np.sqrt(1 + 4 * momentum**2))) / 2
        ahead = fresh + (momentum - 1) / following * (fresh - w)
        w, momentum = fresh, following
    return w


def _score(weights: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part, edges, found in _blocks(batch, 1):
                at, value = features(part, edges, found)
                z = np.bincount(at // DIMS, value * weights[at % DIMS], minlength=b - a) + weights[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(votes(found)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "votes", "score"])

    return score


def fit(docs: DataFrame, max_rows: int = 4_000) -> np.ndarray:
    """Weights of the scorer, from the votes of all documents and the features of at most ``max_rows``."""
    counts = docs.select("text").mapInArrow(_vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return np.zeros(DIMS + 1, np.float32)
    counts = counts.sort_values("pattern")
    good, _, _ = estimate(counts.pattern.to_numpy(), counts.n.to_numpy(float))
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.join(F.broadcast(ids.distinct()), "doc_id").select("text").mapInArrow(_sample, "pattern long, slots binary, cells binary").limit(max_rows).toPandas()
    grid = np.zeros((len(rows), DIMS), np.float32)
    for i, (s, c) in enumerate(zip(rows.slots, rows.cells)):
        grid[i, np.frombuffer(s, np.uint16)] = np.frombuffer(c, np.float32)
    posterior = dict(zip(counts.pattern, good))
    return train(grid, np.array([posterior[p] for p in rows.pattern], np.float32))


def classify(docs: DataFrame, max_rows: int = 4_000) -> DataFrame:
    """doc_id, votes (base-3 digits of the labellers, 0 none, 1 good, 2 bad), score (P(good)) and keep (score >= 0.5) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    weights = fit(docs, max_rows)
    return docs.mapInArrow(lean(_score(weights)), "doc_id long, votes long, score double").withColumn("keep", F.col("score") >= 0.5)


def keep_rows(docs: DataFrame, max_rows: int = 4_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores 0.5 or more: no join, the text is scored in place."""
    weights = fit(docs.select(F.col("doc_id").cast("long"), F.col("text")), max_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            z = np.zeros(batch.num_rows)
            for a, b, part, edges, found in _blocks(batch, column):
                at, value = features(part, edges, found)
                z[a:b] = np.bincount(at // DIMS, value * weights[at % DIMS], minlength=b - a) + weights[-1]
            yield batch.filter(pa.array(z >= 0))

    return docs.mapInArrow(lean(keep), docs.schema)
