"""Toxicity by class-conditional Kneser-Ney models.

Expressions are words (runs of ASCII letters, folded to lower case, and of non-ASCII bytes). A class model
has levels that are joined by absolute discounts: the number of the class's documents with the word; under
it, Kneser-Ney continuation counts of the word's first seven, five and four bytes (how many distinct longer
beginnings of the class go on from them); at the bottom the continuation counts that both classes
share. So a rare expression has the same probability in both models but for what its beginnings tell.

A document's score compares its log-likelihoods under both models, divided by its length, evidence of both
signs added up. Toxic documents hold a few telling words among hundreds of neutral ones, whose noise drowns them in that
mean, so the evidence that exceeds what an unseen expression gives is added up beside it. A logistic curve over
both, fitted on held-back training rows, turns them into a probability.

The models count all labelled documents (equal texts once, as the row with the least id), so they grow with
the corpus; only the three parameters of the curve are fitted on at most ``curve_rows`` documents, those with
the least hash of their id in a quarter of all, which the models leave out. Words are hashed into 2**20
buckets, beginnings into 2**18 a level, so what goes to the executors has a fixed size. Labelled texts are
read in place: only ids and hashes of texts are shuffled, and counts, combined first. Every document is scored, whole.

Edge cases: null and empty texts have no expressions and get the curve's score at zero; null labels
don't count; of several labels of a document the largest counts; with no label of one class the
score is the share of toxic labels, or 0. Null ids are never training rows; a row that repeats both id and
text of another counts like it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, cut_lineage, mix, row_blocks, text_buffer

WORDS, STARTS = 20, 18  # bits of the hashed tables
PREFIXES = (7, 5, 4)  # bytes of a word's beginnings
DISCOUNT = 0.75
MARGIN = 0.25
BLOCK = 1 << 18
SENT = 1 << 20  # most ids (32 bytes each) that are sent to every executor

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True


def expressions(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of the words of each row and of their beginnings, and the first word of each row."""
    rows = len(offsets) - 1
    none = [np.zeros(0, np.uint64)] * (1 + len(PREFIXES)), np.zeros(rows + 1, np.int64)
    if not len(data):
        return none
    solid = LETTER[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    power = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    value = byte_table(23)[FOLD[data]] * (power[place & 63] + (place >> 6).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1E))
    value[~solid] = 0
    found = [mix(np.add.reduceat(value, starts))]
    for size in PREFIXES:
        value[place >= size] = 0
        found.append(mix(np.add.reduceat(value, starts)))
    return found, np.searchsorted(starts, offsets)


LEVELS = ["word", *(f"start{n}" for n in PREFIXES)]
COUNTS = "kind int, " + ", ".join(f"{c} long" for c in LEVELS) + ", n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, word, its beginnings, documents) of labelled rows."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in row_blocks(offsets, BLOCK):
            found, first = expressions(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            row = np.repeat(np.arange(a, b), np.diff(first))
            order = np.lexsort((found[0], row))
            words, row = found[0][order], row[order]
            own = np.append(True, (words[1:] != words[:-1]) | (row[1:] != row[:-1]))[: len(words)]
            found, kind = [x[order][own] for x in found], label[row[own]]
            order = np.lexsort((found[0], kind))
            words, kind = found[0][order], kind[order]
            heads = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (kind[1:] != kind[:-1]))[: len(words)])
            columns = [pa.array(x[order][heads].view(np.int64)) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(kind[heads].astype(np.int32)), *columns, pa.array(np.diff(np.append(heads, len(words))))], ["kind", *LEVELS, "n"])


class Model:
    """Probabilities of both classes: of a word, the part of its own count and, by level, those of its beginnings."""

    def __init__(self, counts: DataFrame):
        kept = counts.groupBy("kind", *LEVELS).agg(F.sum("n").alias("n")).persist()
        totals = {r[0]: r[1:] for r in kept.groupBy("kind").agg(F.sum("n"), F.count("*")).collect()}
        self.usable = len(totals) == 2
        if not self.usable:
            kept.unpersist()
            return
        slot = lambda name: F.shiftrightunsigned(name, 64 - (WORDS if name == "word" else STARTS)).alias("slot")
        # at most 2**WORDS and 2**STARTS slots a class
        words = kept.groupBy("kind", slot("word")).agg(F.sum("n").alias("n")).toArrow().to_pandas()
        starts, longer = [], "word"
        for name in LEVELS[1:]:
            # how many distinct longer beginnings go on from a beginning
            starts.append(kept.select("kind", longer, name).distinct().groupBy("kind", slot(name)).agg(F.count("*").alias("n")).toArrow().to_pandas())
            longer = name
        shared = kept.select(*LEVELS[-2:]).distinct().groupBy(slot(LEVELS[-1])).agg(F.count("*").alias("n")).toArrow().to_pandas()
        kept.unpersist()
        base = np.full(1 << STARTS, 0.5)
        base[shared.slot] += shared.n
        base /= base.sum()
        self.word, self.starts, unseen = [], [], []
        for kind in (0, 1):
            total, types = totals[kind]
            word = np.zeros(1 << WORDS, np.float32)
            own = words[words.kind == kind]
            word[own.slot] = np.maximum(own.n - DISCOUNT, 0) / total
            left, parts = DISCOUNT * types / total, []
            for i, counted in enumerate(starts):
                own = counted[counted.kind == kind]
                whole = own.n.sum()
                part = np.zeros(1 << STARTS)
                part[own.slot] = np.maximum(own.n - DISCOUNT, 0) / whole
                fall = DISCOUNT * len(own) / whole
                if i == len(starts) - 1:
                    part += fall * base
                parts.append((left * part).astype(np.float32))
                left *= fall
            unseen.append(left)
            self.word.append(word)
            self.starts.append(parts)
        self.margin = max(float(np.log(unseen[1] / unseen[0])), 0.0) + MARGIN

    def ratios(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each expression the log of how much likelier it is under the toxic model, and the first one of each row."""
        found, first = expressions(data, offsets)
        words, *starts = [(x >> np.uint64(64 - (STARTS if i else WORDS))).astype(np.int64) for i, x in enumerate(found)]
        chance = [self.word[k][words] + sum(p[x] for p, x in zip(self.starts[k], starts)) for k in (0, 1)]
        return np.log(chance[1] / chance[0]), first

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the difference of both log-likelihoods, and the part of it beyond the margin, both divided by its number of expressions."""
        ratio, first = self.ratios(data, offsets)
        size = np.maximum(np.diff(first), 1)
        out = []
        for x in (ratio, np.maximum(ratio - self.margin, 0)):
            total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
            out.append((total[first[1:]] - total[first[:-1]]) / size)
        return out[0], out[1]


def _evidence(shared):
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK):
                found = model.evidence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, found)], ["doc_id", "likelihood", "evidence"])

    return evidence


def _curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Slopes and intercept of a logistic regression with a small ridge, by Newton steps. x: a column a feature, each brought to a mean of 0 and a spread of 1."""
    middle, spread = x.mean(0), x.std(0) + 1e-9
    grid = np.c_[(x - middle) / spread, np.ones(len(x))]
    ridge = np.array([0.05] * x.shape[1] + [0.0])
    w = np.zeros(grid.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(grid @ w, -30, 30)))
        slope = grid.T @ (p - y) + ridge * w
        curve = grid.T @ (grid * (p * (1 - p))[:, None]) + np.diag(np.maximum(ridge, 1e-6))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / spread
    return [*slopes.tolist(), float(w[-1] - (slopes * middle).sum())]


def _beside(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` joined to ``ids``, whose number is checked: few enough are sent to the rows, more are shuffled with them."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, columns)


def score(docs: DataFrame, labels: DataFrame, held_out, curve_rows: int = 4_000) -> DataFrame:
    """doc_id and score (0 to 1) of every document of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic; rows for which the column ``held_out`` (over doc_id) is true are
    not learned from.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = [F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two")]
    marked = _beside(docs.select("doc_id", *key), marks, ["doc_id"])
    firsts = marked.groupBy("one", "two").agg(F.min(F.struct("doc_id", "toxic")).alias("own")).select("one", "two", "own.*")
    order = F.xxhash64("doc_id")
    firsts = cut_lineage(firsts.withColumn("part", F.pmod(F.shiftright(order, 7), F.lit(4))))
    curve = firsts.filter("part = 0").orderBy(order, "doc_id", "one").limit(curve_rows)
    curve = cut_lineage(curve.select("doc_id", "one", "two", "toxic"))
    # ids of the curve's rows: at most curve_rows
    learned = firsts.join(F.broadcast(curve), ["doc_id", "one", "two"], "left_anti").select("doc_id", "one", "two", "toxic")
    keyed = docs.select("doc_id", "text", *key)
    model = Model(_beside(keyed, learned, ["doc_id", "one", "two"]).select("text", "toxic").mapInArrow(_count, COUNTS))
    if not model.usable:
        share = marks.agg(F.avg("toxic")).first()[0] or 0.0
        return docs.select("doc_id", F.lit(float(share)).alias("score"))
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id long, likelihood double, evidence double"
    back = keyed.join(F.broadcast(curve), ["doc_id", "one", "two"]).select("toxic", "text").mapInArrow(_evidence(shared), schema.replace("doc_id long", "doc_id int")).toPandas()
    points = np.c_[back.likelihood.to_numpy(), np.log(back.evidence.to_numpy() + 1e-3)]
    both, beyond, intercept = _curve(points, back.doc_id.to_numpy(float)) if back.doc_id.nunique() == 2 else (0.0, 4.0, 4.0 * np.log(50.0))
    line = F.col("likelihood") * both + F.log(F.col("evidence") + 1e-3) * beyond + intercept
    return docs.mapInArrow(_evidence(shared), schema).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))
