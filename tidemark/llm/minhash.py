"""Near-duplicates by order MinHash and banded alignment.

A text's k-mers are its runs of five words (all words, if fewer), labelled by their occurrence, so that
repeats count. Each of 16 sketches hashes them anew, takes the three least and puts these back in text
order: two texts share a sketch if they share those k-mers in that order, which follows edit similarity.

1. Texts with equal words collapse into their document with the least id.
2. Per sketch value, the two most central documents (those that share their sketches with the most others)
   and the one with the least id lead; every other document is a candidate with them. No group is
   gathered.
3. Candidates are aligned: with n and m k-mers of which c can be matched in order, within the band that
   the bound allows, the similarity is c / (n + m - c), and 0.8 links them. It equals the Jaccard
   similarity of the labelled k-mers where their order agrees, and is less where it doesn't.
4. Classes are the connected components of the links, found by alternating star contractions.
5. Documents whose sketches still join several classes meet by their rarest k-mers: with k-mers in one order,
   those of one class first, then by frequency, a pair that reaches the bound shares one of the first few of
   both, how few following from both lengths (in bands of 5 %). A class's least document per k-mer goes
   first, as classes that merge then need no more pairs; then all documents that are still apart, so no link
   between texts that share a sketch is lost. A k-mer of a third of all texts comes last in the
   order, so only texts that are nearly nothing else meet by it.

At a similarity of 0.8 a sketch agrees with probability about 0.51, one of 16 with 0.99999.

Edge cases: words are split at ASCII white space of the text in lower case; a null text is empty, and
texts without words are copies of each other. Texts of any length are aligned in full. Null ids are
classed with equal texts only and have a null class if none of these has an id. Rows that share an id are
rows of one document, which counts with its longest text (then the greatest hash). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, lean, mix, row_blocks, stored, text_buffer, word_hashes

WORDS = 5  # words of a k-mer
SKETCHES, PICKS = 16, 3
LEADERS = 2  # most central documents that lead a group
BAND = 1.05  # ratio of lengths within a band
BLOCK = 1 << 18
ODD = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
TURN = (mix(np.arange(201, 201 + SKETCHES, dtype=np.uint64)) | np.uint64(1))[:, None]
PLACE = mix(np.arange(301, 301 + PICKS, dtype=np.uint64)) | np.uint64(1)


def kmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-mers of each row, and the first of each row."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    sizes = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if not len(words):
        return np.zeros(0, np.uint64), ends
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    whole = np.zeros(len(words), np.uint64)
    for j in range(WORDS):
        whole += padded[j : j + len(words)] * ODD[j]
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = first[row] + np.arange(ends[-1]) - ends[row]
    out = whole[at]
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):  # shorter than a k-mer
        own = words[first[i] : first[i + 1]]
        out[ends[i]] = (own * ODD[: len(own)]).sum() + np.uint64(counts[i])
    return mix(out), ends


def labelled(found: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """k-mers marked with how many equal ones of their row come before."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((found, row))
    new = np.append(True, (found[order][1:] != found[order][:-1]) | (row[order][1:] != row[order][:-1])) if len(found) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    before = np.arange(len(found)) - starts[np.cumsum(new) - 1] if len(found) else np.zeros(0, int)
    out = np.empty_like(found)
    out[order] = found[order] + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def sketch(row: np.ndarray) -> np.ndarray:
    """Sketch values of one text's labelled k-mers."""
    g = row[None, :] * TURN
    g ^= g >> np.uint64(31)
    g *= np.uint64(0x9E3779B97F4A7C15)
    if row.size > PICKS:
        least = np.sort(np.argpartition(g, PICKS - 1, axis=1)[:, :PICKS], axis=1)  # in text order
        return mix((row[least] * PLACE).sum(1) + TURN[:, 0])
    return mix((row * PLACE[: row.size]).sum() + TURN[:, 0] + np.uint64(row.size))


def whole(found: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of all k-mers of each row in their order."""
    place = np.arange(len(found)) - np.repeat(ends[:-1], np.diff(ends))
    turned = mix(found + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sums = []
    for x in (turned, mix(turned.copy())):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pc.utf8_lower(pc.fill_null(column, "")))


@lean
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _folded(batch.column(1))
        for a, b in row_blocks(offsets, BLOCK):
            found, ends = kmers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            marked = labelled(found, ends)
            one, two = whole(found, ends)
            values, counts = [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = marked[s:e]
                counts.append(e - s)
                values.append(sketch(own).view(np.int64) if e > s else np.zeros(0, np.int64))
            spots = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(one), pa.array(two), spots], ["doc_id", "n", "one", "two", "values"])


@lean
def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32-bit fingerprints of the k-mers in text order."""
    for batch in batches:
        data, offsets = _folded(batch.column(1))
        for a, b in row_blocks(offsets, BLOCK):
            found, ends = kmers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            low = (found >> np.uint64(32)).astype(np.uint32)
            one, two = whole(found, ends)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(one), pa.array(two), pa.array([low[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])], pa.binary())], ["doc_id", "one", "two", "prints"])


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The most pairs of equal items in the same order, with at most ``most`` items left over on both sides; fewer may be returned if there are more left over.

    Equal ends are taken off, then rows of the alignment are run as bits of one integer, columns beyond the
    band being masked.
    """
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    head = int(differ.argmax()) if differ.any() else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = a[::-1][:n] != b[::-1][:n]
    tail = int(differ.argmax()) if differ.any() else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, band = full, (1 << 2 * most + 1) - 1
    for j, x in enumerate(b):
        hit = places.get(x, 0)
        if hit:
            # columns j - most to j + most
            hit &= band << j - most if j > most else band >> most - j
            own = row & hit
            row = ((row + own) | (row - own)) & full
    return head + tail + len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, bound: float) -> bool:
    """Whether two texts' k-mers reach the bound, aligned within the band that it allows."""
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    need = bound * (n + m) / (1 + bound) - 1e-9  # matches that reach the bound
    return min(n, m) >= need and aligned(a, b, int(n + m - 2 * need) + 1) >= need


def _verify(bound: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            found = [similar(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), bound) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["a", "b", "linked"])

    return verify


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of the component of every node of the undirected links (a, b)."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # large star: neighbours above a node go to the least neighbour
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its neighbours below it go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = state


def _measured(pairs: DataFrame, prints: DataFrame, bound: float) -> DataFrame:
    one, two = (prints.select(F.col("doc_id").alias(c), F.col("prints").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    sides = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return stored(sides.mapInArrow(lean(_verify(bound)), "a long, b long, linked boolean"))


@lean
def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, owner, item): the labelled k-mers of each text, a row each."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) // 4 for x in batch.column(3)], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in row_blocks(offsets, BLOCK):
            found = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3).slice(a, b - a))])
            row = pa.array(np.repeat(np.arange(a, b), sizes[a:b]))
            marked = labelled(found.astype(np.uint64), offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(3)), pa.array(marked.view(np.int64))], ["doc_id", "n", "owner", "item"])


def _need(n, m, bound: float):
    """Matches with which texts of n and m k-mers reach the bound."""
    return F.ceil((n + m) * (bound / (1 + bound)) - 1e-9)


def _heads(split: DataFrame, bound: float) -> DataFrame:
    """The k-mers by which each document of ``split`` (doc_id, n, owner, prints) has to meet those of other classes.

    All k-mers are put in one order: those of a single class first, then by the number of documents that hold
    them, rare ones first. Two texts of n and m k-mers that share at least ``need`` of them share one among the
    first n - need + 1 of the one and the first m - need + 1 of the other. As need depends on both
    lengths, a text's first k-mers are given out by the other side's band of lengths.
    """
    items = split.mapInArrow(_items, "doc_id long, n long, owner long, item long")
    held = items.groupBy("item").agg(F.count("*").alias("docs"), F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    # a document's own k-mers
    mixed = items.join(held.filter("lo < hi").select("item", "docs"), "item").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("docs", "item"))).alias("mixed"))
    n, step = F.col("n"), float(np.log(BAND))
    band = lambda x: F.floor(F.log(x) / step)
    rows = mixed.withColumns({"own": band(n), "far": F.explode(F.sequence(band(n * bound - 1e-6), band(n / bound + 1e-6)))})
    least = F.greatest(F.floor(F.pow(F.lit(BAND), F.col("far"))) - 1, F.ceil(n * bound - 1e-6))  # of the other side
    rows = rows.withColumn("before", n - F.size("mixed")).withColumn("take", n - _need(n, least, bound) + 1 - F.col("before")).filter("take > 0")
    rows = rows.select("doc_id", "n", "own", "far", "before", F.posexplode(F.slice("mixed", F.lit(1), F.col("take").cast("int"))).alias("at", "head"))
    return rows.select("doc_id", "n", (F.col("before") + F.col("at")).alias("at"), F.col("head.item").alias("item"), F.least("own", "far").alias("lower"), F.greatest("own", "far").alias("upper"), (F.col("own") <= F.col("far")).alias("low"), (F.col("own") >= F.col("far")).alias("high"))


def _meeting(heads: DataFrame, bound: float, firsts: bool) -> DataFrame:
    """Pairs a < b of documents of different classes that share one of their first k-mers and may reach the bound; of each class's documents with such a k-mer only the least, if ``firsts``."""
    key = ["item", "lower", "upper"]
    sides = []
    for side, x in (("low", "_x"), ("high", "_y")):
        rows = heads.filter(side).select(*key, "owner", F.struct("doc_id", "n", "at").alias(x))
        sides.append((rows.groupBy(*key, "owner").agg(F.min(x).alias(x)) if firsts else rows).withColumnRenamed("owner", f"{x}o"))
    x, y = F.col("_x"), F.col("_y")
    need = _need(x["n"], y["n"], bound)
    near = (x["n"] - x["at"] >= need) & (y["n"] - y["at"] >= need)
    met = sides[0].join(sides[1], [*(sides[0][k] == sides[1][k] for k in key), F.col("_xo") != F.col("_yo"), near, (F.col("_x.doc_id") < F.col("_y.doc_id")) | (sides[0]["lower"] < sides[0]["upper"])])
    return met.select(F.least(x["doc_id"], y["doc_id"]).alias("a"), F.greatest(x["doc_id"], y["doc_id"]).alias("b")).distinct()


def classes(docs: DataFrame, bound: float = 0.8) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class), one row a row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    found = stored(docs.mapInArrow(_sketch, "doc_id long, n long, one long, two long, values array<long>"))
    equal, group = ["n", "one", "two"], ["turn", "value"]
    named = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(*equal, "values")).alias("r")).select("doc_id", "r.*")
    firsts = named.groupBy(*equal).agg(F.min(F.struct("doc_id", "values")).alias("r")).select(*equal, F.col("r.doc_id").alias("first"), "r.values")
    firsts = stored(firsts)
    spots = firsts.select(F.col("first").alias("doc_id"), "n", F.posexplode("values").alias(*group))
    shared = stored(spots.join(spots.groupBy(*group).agg(F.count("*").alias("size")).filter("size > 1"), group))
    centre = shared.groupBy("doc_id").agg(F.sum("size").alias("centre"))
    own = firsts.select(F.col("first").alias("doc_id"), "one", "two").join(centre.select("doc_id"), "doc_id", "left_semi")
    prints = stored(docs.mapInArrow(_prints, "doc_id long, one long, two long, prints binary").join(own, ["doc_id", "one", "two"]).dropDuplicates(["doc_id"]).select("doc_id", "prints"))
    members = stored(shared.join(centre, "doc_id").select(*group, "doc_id", "n", "centre"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("centre"), "doc_id"))
    leaders = members.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).select(*group, F.col("doc_id").alias("leader"))
    leaders = leaders.union(members.groupBy(*group).agg(F.min("doc_id").alias("leader")))
    led = members.join(leaders, group).filter("doc_id <> leader").select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
    tested = _measured(led, prints, bound)
    groups = cut_lineage(components(tested.filter("linked").select("a", "b")))
    owned = lambda rows, c, to: rows.join(groups.select(F.col("node").alias(c), F.col("least").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    placed = owned(members, "doc_id", "owner")
    split = placed.groupBy(*group).agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter("lo < hi").select(*group)
    split = placed.join(split, group, "left_semi").select("doc_id", "n", "owner").distinct().join(prints, "doc_id").select("doc_id", "n", "owner", "prints")
    heads = stored(_heads(split, bound))
    for least in (True, False):
        fresh = _meeting(owned(heads, "doc_id", "owner"), bound, least)
        fresh = stored(fresh.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue
        found_now = _measured(fresh, prints, bound)
        tested = tested.unionByName(found_now)
        # classes that a link joins, by their least documents
        joined = owned(owned(found_now.filter("linked"), "a", "u"), "b", "v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
        wider = cut_lineage(components(joined))
        moved = groups.withColumnRenamed("least", "old").join(wider.select(F.col("node").alias("old"), "least"), "old", "left").select("node", F.coalesce("least", "old").alias("least"))
        groups = cut_lineage(moved.unionByName(wider.join(groups.select("node"), "node", "left_anti")))
    groups = groups.withColumnsRenamed({"node": "first"})
    firsts = firsts.select(*equal, "first").join(groups, "first", "left").select(*equal, F.coalesce("least", "first").alias("class_id"))
    known = named.select("doc_id", *equal).join(firsts, equal).select("doc_id", "class_id")
    return found.filter("doc_id is not null").select("doc_id").join(known, "doc_id").unionByName(found.filter("doc_id is null").join(firsts, equal, "left").select("doc_id", "class_id"))


def keep_first(docs: DataFrame, bound: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the first of its class. Rows without an id stay.

    Rows with the same id and text come out once (of those that differ in other columns the one with the
    least hash); an id's rows with other texts are rows of that document and stay with it.
    """
    named, columns = docs.filter("doc_id is not null"), docs.columns
    kept = classes(named, bound).select(F.col("class_id").alias("doc_id")).distinct()
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    once = named.join(kept, "doc_id", "left_semi").groupBy("doc_id", text.alias("_text"), F.length("text").alias("_length")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
    return once.select("_row.*").unionByName(docs.filter("doc_id is null"))
