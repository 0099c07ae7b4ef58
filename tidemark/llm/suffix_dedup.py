"""Exact substring deduplication by a distributed, common-prefix-aware merge of suffix runs.

Every byte covered by a ``width``-byte string that also starts in a document with a smaller id is
removed. All strings are judged on the input.

1. ``pack``: documents are packed into compressed chunks of a few MB, written once to the shared
   checkpoint folder; a chunk is the unit that later steps send messages to.
2. ``suspects``: each ``width``-byte window is owned by an anchor, the leftmost of its k-grams with the
   least hash. Equal windows have equal anchors at equal distance, so only anchors whose k-gram occurs
   in two documents can own repeated windows. Chunks send each distinct k-gram hash once, with its
   number of documents, to the bucket of its leading bits; buckets tell the chunks which recur.
3. ``runs``: for every recurring anchor a chunk takes the suffix that starts at the anchor and ends with
   the anchor's last window, and the bytes before it that its first window needs. Equal ones collapse.
   The suffixes of a bucket go out as a sorted, front-coded run. Anchors with many occurrences
   (a passage in a third of all documents) go out window by window instead, spread over all buckets,
   once a chunk, so that no bucket gathers a hot k-gram.
4. ``merge``: a bucket merges its runs by a loser tree that keeps each head's common prefix with the last
   winner and compares only bytes beyond it. Suffixes with a common k-gram come out side by side;
   the least id of every distinct window goes back to the chunks.
5. ``apply``: chunks mark the covered bytes and return what is left.

Edge cases: a null text is empty; empty texts and texts under ``width`` bytes come back whole. A row
with a null id counts as later than every id and never causes a removal. Rows with equal ids don't
remove each other's bytes. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_table, cut_lineage, lean, lean_cogroup, lean_group, mix, text_buffer

CHUNK = 4 << 20  # bytes of text in a chunk
SLICE = 1 << 18  # windows hashed at once
GRAM = 24  # bytes of an anchor's k-gram
HOT = 4096  # occurrences from which an anchor's windows go out one by one
BITS = 48  # hash bits kept beyond the bucket
NO_ID = np.iinfo(np.int64).max


def _zip(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    tags: list[str | None] = []
    held = 0

    def chunk() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in texts], np.int64)
        row = [[part << 32 | made], [int(lengths.sum())], [np.array(ids, np.int64).tobytes()], [lengths.tobytes()], [_zip(json.dumps(tags).encode())], [_zip(b"".join(texts), 9)]]
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), *(pa.array(x, pa.binary()) for x in row[2:])], ["chunk", "bytes", "ids", "lengths", "tags", "data"])

    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for i, (doc, tag) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            tags.append(tag)
            texts.append(data[offsets[i] : offsets[i + 1]].tobytes())
            ids.append(NO_ID if doc is None else doc)
            held += len(texts[-1])
            if held >= CHUNK:
                yield chunk()
                ids, texts, tags, held, made = [], [], [], 0, made + 1
    if ids:
        yield chunk()


def _anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: k-gram hash, anchor, first window, last window, row."""
    table, grams = byte_table(11), width - GRAM + 1
    found = []
    starts, ends = offsets[:-1], offsets[1:] - width  # first and last window of each row
    long = ends >= starts
    starts, ends = starts[long], ends[long]
    for at in range(0, max(len(data) - width + 1, 0), SLICE):
        part = data[at : at + SLICE + width - 1]
        windows = len(part) - width + 1
        h1 = table[part]
        h2 = h1[:-1] * np.uint64(0x9E3779B97F4A7C15) + h1[1:]
        h4 = h2[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h2[2:]
        h8 = h4[:-4] * np.uint64(0x165667B19E3779F9) + h4[4:]
        h16 = h8[:-8] * np.uint64(0xD6E8FEB86659FD93) + h8[8:]
        gram = mix(h16[:-8] * np.uint64(0xA0761D6478BD642F) + h8[16:])
        del h1, h2, h4, h8, h16
        key = gram & np.uint64(~0x1FFFFF & 0xFFFFFFFFFFFFFFFF)
        key |= np.arange(len(key), dtype=np.uint64)
        span, least = 1, key
        while span * 2 <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < grams:
            least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
        anchor = (least[:windows] & np.uint64(0x1FFFFF)).astype(np.int64)
        del least, key
        valid = np.zeros(windows + 1, np.int32)
        lo, hi = np.searchsorted(ends, at), np.searchsorted(starts, at + windows)
        np.add.at(valid, np.maximum(starts[lo:hi] - at, 0), 1)
        np.add.at(valid, np.minimum(ends[lo:hi] - at + 1, windows), -1)
        valid = np.cumsum(valid[:-1]) > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        last = valid.copy()
        last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
        found.append((gram[anchor[first]], anchor[first] + at, first + at, np.flatnonzero(last) + at))
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    gram, anchor, first, last = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(offsets, first, "right") - 1
    # a run cut by a slice's end goes on in the next slice
    head = np.ones(len(gram), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(head)
    return gram[heads], anchor[heads], first[heads], last[np.append(heads[1:], len(gram)) - 1], row[heads]


def _opened(row) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    raw = _unzip(row.data)
    lengths = np.frombuffer(row.lengths, np.int64)
    return np.frombuffer(row.ids, np.int64), raw, np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def _send_grams(width: int, bits: int):
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids, _, data, offsets = _opened(row)
                gram, *_, doc = _anchors(data, offsets, width)
                order = np.argsort(gram, kind="stable")
                gram, doc = gram[order] >> np.uint64(64 - BITS - bits), ids[doc[order]]
                if not len(gram):
                    continue
                new = np.append(True, gram[1:] != gram[:-1])
                pair = new | np.append(True, doc[1:] != doc[:-1])
                heads = np.flatnonzero(new)
                count = np.minimum(np.add.reduceat(pair.astype(np.int64), heads), HOT).astype(np.uint16)
                gram = gram[heads]
                bucket = (gram >> np.uint64(BITS)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(gram))
                rest = gram & np.uint64((1 << BITS) - 1)
                high, low = (rest >> np.uint64(32)).astype(np.uint16), rest.astype(np.uint32)
                out = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    steps = np.diff(high[a:b], prepend=np.uint16(0))
                    out.append((int(bucket[a]), row.chunk, b - a, _zip(steps.tobytes() + count[a:b].tobytes()) , low[a:b].tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "chunk", "n", "steps", "low"])

    return send


def _recurring(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: the k-gram hashes found in two documents, for each chunk that sent them."""
    grams, counts = [], []
    for n, steps, low in zip(frame.n, frame.steps, frame.low):
        steps = np.frombuffer(_unzip(steps), np.uint16)
        grams.append(np.cumsum(steps[:n], dtype=np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32))
        counts.append(steps[n:])
    owner = np.repeat(np.arange(len(frame)), frame.n.to_numpy())
    gram, count = np.concatenate(grams), np.concatenate(counts).astype(np.int64)
    order = np.argsort(gram, kind="stable")
    gram, count, owner = gram[order], count[order], owner[order]
    heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    total = np.repeat(np.add.reduceat(count, heads), np.diff(np.append(heads, len(gram))))
    take = total >= 2
    gram, owner, hot = gram[take], owner[take], total[take] >= HOT
    order = np.argsort(owner, kind="stable")
    gram, owner, hot = gram[order], owner[order], hot[order]
    cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner)) if len(owner) else np.zeros(1, int)
    chunk = frame.chunk.to_numpy()
    rows = [(chunk[owner[a]], key[0], _zip((gram[a:b] << np.uint64(1) | hot[a:b]).tobytes())) for a, b in zip(cuts[:-1], cuts[1:])]
    return pd.DataFrame(rows, columns=["chunk", "bucket", "blob"])


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + lengths[i], one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


#: Of a 64-bit word: its first n bytes.
FIRST = np.array([0, *((1 << 64) - (1 << 64 - 8 * n) for n in range(1, 9))], np.uint64)


def _words(words: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> list[np.ndarray]:
    """The strings at ``start`` as big-endian words, zeros after their ends: in the order of bytes."""
    return [words[np.minimum(start + 8 * j, len(words) - 1)] & FIRST[np.clip(length - 8 * j, 0, 8)] for j in range(-(-most // 8))]


def _send_runs(width: int, bits: int):
    def send(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunk.itertuples():
            if len(answers):
                out += _runs(row, answers, width, bits)
        return pd.DataFrame(out, columns=["bucket", "chunk", "n", "run"])

    return send


def _runs(row, answers: pd.DataFrame, width: int, bits: int) -> list[tuple]:
    ids, _, data, offsets = _opened(row)
    tagged = np.concatenate([np.frombuffer(_unzip(x), np.uint64) | np.uint64(b) << np.uint64(BITS + 1) for b, x in zip(answers.bucket, answers.blob)])
    tagged.sort()
    gram, anchor, first, last, doc = _anchors(data, offsets, width)
    want = gram >> np.uint64(64 - BITS - bits)
    at = np.minimum(np.searchsorted(tagged, want << np.uint64(1)), len(tagged) - 1)
    known = tagged[at] >> np.uint64(1) == want
    hot = known & (tagged[at] & np.uint64(1) > 0)
    plain, hot = np.flatnonzero(known & ~hot), np.flatnonzero(hot)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data) + 1, np.uint64)
    for j in range(8):
        words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
    # windows of hot anchors stand alone, in buckets of their own hash
    lone = _ragged(first[hot], last[hot] - first[hot] + 1)
    lone_hash = np.zeros(len(lone), np.uint64)
    for j, w in enumerate(_words(words, lone, np.full(len(lone), width), width)):
        lone_hash = lone_hash * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F + 2 * j)
    bucket = np.concatenate([want[plain] >> np.uint64(BITS), mix(lone_hash) >> np.uint64(64 - bits)]).astype(np.int64)
    lo = np.concatenate([first[plain], lone])
    a = np.concatenate([anchor[plain], lone])
    right = np.concatenate([last[plain], lone]) + width - a
    left = a - lo
    owner = ids[np.concatenate([doc[plain], np.repeat(doc[hot], last[hot] - first[hot] + 1)])]
    suffix, before = _words(words, a, right, width), _words(words, lo, left, width - GRAM)
    keys = [bucket, *suffix, right, *before, left]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    heads = np.flatnonzero(new)
    if not len(heads):
        return []
    least, most = np.minimum.reduceat(owner[order], heads), np.maximum.reduceat(owner[order], heads)
    posts = lo[order].astype(np.uint32)
    counts = np.diff(np.append(heads, len(order)))
    top = order[heads]
    common, open_ = np.zeros(len(top), np.int64), np.ones(max(len(top) - 1, 0), bool)
    for w in suffix:
        w = w[top]
        x = w[1:] ^ w[:-1]
        alike = np.full(len(x), 8)
        for j in range(8):
            alike -= x >= np.uint64(1) << np.uint64(56 - 8 * j) if j < 7 else x > 0
        common[1:] += np.where(open_, alike, 0)
        open_ &= x == 0
    bucket, right, left, a, lo = bucket[top], right[top], left[top], a[top], lo[top]
    common[1:] = np.minimum(common[1:], np.minimum(right[1:], right[:-1]))
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    common[cut] = 0
    cut = np.append(cut, len(bucket))
    ends, post_ends = np.cumsum(right - common), np.cumsum(counts)
    coded, side = data[_ragged(a + common, right - common)], data[_ragged(lo, left)]
    side_ends = np.cumsum(left)
    edge = lambda sums, i: int(sums[i - 1]) if i else 0
    out = []
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        parts = [x[s:e].astype(np.uint8) for x in (right, common, left, most > least)]
        parts += [counts[s:e].astype(np.uint32), least[s:e], posts[edge(post_ends, s) : edge(post_ends, e)], coded[edge(ends, s) : edge(ends, e)], side[edge(side_ends, s) : edge(side_ends, e)]]
        out.append((int(bucket[s]), row.chunk, e - s, _zip(b"".join(x.tobytes() for x in parts), 5)))
    return out


class _Run:
    """A chunk's front-coded run: sorted suffixes, what stands before them, and their places in the chunk."""

    def __init__(self, n: int, data: bytes):
        self.data = data = _unzip(data)
        self.right, self.common, self.left, self.several = (np.frombuffer(data, np.uint8, n, i * n).astype(np.int64) for i in range(4))
        self.counts = np.frombuffer(data, np.uint32, n, 4 * n).astype(np.int64)
        self.least = np.frombuffer(data, np.int64, n, 8 * n).tolist()
        total = int(self.counts.sum())
        self.posts = np.frombuffer(data, np.uint32, total, 16 * n)
        self.starts = np.cumsum(self.counts) - self.counts
        self.at = 16 * n + 4 * total

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
        """Common prefix with the one before, suffix, left part, several documents, least id, place."""
        data, at, last = self.data, self.at, b""
        side = at + int((self.right - self.common).sum())
        for i, (r, c, l, several, least) in enumerate(zip(self.right.tolist(), self.common.tolist(), self.left.tolist(), self.several.tolist(), self.least)):
            end = at + r - c
            last = last[:c] + data[at:end]
            at = end
            yield c, last, data[side : side + l], several, least, i
            side += l


class LoserTree:
    """Merges sorted, front-coded runs.

    A head is [common prefix with the last winner, suffix, left part, ..., run]. Of two heads the one with the
    longer known prefix is the lesser and nothing is compared; at equal prefixes, bytes are compared
    from there on, and the loser remembers what it has in common with the winner.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.tree: list = [None] * self.size
        self.top = self._build(1) if runs else None

    def _next(self, r: int):
        entry = next(self.runs[r], None) if r < len(self.runs) else None
        return None if entry is None else [*entry, r]

    def _build(self, node: int):
        if node >= self.size:
            head = self._next(node - self.size)
            if head:
                head[0] = 0
            return head
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.tree[node] = self.duel(a, b)
        return winner

    @staticmethod
    def duel(a, b):
        """Winner and loser; None is after everything."""
        if b is None or a is None:
            return (a, b) if b is None else (b, a)
        i = a[0]
        if i != b[0]:
            return (a, b) if i > b[0] else (b, a)
        s, t = a[1], b[1]
        if s == t:
            if a[2] > b[2] or a[2] == b[2] and a[-1] > b[-1]:
                a, b = b, a
            b[0] = len(s)
            return a, b
        n = min(len(s), len(t))
        while i < n and s[i] == t[i]:
            i += 1
        if i < n and s[i] > t[i] or i == n and len(s) > n:
            a, b = b, a
        b[0] = i
        return a, b

    def __iter__(self):
        tree, size, duel = self.tree, self.size, self.duel
        while self.top is not None:
            head = self.top
            yield head
            rival = self._next(head[-1])
            node = (head[-1] + size) >> 1
            while node:
                rival, tree[node] = duel(rival, tree[node])
                node >>= 1
            self.top = rival


def _merge(width: int):
    def merge(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", kind="stable")
        runs = [_Run(n, run) for n, run in zip(frame.n, frame.run)]
        whole: list[tuple[list[int], list[int]]] = [([], []) for _ in runs]  # places and least ids
        mixed: list[list[tuple[int, int, int, int]]] = [[] for _ in runs]  # place, first window, windows, least id

        def answer(classes: list[list]) -> None:
            if len(classes) == 1:
                members = classes[0]
                if len(members) == 1 and not members[0][3]:
                    return
                low = min([x[4] for x in members])
                for x in members:
                    if x[3] or low < x[4]:
                        places, ids = whole[x[6]]
                        places.append(x[5])
                        ids.append(low)
                return
            seen: dict[bytes, int] = {}
            owned = []
            for members in classes:
                text = members[0][2] + members[0][1]
                low = min([x[4] for x in members])
                windows = [text[o : o + width] for o in range(len(text) - width + 1)]
                owned.append(windows)
                for w in windows:
                    if seen.get(w, NO_ID) > low:
                        seen[w] = low
            for members, windows in zip(classes, owned):
                ids = [seen.get(w, NO_ID) for w in windows]
                least = min(ids)
                for _, _, _, several, own, place, r in members:
                    if not several and least >= own:
                        continue
                    start = 0
                    for o in range(1, len(ids) + 1):
                        if o == len(ids) or ids[o] != ids[start]:
                            mixed[r].append((place, start, o - start, ids[start]))
                            start = o

        classes: list[list] = []
        last = None
        for head in LoserTree([iter(run) for run in runs]):
            if classes and head[0] >= GRAM:
                if head[0] == len(head[1]) == len(last[1]) and head[2] == last[2]:
                    classes[-1].append(head)
                else:
                    classes.append([head])
            else:
                if classes:
                    answer(classes)
                classes = [[head]]
            last = head
        if classes:
            answer(classes)
        rows = []
        for chunk, run, (places, ids), parts in zip(frame.chunk.tolist(), runs, whole, mixed):
            if not places and not parts:
                continue
            places = np.array(places + [p[0] for p in parts], np.int64)
            windows = np.append((run.right + run.left - width + 1)[places[: len(ids)]], [p[2] for p in parts]).astype(np.uint8)
            shift = np.array([0] * len(ids) + [p[1] for p in parts], np.int64)
            ids = np.array(ids + [p[3] for p in parts], np.int64)
            counts = run.counts[places]
            spot = run.posts[_ragged(run.starts[places], counts)] + np.repeat(shift, counts)
            spot, windows, ids = spot.astype(np.uint32), np.repeat(windows, counts), np.repeat(ids, counts)
            rows.append((chunk, len(spot), _zip(spot.tobytes() + windows.tobytes() + ids.tobytes())))
        return pd.DataFrame(rows, columns=["chunk", "n", "blob"])

    return merge


def _apply(width: int):
    def apply(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunk.itertuples():
            ids, raw, data, offsets = _opened(row)
            change = np.zeros(len(data) + 1, np.int32)
            for n, blob in zip(answers.n, answers.blob):
                blob = _unzip(blob)
                spot = np.frombuffer(blob, np.uint32, n).astype(np.int64)
                windows = np.frombuffer(blob, np.uint8, n, 4 * n)
                later = np.frombuffer(blob, np.int64, n, 5 * n) < ids[np.searchsorted(offsets, spot, "right") - 1]
                spot, windows = spot[later], windows[later]
                np.add.at(change, spot, 1)
                np.add.at(change, spot + windows + (width - 1), -1)
            np.cumsum(change, out=change)
            covered = change[:-1] > 0
            del change
            edge = covered.copy()
            edge[1:] &= ~covered[:-1]
            starts = offsets[:-1][offsets[:-1] < len(data)]
            edge[starts] = covered[starts]
            gone, spans = (np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64) for _ in range(2))
            np.cumsum(covered, out=gone[1:])
            np.cumsum(edge, out=spans[1:])
            for doc, tag, a, b in zip(ids.tolist(), json.loads(_unzip(row.tags)), offsets[:-1].tolist(), offsets[1:].tolist()):
                lost = int(gone[b] - gone[a])
                kept = data[a:b][~covered[a:b]].tobytes() if lost else raw[a:b]
                out.append((None if doc == NO_ID else doc, b - a, lost, int(spans[b] - spans[a]), kept, tag))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "tag"])
        return frame.astype({"doc_id": "Int64"})

    return apply


def dedup_substrings(docs: DataFrame, width: int = 50, tag: Column | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary), one row a document.

    ``docs`` needs doc_id (integer) and text (string). ``width`` is 25 to 100 bytes. ``tag`` (string) goes
    through with its row and comes back as the column tag.
    """
    if not GRAM < width <= 100:
        raise ValueError(f"width must be from {GRAM + 1} to 100 bytes")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"), (F.lit(None).cast("string") if tag is None else tag).alias("tag"))
    chunks = cut_lineage(docs.mapInArrow(lean(_pack), "chunk long, bytes long, ids binary, lengths binary, tags binary, data binary"))
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    bits = max(8, (total >> 24).bit_length())
    grams = chunks.mapInPandas(lean(_send_grams(width, bits)), "bucket long, chunk long, n int, steps binary, low binary")
    suspects = cut_lineage(grams.groupBy("bucket").applyInPandas(lean_group(_recurring), "chunk long, bucket long, blob binary"))
    runs = chunks.groupBy("chunk").cogroup(suspects.groupBy("chunk")).applyInPandas(lean_cogroup(_send_runs(width, bits)), "bucket long, chunk long, n int, run binary")
    least = runs.groupBy("bucket").applyInPandas(lean_group(_merge(width)), "chunk long, n long, blob binary")
    whole = chunks.groupBy("chunk").cogroup(least.groupBy("chunk")).applyInPandas(lean_cogroup(_apply(width)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, tag string")
    return whole.drop("tag") if tag is None else whole
