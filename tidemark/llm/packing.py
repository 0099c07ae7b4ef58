"""Order-preserving packing of tokenized documents into sequences by dynamic programming.

The documents of a partition follow each other as one stream of ids, each closed by an end id. A cut may
fall at a document's end (free), after a sentence (a small penalty) or at a grid place inside a sentence
(a larger one); a sequence pays one for each padding token. With f(j) the least cost of everything before
cut place j, f(j) = penalty(j) + min over i of f(i) + padding(j - i), and as padding is linear in the
length, the minimum over the last ``size`` tokens comes from a monotone queue of f(i) + i. A sequence whose
length is a power of two needs no padding: half-size sequences take part in the recurrence, and what is left
at the end of a stream is split into powers of two.

Streams end at about half a million ids, so memory is bounded and no shuffle is needed; a longer
document is one stream. Each id lies in exactly one piece and the order of documents in their partition
is kept. A null text is empty and gives the end id alone; null and repeated doc_ids are carried through;
other columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAM = 1 << 19  # ids of a stream
GRID = 64  # ids between cut places inside sentences
SENTENCE, INSIDE = 4, 12  # penalties, in padding tokens
SPARE = 16  # padding up to which the end of a stream isn't split
#: The pattern that splits text before merges (a fixed value of this tokenizer family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids of a tokenizer file, by the quicker of two libraries where both must agree.

    A plain byte-level BPE whose i-th merge makes the i-th id after the bytes is the same thing as a table
    of ranks; texts that hold one of the file's added tokens go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        model, letters = spec["model"], _byte_letters()
        vocab = {token: i for token, i in model["vocab"].items() if token not in self.added}
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        steps = spec["pre_tokenizer"] or {}
        plain = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and not spec["normalizer"]
        bare = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if plain and bare and len(self.bytes) == len(vocab) and all(vocab.get(m) == 256 + i for i, m in enumerate(merges)):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    @cached_property
    def whole(self):
        """The file in its own library, which takes memory: loaded when a text needs it."""
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def encode(self, text: str) -> list[int]:
        if self.fast and not any(t in text for t in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:  # the pattern's matcher gave up, as on very long white space
                pass
        return self.whole.encode(text, add_special_tokens=False).ids

    def sentence_ends(self) -> np.ndarray:
        """Of each id: whether a sentence ends after it."""
        out = np.zeros(max([*self.bytes, *range(1)], default=0) + 1 + len(self.added), bool)
        for i, b in self.bytes.items():
            out[i] = b.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in b
        return out


def ending(rest: int, size: int) -> int:
    """Cost of the last ``rest`` ids of a stream: a little padding, or cuts into powers of two."""
    return size - rest if size - rest <= SPARE else INSIDE * (rest.bit_count() - 1)


def cuts(ends: np.ndarray, sentences: np.ndarray, size: int) -> list[int]:
    """Places at which to cut a stream: its start, then the end of each sequence. ends: of documents; sentences: places after a sentence."""
    total = int(ends[-1])
    places = np.unique(np.concatenate([[0], np.arange(GRID, total, GRID), sentences, ends]))
    price = np.full(len(places), INSIDE, np.int64)
    price[np.searchsorted(places, sentences)] = SENTENCE
    price[np.searchsorted(places, ends)] = 0
    half = np.searchsorted(places, places - size // 2)
    half = np.where(places[np.minimum(half, len(places) - 1)] == places - size // 2, half, -1).tolist()
    place, price = places.tolist(), price.tolist()
    cost, back = [0] * len(place), [0] * len(place)
    queue = deque([(0, 0)])  # (cost + place, index), costs rising
    for j in range(1, len(place)):
        p = place[j]
        first = p - size
        while place[queue[0][1]] < first:
            queue.popleft()
        least, i = queue[0]
        least += size - p
        h = half[j]
        if h >= 0 and cost[h] < least:
            least, i = cost[h], h
        least += price[j]
        cost[j], back[j] = least, i
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    last = len(place) - 1
    if last:
        # the end is split into powers of two, so it costs cuts, not padding
        near = range(bisect_left(place, total - size), last)
        back[last] = min(near, key=lambda i: cost[i] + ending(total - place[i], size))
    out, j = [], last
    while j:
        out.append(place[j])
        j = back[j]
    out.append(0)
    out.reverse()
    rest = out.pop() - (start := out[-1])
    while rest > 0:
        part = rest if size - rest <= SPARE else 1 << (rest.bit_length() - 1)
        start, rest = start + part, rest - part
        out.append(start)
    return out


def _pack(path: str, size: int, end: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path)
        closing = tokenizer.sentence_ends()
        sequence = TaskContext.get().partitionId() << 40
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def stream() -> pa.RecordBatch:
            nonlocal sequence
            lengths = np.array([len(x) for x in ids], np.int64)
            flat, ends = np.concatenate(ids), np.cumsum(lengths)
            at = np.array(cuts(ends, np.flatnonzero(closing[flat]) + 1, size))
            edges = np.unique(np.concatenate([at, ends]))
            start, stop = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, start, "right")
            own = np.searchsorted(at, start, "right") - 1
            raw = flat.astype("<u4")
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[i] for i in doc.tolist()], pa.int64()),
                    pa.array(start - (ends - lengths)[doc]),
                    pa.array(stop - start),
                    pa.array([raw[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist())], pa.binary()),
                    pa.array(lengths[doc]),
                    pa.array(sequence + own),
                    pa.array(start - at[own]),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(at) - 1
            return batch

        for batch in batches:
            for i in range(batch.num_rows):
                coded = tokenizer.encode(batch.column(1)[i].as_py() or "")
                coded.append(end)
                docs.append(batch.column(0)[i].as_py())
                ids.append(np.array(coded, np.int64))
                held += len(coded)
                if held >= STREAM:
                    yield stream()
                    docs, ids, held = [], [], 0
        if docs:
            yield stream()

    return pack


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_pack(tokenizer_path, size, end_id), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
