"""SentencePiece encoding and decoding by a table of distinct chunks.

When no piece of a model holds a whitespace marker after another character, no merge crosses from a word
into the next marker: the pieces of a text are those of its marked words (spaces, then other
characters), one after the other. So each distinct marked word is segmented once, and its ids are joined back by position.

The table belongs to a block of texts (``BLOCK`` bytes, a longer text stands alone), which bounds memory and needs no
shuffle: words are cut out and numbered without Python loops, the library segments the distinct ones, and ids and decoded
text go back to their positions by number. A table for the corpus was built and measured: the words that
are rare, each sent to the table and back to its text, take more disk than the budget (see the README).

Models whose pieces cross markers, or with pieces defined by users, are refused by ``splittable`` and go
through the library text by text. Null texts are empty; empty texts have no ids but the end. Repeated rows and null ids
are carried through; very long words are segmented like others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_blocks, text_buffer

MARK = "▁"
BLOCK = 16 << 20  # bytes of text that share a table
NONE, SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
CODED = "doc_id long, n_tokens long, ids string, decoded string"


def splittable(model) -> bool:
    """Whether pieces cannot cross whitespace markers: the condition for segmenting word by word."""
    probe = " a  b "
    whole = model.encode(probe) == model.encode(probe, add_bos=False) and model.decode(model.encode(probe)) == probe
    return whole and all(MARK not in model.id_to_piece(i).lstrip(MARK) for i in range(len(model)))


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The marked words of all texts in order (spaces, then other characters), and the first word of each text."""
    marked = pc.binary_join_element_wise(NONE, pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " "), SPACE)
    data, offsets = text_buffer(marked)
    blank = data == 32
    starts = blank.copy()
    starts[1:] &= ~blank[:-1]
    starts[offsets[:-1]] = True
    starts = np.append(np.flatnonzero(starts), len(data))
    words = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(starts, offsets)


class ChunkTable:
    """Marked words to ids (in decimal), their number, and decoded text; each distinct word is segmented once."""

    def __init__(self, model):
        self.model = model
        self.text = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(model.id_to_piece, range(len(model))))]
        self.alone = [model.piece_to_id(MARK)]

    def segment(self, words: list[str]) -> tuple[pa.Array, np.ndarray, pa.Array]:
        # the library puts the first marker
        found = self.model.encode([w[1:].replace(" ", MARK) for w in words], num_threads=1) if words else []
        found = [ids if len(w) > 1 else self.alone for w, ids in zip(words, found)]
        piece = self.text.__getitem__
        coded, decoded = [" ".join(map(str, ids)) for ids in found], [b"".join(map(piece, ids)).decode("utf-8", "replace") for ids in found]
        return pa.array(coded, pa.large_string()), np.array([len(ids) for ids in found], np.int64), pa.array(decoded, pa.large_string())

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Of each text: the ids in decimal, their number, and the decoded text."""
        words, first = chunks(texts)
        table = words.dictionary_encode()
        coded, counts, decoded = self.segment(table.dictionary.to_pylist())
        place = table.indices
        total = np.concatenate([[0], np.cumsum(counts[place.to_numpy()])])
        rows = lambda column, mark: pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), column.take(place)), mark)
        whole = rows(decoded, NONE)
        whole = pc.if_else(pc.starts_with(whole, " "), pc.utf8_slice_codeunits(whole, 1), whole)
        # an empty text is one marker, which the library leaves out
        empty = pc.equal(pc.binary_length(pc.fill_null(texts, "")), 0)
        return pc.if_else(empty, NONE, rows(coded, SPACE)), np.where(empty.to_numpy(zero_copy_only=False), 0, total[first[1:]] - total[first[:-1]]), pc.if_else(empty, NONE, whole)


class WholeTexts:
    """The library's own way, for models that word by word doesn't suit."""

    def __init__(self, model):
        self.model = model

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        found = [self.model.encode(t or "") for t in texts.to_pylist()]
        return pa.array([" ".join(map(str, ids)) for ids in found], pa.large_string()), np.array([len(ids) for ids in found], np.int64), pa.array([self.model.decode(ids) for ids in found], pa.large_string())


def _open(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, ChunkTable(model) if splittable(model) else WholeTexts(model)


def _encode(path: str, digest: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _open(path)
        end = pa.scalar(str(model.eos_id()), pa.large_string())
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK):
                coded, counts, decoded = table.encode(batch.column(1).slice(a, b - a))
                closed = pc.if_else(pc.equal(pc.binary_length(coded), 0), end, pc.binary_join_element_wise(coded, end, SPACE))
                for at in range(0, b - a, 256):
                    columns = [x.slice(at, 256) for x in (closed, decoded)]
                    if digest:
                        columns = [pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in x]) for x in columns]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + at, len(columns[0])), pa.array(counts[at : at + 256] + 1), *(x.cast(pa.string()) for x in columns)], ["doc_id", "n_tokens", "ids", "decoded"])

    return encode


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, the end id last) and decoded (the text that the ids give)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_encode(model_path, False), CODED)
    return rows.withColumn("ids", F.split("ids", " ").cast("array<int>"))


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As ``encode``, with SHA-256 digests (lowercase hex) of the decimal ids joined by a space and of the decoded text in UTF-8 in place of both, taken where they are made."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_encode(model_path, True), CODED).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
