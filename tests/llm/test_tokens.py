import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers

from tidemark.llm import packing, pieces

from .helpers import documents, frame

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 3000)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = documents() + [(None, "no id"), (900, "<s> </s> <0x41> ▁marker ▁▁"), (901, "   "), (902, "ends  ")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids, r.decoded) for r in pieces.encode(frame(spark, rows), PIECES).collect())
    want = sorted((i is None, i or 0, len(e), e, model.decode(e)) for i, t in rows for e in [model.encode(t or "", add_eos=True)])
    assert got == want
    assert pieces.encode(frame(spark, []), PIECES).collect() == []


def test_split_condition():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert pieces.splittable(model)

    class Crossing:
        def __getattr__(self, name):
            return getattr(model, name)

        def __len__(self):
            return len(model)

        def id_to_piece(self, i):
            return "of▁the" if i == 500 else model.id_to_piece(i)

    assert not pieces.splittable(Crossing())


def test_ids_equal_the_library():
    whole, mine = tokenizers.Tokenizer.from_file(BYTES), packing.Tokenizer(BYTES)
    assert mine.fast
    for _, t in documents() + [(0, "a<|endoftext|>b"), (0, " " * 3000 + "x"), (0, "I'll we've 12three\r\n\r\n")]:
        assert mine.encode(t or "") == whole.encode(t or "", add_special_tokens=False).ids


def test_pack_covers_every_id_once(spark):
    whole = tokenizers.Tokenizer.from_file(BYTES)
    rows = documents()
    found = packing.pack(frame(spark, rows), BYTES).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in by[i]]).tolist() == ids
        assert [r.start for r in by[i]] == np.cumsum([0] + [r.length for r in by[i]])[:-1].tolist()
        assert {r.doc_tokens for r in by[i]} == {len(ids)}
    fill, pad = {}, 0
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and r.length > 0
        fill[r.sequence_id] = r.offset + r.length
    for n in fill.values():
        assert n <= 1024
        pad += 0 if n & (n - 1) == 0 else 1024 - n
    assert pad <= 0.01 * sum(fill.values())
    assert packing.pack(frame(spark, []), BYTES).collect() == []


def test_cuts_are_optimal():
    """Against the plain quadratic recurrence."""
    rng = np.random.default_rng(6)
    for _ in range(20):
        ends = np.cumsum(rng.integers(1, 90, 12))
        total = int(ends[-1])
        sentences = np.unique(rng.integers(1, total, 15))
        price = {p: packing.INSIDE for p in range(0, total, packing.GRID)} | {int(p): packing.SENTENCE for p in sentences} | {int(p): 0 for p in ends} | {0: 0}
        places, size = sorted(price), 128
        cost = {0: 0}
        pad = lambda n: 0 if n in (size, size // 2) else size - n
        for p in places[1:]:
            cost[p] = min(cost[q] + pad(p - q) for q in places if q < p and p - q <= size) + price[p]
        at = packing.cuts(ends, sentences, size)
        assert at[0] == 0 and at[-1] == total and all(0 < b - a <= size for a, b in zip(at, at[1:]))
        best = min(cost[p] + packing.ending(total - p, size) for p in places if 0 < total - p <= size)
        spent, found = 0, []
        for i, p in enumerate(at[:-1]):
            spent += pad(p - at[i - 1]) + price.get(p, 10**6) if i else 0
            if total - p <= size:
                found.append(spent + packing.ending(total - p, size))
        assert best in found
