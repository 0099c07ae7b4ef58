import numpy as np
import pytest

from tidemark.llm import suffix_dedup as sd

from .helpers import documents, frame


def brute(rows, width):
    """Least id of each string, then what is left of each document."""
    far = float("inf")
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            least[w] = min(least.get(w, far), far if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < (far if i is None else i):
                gone[p : p + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[4])


@pytest.mark.parametrize("width", [50, 30])
@pytest.mark.parametrize("hot", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, width, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = documents() + [(None, documents()[30][1]), (7, documents()[40][1]), (7, documents()[40][1])]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_substrings(frame(spark, rows), width).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, width), key=key)


def test_slices_and_chunks_do_not_show(spark, monkeypatch):
    rows = documents(5)
    want = sorted(brute(rows, 50), key=key)
    monkeypatch.setattr(sd, "SLICE", 301)
    data = b"".join((t or "").encode() for _, t in rows)
    offsets = np.cumsum([0] + [len((t or "").encode()) for _, t in rows])
    small = sd._anchors(np.frombuffer(data, np.uint8), offsets, 50)
    monkeypatch.undo()
    whole = sd._anchors(np.frombuffer(data, np.uint8), offsets, 50)
    assert all((a == b).all() for a, b in zip(small, whole))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_substrings(frame(spark, rows, 7)).collect()]
    assert sorted(got, key=key) == want


def test_empty_table(spark):
    assert sd.dedup_substrings(frame(spark, [])).collect() == []


def test_loser_tree_merges_with_known_prefixes():
    rng = np.random.default_rng(0)
    runs = []
    for _ in range(5):
        strings = sorted(bytes(rng.integers(97, 100, rng.integers(1, 9), dtype=np.uint8)) for _ in range(50))
        run, last = [], b""
        for i, s in enumerate(strings):
            c = next((k for k in range(min(len(s), len(last))) if s[k] != last[k]), min(len(s), len(last))) if i else 0
            run.append((c, s, b"", 0, 0, i))
            last = s
        runs.append(run)
    merged = list(sd.LoserTree([iter(r) for r in runs]))
    strings = [h[1] for h in merged]
    assert strings == sorted(x[1] for r in runs for x in r)
