from collections import Counter


import corpus_pipeline as cp
from tidemark.llm import quality

from . import test_lines_and_tools, test_near, test_substrings
from .helpers import documents

COPY = "a passage of ordinary words that several documents without an id hold é"


def rows_of(rows):
    """With a language and source that name the row."""
    return [(i, t, f"l{k}", None if k % 5 == 0 else f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def found(df):
    return Counter(tuple(r) for r in df.select(*cp.COLUMNS).collect())


def passages(rows):
    left = test_substrings.brute([r[:2] for r in rows], 50)
    out = Counter()
    for r, (i, _, removed, _, kept) in zip(rows, left):
        text = kept.decode("utf-8", "replace").replace("�", "") if removed else r[1] or ""
        out[i, text, r[2], r[3], len(text)] += 1
    return out


def test_passages_keep_each_row_once(spark):
    rows = rows_of([(None, "first " + COPY), (None, "second " + COPY), (None, None), (3, "other " + COPY), (3, COPY + " again"), (3, None), (4, "short")])
    assert found(cp.dedup_passages(spark, docs(spark, rows), "")) == passages(rows)


def test_stages_equal_brute_force(spark):
    # lines of the brute force split at white space of any kind, so odd spaces are left out
    plain = [(i, t) for i, t in documents(31, 40) if " " not in (t or "") and "\t" not in (t or "")]
    rows = rows_of([*plain, (None, "no id at all"), (None, "no id at all"), (500, None)])
    judged = {r.doc_id: r.keep for r in quality.classify(docs(spark, rows)).collect() if r.doc_id is not None}
    got = found(cp.classify_quality(spark, docs(spark, rows), ""))
    assert {r for r in got if r[0] is not None} == {r for r in rows if r[0] is not None and judged[r[0]]}
    named = [r for r in rows if r[0] is not None]
    left = test_lines_and_tools.brute([r[:2] for r in named], 5, 3)
    assert found(cp.dedup_lines(spark, docs(spark, named), "")) == Counter((i, left[i], a, b, len(left[i])) for i, _, a, b, _ in named)
    classes = test_near.brute([r[:2] for r in named if len(r[1] or "") < 5000])
    want = [r for r in rows if r[0] is None or len(r[1] or "") >= 5000 or classes[r[0]] == r[0]]
    assert found(cp.dedup_near(spark, docs(spark, rows), "")) == Counter(want)
    assert found(cp.dedup_passages(spark, docs(spark, rows), "")) == passages(rows)


def test_run_equals_its_stages(spark, tmp_path):
    rows = rows_of([*documents(32, 40), (None, "no id " + COPY), (None, "no id " + COPY)])
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    step = docs(spark, rows)
    for _, stage in cp.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, "").collect(), step.schema)
    import public_tokenizers
    from tokenizers import Tokenizer

    book = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, n) for r in step.collect() for n in [len(book.encode(r.text or "", add_special_tokens=False).ids) + 1])  # with the end of the text
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert all(r.length <= 1024 for r in pieces)
    for key in {r[0] for r in want}:
        assert sum(r.length for r in pieces if r.doc_id == key) == sum(n * k for (i, n), k in want.items() if i == key)
