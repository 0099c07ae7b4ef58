import json
import re
from collections import Counter, defaultdict

from tidemark.llm import lines, tools

from .helpers import documents, frame


def masked(line):
    return " ".join("<*>" if re.search("[0-9@]", t) else t for t in line.split())


def brute(rows, least_docs, least_tokens, similarity=0.7):
    """The tree by hand: a leaf's tokens stay in their place if enough of its lines have them there."""
    places = defaultdict(list)
    for i, t in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= least_tokens:
                places[masked(line)].append((i, n))
    leaves = defaultdict(list)
    for form in places:
        words = form.split()
        leaves[len(words), tuple(words[:3])].append(words)
    found = defaultdict(list)
    for (size, lead), forms in leaves.items():
        support = Counter()
        for words in forms:
            support.update({(at, w): len({i for i, _ in places[" ".join(words)]}) for at, w in enumerate(words)})
        for words in forms:
            template = [w if at < 3 or support[at, w] >= least_docs else "<*>" for at, w in enumerate(words)]
            if sum(w != "<*>" for w in template) >= similarity * size - 1e-9:
                found[" ".join(template)] += places[" ".join(words)]
    drop = set()
    for spots in found.values():
        if len({i for i, _ in spots}) >= least_docs:
            drop |= set(sorted(spots)[1:])
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in drop) for i, t in rows}


def test_lines_equal_brute_force(spark):
    rows = [(i, t) for i, t in documents(21) if " " not in (t or "")]
    rows += [(300 + i, f"Intro {i}\nContact us at mail{i}@example.com or call {i}55\n  Contact  us at x@y or call 7 \nend") for i in range(8)]
    got = lines.dedup_lines(frame(spark, rows))
    assert got.columns == [*frame(spark, []).columns, "n_lines", "n_dropped"]
    want = brute(rows, 5, 3)
    found = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in found.items()} == want
    assert found[300].n_dropped == 1 and found[301].n_dropped == 2 and found[301].text == "Intro 1\nend"


def test_fields_that_are_words(spark):
    names = ["Ada", "Grace", "Alan", "Edsger", "Barbara", "Donald", "Leslie"]
    rows = [(i, f"This page was written by {n} in the month of {m} for all\nown words of {n} here\nAll rights reserved\nSee also:") for i, (n, m) in enumerate(zip(names, ["May", "June"] * 4))]
    rows += [(20 + i, f"The old mill stands {w} {x}") for i, (w, x) in enumerate(zip("by in at on up to".split(), "sea town bay hill river bank".split()))]
    rows += [(40, "This page was written by hand with the help of a friend")]
    want = brute(rows, 5, 3)
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == want
    # the first document keeps its lines; a name in place of a constant, or ends without enough in common, keep theirs
    assert got[1] == "See also:" and got[0] == rows[0][1] and got[40] == rows[-1][1]
    assert [got[i] for i in range(20, 26)] == [t for i, t in rows if 20 <= i < 26]


def test_forms_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    rows = [(i, t) for i, t in documents(22)]
    want = sorted((r.doc_id, r.text) for r in lines.dedup_lines(frame(spark, rows)).collect())
    monkeypatch.setattr(lines, "SENT", 0)
    assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(frame(spark, rows)).collect()) == want


def test_lines_with_null_ids_and_repeats(spark):
    rows = [(None, "one two three four")] + [(i, "one two three four") for i in range(5)] + [(3, "one two three four"), (9, None)]
    got = lines.dedup_lines(frame(spark, rows)).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_dropped) for r in got) == [(-1, 0), (0, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (9, 0)]
    assert lines.dedup_lines(frame(spark, [])).collect() == []


SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "stop": {}}
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, content string"


def link(spark, calls, results):
    df = spark.createDataFrame([(*c, "clash") for c in calls], CALLS)
    return {(r.conv_id, r.call_id): r for r in tools.link(df, spark.createDataFrame(results, "conv_id long, call_id string, content string"), SCHEMAS).collect()}


def test_links_orders_validates_and_serialises(spark):
    calls = [
        (1, 3, "c", "add", '{"b": 2.5, "a": 1}', ["a", "b"]),
        (1, 1, "a", "add", '{"a": "x", "extra": null}', []),
        (1, 2, "b", "stop", "{}", ["a"]),
        (1, 4, "d", "add", "not json", None),
        (1, 5, "x", "add", '{"a":1,"b":1}', ["y"]),
        (1, 6, "y", "add", '{"a":1,"b":1}', ["x"]),
        (1, 7, "z", "jump", "[1]", ["missing"]),
        (2, 1, "a", "stop", None, ["c"]),
        (2, 2, None, "stop", "{}", None),
        (2, 3, "r", "stop", "{}", ["r2"]),
        (2, 3, "r", "stop", "{}", ["r2"]),
    ]
    results = [(1, "c", 'say "hi"\n'), (1, "a", "2"), (1, "a", "1"), (2, "a", None), (3, "c", "other"), (1, None, "lost")]
    got = link(spark, calls, results)
    level = {k: r.level for k, r in got.items()}
    assert (level[1, "a"], level[1, "b"], level[1, "c"]) == (0, 1, 2)
    assert {k: r.status for k, r in got.items()} == {(1, "a"): "ok", (1, "b"): "missing_result", (1, "c"): "ok", (1, "d"): "missing_result", (1, "x"): "cycle", (1, "y"): "cycle", (1, "z"): "unresolved", (2, "a"): "unresolved", (2, None): "no_id", (2, "r"): "unresolved"}
    assert got[1, "c"].errors == [] and got[1, "b"].errors == []
    assert got[1, "a"].errors == ["a:type", "b:missing", "extra:unknown"]
    assert got[1, "d"].errors == ["arguments:malformed"] and got[1, "z"].errors == ["arguments:malformed"] and got[2, "a"].errors == ["arguments:malformed"]
    record = got[1, "c"].json
    assert record == '{"arguments":{"a":1,"b":2.5},"id":"c","level":2,"name":"add","result":"say \\"hi\\"\\n","status":"ok"}'
    assert json.loads(got[1, "a"].json)["result"] == "1"


def test_whole_numbers_and_nulls(spark):
    calls = [(1, 1, "a", "add", '{"a":1.0,"b":1e2}', []), (1, 2, "b", "add", '{"a":1.5,"b":1}', []), (1, 3, "c", "add", "{", []), (1, 4, "d", "add", '{"a":12345678901234567890,"b":0}', [])]
    got = link(spark, calls, [(1, "a", None)])
    assert got[1, "a"].errors == [] and got[1, "b"].errors == ["a:type"] and got[1, "d"].errors == []
    assert json.loads(got[1, "a"].json) == {"arguments": {"a": 1, "b": 100}, "id": "a", "level": 0, "name": "add", "status": "ok"}
    assert json.loads(got[1, "c"].json) == {"id": "c", "level": 0, "name": "add", "status": "missing_result"}


def test_no_calls(spark):
    assert link(spark, [], [(1, "a", "x")]) == {}


def test_long_chain(spark):
    calls = [(1, i, f"c{i}", "stop", "{}", [f"c{i - 1}"] if i else None) for i in range(12)]
    got = link(spark, calls, [])
    assert [got[1, f"c{i}"].level for i in range(12)] == list(range(12))


def test_orphaned_and_surplus_results(spark):
    calls = spark.createDataFrame([(1, 1, "a", "stop", "{}", [], ""), (1, 2, "b", "stop", "{}", [], ""), (2, 1, None, "stop", "{}", [], "")], CALLS)
    results = [(1, "a", "1"), (1, "a", "1"), (1, "a", "2"), (1, "a", None), (1, "b", None), (3, "a", "x"), (3, "a", "x"), (1, None, "lost"), (None, "a", "y")]
    got = tools.orphans(calls, spark.createDataFrame(results, "conv_id long, call_id string, content string")).collect()
    want = [(1, "a", "1", "surplus_result"), (1, "a", "2", "surplus_result"), (1, "a", None, "surplus_result"), (3, "a", "x", "missing_call"), (3, "a", "x", "missing_call"), (1, None, "lost", "no_id"), (None, "a", "y", "no_id")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
