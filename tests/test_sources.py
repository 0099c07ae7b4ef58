import json
import time

import pytest

from tidemark import cli
from tidemark.operators import delivery
from tidemark.sources import logs
from tidemark.streaming import ledger, supervise

ADDRESS = "0x" + "a" * 40


def stored(folder, blocks, name="a.jsonl"):
    rows = [{"address": ADDRESS, "topics": ["0x1"], "data": "0x", "block_number": b, "tx_hash": f"0x{b:x}", "log_index": i} for b in blocks for i in range(2)]
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


class Limited(logs.Stored):
    """Takes at most seven blocks, is busy now and then, and no longer holds blocks below ``pruned``."""

    calls = 0

    def __init__(self, options):
        super().__init__(options)
        self.pruned = int(options.get("pruned", 0))

    def logs(self, start, end):
        type(self).calls += 1
        if start < self.pruned:
            raise RuntimeError("missing trie node")
        if end - start + 1 > 7:
            raise RuntimeError("block range is too wide: up to a 7 block range")
        if type(self).calls % 5 == 0:
            raise RuntimeError("HTTP 429")
        return super().logs(start, end)


def test_chunks_shrink_wait_and_stay_in_order(tmp_path):
    stored(tmp_path, range(1, 41))
    source, size, waits = Limited({"path": str(tmp_path)}), logs.ChunkSize(30), []
    got = list(logs.fetch_chunks(source.logs, 1, 40, size, wait=waits.append))
    assert [r["block_number"] for _, _, rows in got for r in rows] == [b for b in range(1, 41) for _ in range(2)]
    assert [a for a, _, _ in got][1:] == [b + 1 for _, b, _ in got][:-1] and size.value == 7 and waits and set(waits) == {0.5}
    assert list(logs.fetch_chunks(source.logs, 5, 4, size)) == []


def test_errors_in_order_and_bounded():
    def failing(message):
        def call(start, end):
            raise RuntimeError(message)

        return call

    for message, error in (("block range: state is pruned", logs.HistoryUnavailable), ("socket closed", logs.Transient), ("limit exceeded", logs.Transient)):
        with pytest.raises(error):
            list(logs.fetch_chunks(failing(message), 1, 8, logs.ChunkSize(4), wait=lambda s: None))
    waits = []
    with pytest.raises(logs.Transient):
        list(logs.fetch_chunks(failing("too many requests"), 1, 8, logs.ChunkSize(4), wait=waits.append))
    assert waits == [0.5, 1.0, 2.0, 4.0]


def test_batch_source_records_gaps(spark, tmp_path):
    stored(tmp_path, range(0, 30))
    logs.register(spark)
    read = spark.read.format("blocklogs").option("path", str(tmp_path)).option("provider", "tests.test_sources.Limited").option("pruned", 5).option("blocksPerPartition", 10).option("maxChunk", 4).load()
    rows = read.collect()
    assert sorted(r.block_number for r in rows if r.gap_to is None) == [b for b in range(10, 30) for _ in range(2)]
    assert [(r.block_number, r.gap_to) for r in rows if r.gap_to is not None] == [(0, 9)]


def test_stream_goes_on_from_its_offset(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stored(tmp_path / "in", range(1, 11))
    logs.register(spark)

    def run():
        stream = spark.readStream.format("blocklogs").option("path", str(tmp_path / "in")).option("startBlock", 1).option("confirmations", 2).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.block_number for r in spark.read.schema(logs.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == [b for b in range(1, 9) for _ in range(2)]
    stored(tmp_path / "in", range(11, 16), "b.jsonl")
    assert run() == [b for b in range(1, 14) for _ in range(2)]


def test_ledger_applies_each_transfer_once(spark, tmp_path):
    big = 2**200 + 1
    schema = "token string, source string, target string, value string, block_number long, tx_hash string, log_index int"
    one = [("t", "a", "b", str(big), 5, "x", 0), ("t", "b", "c", "3", 6, "y", 0), ("t", ledger.NOBODY[0], "a", "9", 6, "y", 1), ("unknown", "a", "b", "1", 6, "z", 0)]
    two = [("t", "b", "c", "3", 6, "y", 0), ("t", "c", "a", "2", 20_007, "w", 0)]
    tokens = spark.createDataFrame([("t", 1)], "token string, token_id long")
    blocks = spark.createDataFrame([(5, 50), (6, 60), (20_007, 70)], "block_number long, t long")
    path = str(tmp_path / "ledger")
    write = ledger.writer(path, tokens, blocks)
    assert ledger.balances(spark, path) is None
    for number, rows in ((0, one), (0, one), (1, two), (1, two), (2, one)):
        write(spark.createDataFrame(rows, schema), number)
    got = {r.wallet: (r.balance, r.partially_observed) for r in ledger.balances(spark, path).collect()}
    # a paid out what the ledger never saw come in: clamped, then 2 more
    assert got == {"a": ("2", True), "b": (str(big - 3), False), "c": ("1", False)}


def test_history_is_appended_once(spark, tmp_path):
    write = ledger.appender(str(tmp_path / "audit"))
    for number, n in ((0, 3), (1, 2), (1, 2)):
        write(spark.range(n), number)
    assert ledger.table(spark, str(tmp_path / "audit")).groupBy("batch").count().orderBy("batch").collect() == [(0, 3), (1, 2)]


def test_tails_start_again_and_raise_alarms():
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise RuntimeError("lost")

    outcomes, alarms = iter([True] * 5 + [False] + [True] * 4 + [False]), []
    left = [11]

    def start():
        left[0] -= 1
        return Query(next(outcomes))

    failed = supervise.tail(start, lambda n, e: alarms.append((n, e)), lambda: left[0] == 0, wait=lambda s: None)
    assert failed == 9 and alarms == [(5, "lost")]


def test_jobs_are_tried_again_and_audited():
    waits, audits, left = [], [], [3]

    def flaky():
        left[0] -= 1
        if left[0]:
            raise RuntimeError("busy")
        return "done"

    assert supervise.job(flaky, audits.append, "snapshot", wait=waits.append) == "done" and waits == [2.0, 4.0] and not audits
    waits.clear()
    with pytest.raises(ZeroDivisionError):
        supervise.job(lambda: 1 / 0, audits.append, "risk", {"id": 3}, waits.append)
    with pytest.raises(KeyError):
        supervise.job(lambda: {}["x"], audits.append, "risk", wait=waits.append, permanent=(KeyError,))
    assert waits == [2.0, 4.0, 8.0, 16.0] and [(a["attempts"], a["payload"]) for a in audits] == [(5, {"id": 3}), (1, {})]


def test_alerts_are_delivered_in_order(spark):
    alerts = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "seq long, text string")
    notes, told = delivery.Recorded(), []
    assert delivery.deliver(alerts, notes, 2, lambda *x: told.append(x)) == 2
    assert notes.sent == ["a", "b"] and told == [(1, None), (2, None)]
    assert delivery.deliver(alerts, delivery.Failing(RuntimeError("down")), 5, lambda *x: told.append(x)) == 0
    assert told[2:] == [(1, "down"), (2, "down"), (3, "down")]


def test_report_from_the_command_line(spark):
    asked = cli.options(["x", "--min-n", "5", "--since", "2024-01-02", "--horizon", "1h", "--strategy-version", "v1"])
    assert (asked.min_n, asked.horizon, asked.strategy_version, asked.since.day) == (5, "1h", "v1", 2)
    for bad in (["x", "--horizon", "2h"], ["x", "--min-n", "0"], ["x", "--since", "soon"]):
        with pytest.raises(SystemExit):
            cli.options(bad)
    text = cli.main(["/root/testdata/sf0.001", "--horizon", "1h", "--min-n", "5"])
    assert "strategyVersion=v0" in text and "strategyVersion=v1" in text and " 4h " not in text


def test_offsets_are_quick():
    began = time.time()
    assert len(logs._partitions(1, 1_000_000, {"blocksperpartition": "1000"})) == 1000 and time.time() - began < 1
