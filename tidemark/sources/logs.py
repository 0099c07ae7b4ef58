"""Chain logs by block: a provider, a fetch that adapts to its limits, and a source with block offsets.

``spark.readStream.format("blocklogs")`` plans the blocks of a micro-batch up to the confirmed head and deals them out in
chunks; each task fetches its chunk. Registered by ``register``. A provider is a class by its import path (option
``provider``) that takes the options and has head() and logs(start, end); ``Stored`` replays files.

Errors of a provider are told apart by their text, in this order: blocks that it no longer holds (they come out as one row that
says so, as a gap to record), too wide a range (halved, down to one block), too many requests (waited out, doubling), and
others, which fail the task so that Spark tries it again.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.text import ERRORS

#: gap_to is the last block of a range that the provider no longer holds (block_number is its first); null for logs.
SCHEMA = "address string, topics array<string>, data string, block_number long, tx_hash string, log_index int, gap_to long"
WAIT, ATTEMPTS = 0.25, 4


class HistoryUnavailable(Exception):
    """Blocks that the provider no longer holds."""


class Transient(Exception):
    """Worth another try."""


def kind(message: str) -> str:
    """history, range, rate or transient."""
    return next((name for name, pattern in ERRORS.items() if re.search(pattern, message, re.IGNORECASE)), "transient")


@dataclass
class ChunkSize:
    """Blocks asked for at once: halved on rejection, never raised again."""

    value: int
    least: int = 1

    def __post_init__(self):
        self.value = max(self.value, self.least)

    def shrink(self) -> bool:
        """Whether there was room to."""
        before, self.value = self.value, max(self.least, self.value // 2)
        return self.value < before


def fetch_chunks(logs: Callable[[int, int], list], start: int, end: int, size: ChunkSize, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, int, list]]:
    """(first, last, logs) of consecutive chunks from ``start`` to ``end``, both included; each is yielded before the next is asked for."""
    tried = 0
    while start <= end:
        last = min(start + size.value - 1, end)
        try:
            found = logs(start, last)
        except Exception as e:
            what = kind(str(e))
            if what == "history":
                raise HistoryUnavailable(f"blocks {start} to {last}: {e}") from e
            if what == "range" and size.shrink():
                continue
            if what == "rate" and tried < attempts:
                tried += 1
                wait(WAIT * 2**tried)
                continue
            raise Transient(f"blocks {start} to {last}: {e}") from e
        tried = 0
        yield start, last, found
        start = last + 1


class Stored:
    """Logs in JSON lines (option ``path``: a folder of any file system that pyarrow opens); the head is the last block of all."""

    def __init__(self, options: dict):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])

    def _rows(self) -> Iterator[dict]:
        from pyarrow import fs

        for info in sorted(self.store.get_file_info(fs.FileSelector(self.folder)), key=lambda i: i.path):
            if info.path.endswith(".jsonl"):
                with self.store.open_input_stream(info.path) as file:
                    yield from map(json.loads, file.read().decode().splitlines())

    def head(self) -> int:
        return max((r["block_number"] for r in self._rows()), default=0)

    def logs(self, start: int, end: int) -> list[dict]:
        return [r for r in self._rows() if start <= r["block_number"] <= end]


def provider(options: dict):
    where, _, name = options.get("provider", f"{__name__}.Stored").rpartition(".")
    return getattr(importlib.import_module(where), name)(options)


@dataclass
class Blocks(InputPartition):
    first: int
    last: int


def _partitions(start: int, end: int, options: dict) -> list[Blocks]:
    step = max(int(options.get("blocksperpartition", 1000)), 1)
    return [Blocks(first, min(first + step - 1, end)) for first in range(start, end + 1, step)]


def _read(part: Blocks, options: dict) -> Iterator[tuple]:
    source, size = provider(options), ChunkSize(int(options.get("maxchunk", 100)), int(options.get("minchunk", 1)))
    first = part.first
    try:
        for _, last, found in fetch_chunks(source.logs, part.first, part.last, size):
            for r in found:
                yield r["address"], r["topics"], r["data"], r["block_number"], r["tx_hash"], r["log_index"], None
            first = last + 1
    except HistoryUnavailable:
        yield None, None, None, first, None, None, part.last


class _Stream(DataSourceStreamReader):
    """Offsets are the last block read. A new stream starts ``backfill`` blocks before the confirmed head."""

    def __init__(self, options: dict):
        self.options = options

    def _safe(self) -> int:
        return max(provider(self.options).head() - int(self.options.get("confirmations", 0)), 0)

    def initialOffset(self) -> dict:
        at = int(self.options["startblock"]) if "startblock" in self.options else max(self._safe() - int(self.options.get("backfill", 0)), 0)
        return {"block": at - 1}

    def latestOffset(self) -> dict:
        return {"block": self._safe()}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return _partitions(start["block"] + 1, end["block"], self.options)

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return _read(partition, self.options)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Blocks]:
        return _partitions(int(self.options.get("startblock", 0)), int(self.options["endblock"]) if "endblock" in self.options else provider(self.options).head(), self.options)

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return _read(partition, self.options)


class BlockLogs(DataSource):
    """Options: provider, path, startBlock, endBlock (batch), confirmations, backfill, blocksPerPartition, maxChunk, minChunk."""

    @classmethod
    def name(cls) -> str:
        return "blocklogs"

    def schema(self) -> str:
        return SCHEMA

    def _lower(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._lower())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._lower())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockLogs)
