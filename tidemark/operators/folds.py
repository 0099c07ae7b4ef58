"""Folds over ordered rows by key, in one pass over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, key: str, seq: str, columns: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], told: str) -> DataFrame:
    """Each row's report in order of ``seq`` within ``key``: step(state, row) gives the next state and the report.

    A key's rows go by one after the other in one task, which holds the state of the key at hand and a batch of rows; no
    history is gathered. ``told``: the report's columns with their types, after key and seq.
    """
    types = dict(rows.dtypes)
    names = [part.split()[0] for part in told.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, None
        for frame in frames:
            out: list[list] = [[] for _ in names]
            keys = frame[key].tolist()
            for k, values in zip(keys, zip(*(frame[c].tolist() for c in columns))):
                if at is None or k != at:
                    at, kept = k, start()
                kept, report = step(kept, dict(zip(columns, values)))
                for held, name in zip(out, names):
                    held.append(report[name])
            yield pd.DataFrame({key: keys, seq: frame[seq], **dict(zip(names, out))})

    ordered = rows.filter(f"{key} IS NOT NULL").select(key, seq, *(c for c in columns if c not in (key, seq))).repartition(key).sortWithinPartitions(key, seq)
    return ordered.mapInPandas(run, f"{key} {types[key]}, {seq} {types[seq]}, {told}")
