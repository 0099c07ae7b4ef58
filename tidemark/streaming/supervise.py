"""Keeping tails alive: queries started again after failures, an alarm after several in a row, jobs tried again with an audit."""

from __future__ import annotations

import time
from collections.abc import Callable

ALARM = 5  # failures in a row
ATTEMPTS, FIRST = 5, 2.0  # of a job, and seconds before the second


def tail(start: Callable[[], object], alarm: Callable[[int, str], None], stop: Callable[[], bool], wait: Callable[[float], None] = time.sleep, pause: float = 5.0) -> int:
    """Runs a streaming query over and over until ``stop`` says so; how often it failed.

    ``start`` starts the query from its checkpoint, so none overlaps the one before. A run without an error ends a row of
    failures; the fifth in a row, and every fifth more, raises the alarm with the last error.
    """
    failed = row = 0
    while not stop():
        try:
            start().awaitTermination()
            row = 0
        except Exception as e:
            failed, row = failed + 1, row + 1
            if row % ALARM == 0:
                alarm(row, str(e))
        if not stop():
            wait(pause)
    return failed


def job(run: Callable[[], object], audit: Callable[[dict], None], name: str, payload: dict | None = None, wait: Callable[[float], None] = time.sleep, permanent: tuple[type[Exception], ...] = ()) -> object:
    """The job's result; after a failure another try, each after twice the time. The last failure, or a permanent one, is audited and raised."""
    for n in range(1, ATTEMPTS + 1):
        try:
            return run()
        except Exception as e:
            if n == ATTEMPTS or isinstance(e, permanent):
                audit({"job": name, "attempts": n, "error": str(e), "payload": payload or {}})
                raise
            wait(FIRST * 2 ** (n - 1))
