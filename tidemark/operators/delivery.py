"""Delivery of alerts: which failures concern all messages, codes for the audit, and notifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a bad request says if it concerns all messages (fixed values).
EVERYWHERE = ["chat not found", "chat_id is empty", "bot was blocked by the user", "bot can't initiate conversation with a user", "user is deactivated", "bot was kicked", "have no rights to send a message", "not enough rights", "chat was upgraded"]


def transport_fault(status: Column, description: Column) -> Column:
    """Whether an answer blames the transport, not one message: 401, 403, 404, or a 400 whose description names a fault of the set-up."""
    text = F.lower(F.coalesce(description, F.lit("")))
    named = F.exists(F.array(*map(F.lit, EVERYWHERE)), lambda phrase: F.contains(text, phrase))
    return F.coalesce(status.isin(401, 403, 404) | ((status == 400) & named), F.lit(False))


def global_failure(retryable: Column, exhausted: Column, hint: Column, status: Column) -> Column:
    """Whether a failure counts toward the circuit: a passing one only once its tries are spent; else the transport's hint; else 401 and 403."""
    return F.when(retryable, exhausted).otherwise(F.coalesce(hint, status.isin(401, 403), F.lit(False)))


def failure_code(status: Column, name: Column) -> Column:
    return F.when(status.isNotNull(), F.concat(F.lit("HTTP_"), status)).otherwise(F.coalesce(name, F.lit("UNKNOWN")))


class Recorded:
    """A notifier that keeps what it was sent."""

    def __init__(self):
        self.sent: list[str] = []

    def send(self, text: str) -> None:
        self.sent.append(text)


class Failing:
    """A notifier that raises."""

    def __init__(self, error: Exception):
        self.error = error

    def send(self, text: str) -> None:
        raise self.error


def deliver(alerts: DataFrame, notifier, limit: int, on_result: Callable[[int, str | None], None]) -> int:
    """Sends the oldest ``limit`` alerts (seq, text) in order and tells of each whether it failed and why; how many were sent."""
    sent = 0
    for row in alerts.orderBy("seq").limit(limit).collect():  # at most limit rows
        try:
            notifier.send(row.text)
        except Exception as e:
            on_result(row.seq, str(e))
        else:
            sent += 1
            on_result(row.seq, None)
    return sent
