"""Sequential state machines by key: signal states with alert de-duplication, and circuit breakers.

Each is one pure fold, used on ordered rows in batch (``folds.folded``) and with kept state in a stream
(``tidemark.streaming.machines``). Thresholds and reasons are fixed values.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame

from .folds import folded

STRENGTH = ["NEW", "WATCHING", "INTERESTING", "STRONG_SIGNAL"]
LEVELS = {"INTERESTING": ("INTERESTING", 1), "STRONG_SIGNAL": ("STRONG", 2)}


@dataclass
class Policy:
    interesting: float = 60.0
    strong: float = 75.0
    max_age: float = 360.0
    inactive: float = 30.0
    collapse: float = 0.2
    downgrade: bool = False
    rescore: float = 10.0
    cooldown: float = 60.0


@dataclass
class Signal:
    """What is kept of a token: its state, and the last alert's level, score and time (minutes)."""

    state: str = "NEW"
    level: int = 0
    score: float = 0.0
    at: float = 0.0


def _known(x) -> bool:
    return x is not None and x == x


def step(kept: Signal, row: dict, policy: Policy) -> tuple[Signal, dict]:
    """The next state for one evaluation, and the row to report."""
    before = kept.state
    state, reason = before, "no_change"
    goal = "STRONG_SIGNAL" if row["alpha"] >= policy.strong and row["sufficient"] else "INTERESTING" if row["alpha"] >= policy.interesting else "WATCHING"
    drained = _known(row["liquidity"]) and _known(row["peak"]) and 0 < row["peak"] and row["liquidity"] < row["peak"] * policy.collapse
    if before == "EXPIRED":
        reason = "already_expired"
    elif row["risk"] == "FAIL":
        state, reason = "EXPIRED", "risk_fail"
    elif row["age"] > policy.max_age:
        state, reason = "EXPIRED", "age_limit"
    elif _known(row["idle"]) and row["idle"] > policy.inactive:
        state, reason = "EXPIRED", "inactivity"
    elif drained:
        state, reason = "EXPIRED", "liquidity_collapse"
    elif before == "NEW":
        state, reason = "WATCHING", "risk_cleared"
    else:
        up = STRENGTH.index(goal) - STRENGTH.index(before)
        if up > 0:
            state, reason = goal, f"alpha_{goal.lower()}"
        elif up < 0 and policy.downgrade:
            state, reason = goal, "downgrade_policy"
    name, level = LEVELS.get(state, ("NONE", 0))
    if not level:
        alert = "no_alert_level"
    elif not kept.level:
        alert = "first_alert"
    elif level > kept.level:
        alert = "level_upgraded"
    elif abs(row["alpha"] - kept.score) >= policy.rescore:
        alert = "score_moved"
    elif row["minute"] - kept.at >= policy.cooldown:
        alert = "cooldown_elapsed"
    else:
        alert = "suppressed_duplicate"
    sent = alert not in ("no_alert_level", "suppressed_duplicate")
    after = Signal(state, level, row["alpha"], row["minute"]) if sent else Signal(state, kept.level, kept.score, kept.at)
    return after, {"state": state, "changed": state != before, "reason": reason, "level": name, "sent": sent, "alert": alert}


SIGNAL_TOLD = "state string, changed boolean, reason string, level string, sent boolean, alert string"
SIGNAL_OUT = f"token_id long, seq long, {SIGNAL_TOLD}"


def signal_states(evaluations: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Folds the evaluations of each token in order of seq.

    evaluations: token_id, seq, minute, alpha, sufficient, risk, age, idle, liquidity, peak.
    """
    columns = ["minute", "alpha", "sufficient", "risk", "age", "idle", "liquidity", "peak"]
    return folded(evaluations, "token_id", "seq", columns, Signal, lambda kept, row: step(kept, row, policy), SIGNAL_TOLD)


@dataclass
class Circuit:
    state: str = "CLOSED"
    failures: int = 0
    reopen: float = -1.0
    opened: float = -1.0  # when it opened first; kept while probes fail


def attempt(kept: Circuit, minute: float, ok: bool, everywhere: bool, threshold: int = 3, minutes: float = 5.0) -> tuple[Circuit, dict]:
    """One delivery: held back while the circuit is open, a probe once its time is over.

    A success closes it; only failures that concern all messages count toward opening it.
    """
    probe = kept.state != "CLOSED" and minute >= kept.reopen
    if kept.state != "CLOSED" and not probe:
        return kept, {"allowed": False, "probe": False, "state": kept.state, "failures": kept.failures, "edge": "held", "opened": kept.opened if kept.opened >= 0 else None}
    if ok:
        after, edge = Circuit(), "closed" if kept.state != "CLOSED" else "none"
    elif not everywhere:
        after, edge = kept, "none"
    else:
        n = kept.failures + 1
        opened = kept.state != "CLOSED" or n >= threshold
        after = Circuit("OPEN", n, minute + minutes, kept.opened if kept.state != "CLOSED" else minute) if opened else Circuit("CLOSED", n)
        edge = "opened" if opened and kept.state == "CLOSED" else "none"
    return after, {"allowed": True, "probe": probe, "state": after.state, "failures": after.failures, "edge": edge, "opened": after.opened if after.opened >= 0 else None}


CIRCUIT_TOLD = "allowed boolean, probe boolean, state string, failures long, edge string, opened double"
CIRCUIT_OUT = f"notifier long, seq long, {CIRCUIT_TOLD}"


def circuit_breaker(attempts: DataFrame) -> DataFrame:
    """Folds the attempts (notifier, seq, minute, ok, everywhere) of each notifier in order."""
    return folded(attempts, "notifier", "seq", ["minute", "ok", "everywhere"], Circuit, lambda kept, row: attempt(kept, row["minute"], row["ok"], row["everywhere"]), CIRCUIT_TOLD)


def as_tuple(kept) -> tuple:
    return tuple(asdict(kept)[f.name] for f in fields(kept))
