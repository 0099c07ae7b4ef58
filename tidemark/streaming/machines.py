"""The state machines over streams: the folds of ``tidemark.operators.states`` with kept state.

Rows of a key are folded in order of seq within a micro-batch; across batches the source's order counts.
State lives in the state store, so a restarted query goes on where its checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.states import CIRCUIT_OUT, SIGNAL_OUT, Circuit, Policy, Signal, as_tuple, attempt, step


def signal_states(evaluations: DataFrame, policy: Policy = Policy()) -> DataFrame:
    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, out = Signal(*state.get) if state.exists else Signal(), []
        for row in pd.concat(frames).sort_values("seq").to_dict("records"):
            kept, told = step(kept, row, policy)
            out.append({"token_id": key[0], "seq": row["seq"], **told})
        state.update(as_tuple(kept))
        yield pd.DataFrame(out)

    return evaluations.groupBy("token_id").applyInPandasWithState(fold, SIGNAL_OUT, "state string, level int, score double, at double", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(attempts: DataFrame) -> DataFrame:
    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, out = Circuit(*state.get) if state.exists else Circuit(), []
        for row in pd.concat(frames).sort_values("seq").to_dict("records"):
            kept, told = attempt(kept, row["minute"], row["ok"], row["everywhere"])
            out.append({"notifier": key[0], "seq": row["seq"], **told})
        state.update(as_tuple(kept))
        yield pd.DataFrame(out)

    return attempts.groupBy("notifier").applyInPandasWithState(fold, CIRCUIT_OUT, "state string, failures int, reopen double, opened double", "append", GroupStateTimeout.NoTimeout)
