"""The search quota as a stream: one state for each user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meritlake.operators.tiering import CYCLE_DAYS, SEARCHES

OUT = "user_id long, cycle_start timestamp, used long, allowed long, blocked long"
STATE = "start timestamp, used long, allowed long, blocked long"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A user's state after a batch of searches in order of (at, seq)."""
    start, used, allowed, blocked = state.get if state.exists else (None, 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["at", "seq"])
    for at in rows["at"]:
        if start is None or at >= pd.Timestamp(start) + pd.Timedelta(days=CYCLE_DAYS):
            start, used = at, 0
        if used < SEARCHES:
            used, allowed = used + 1, allowed + 1
        else:
            blocked += 1
    state.update((pd.Timestamp(start).to_pydatetime(), used, allowed, blocked))
    yield pd.DataFrame({"user_id": [key[0]], "cycle_start": [start], "used": [used], "allowed": [allowed], "blocked": [blocked]})


def quota_stream(searches: DataFrame) -> DataFrame:
    """OUT: a row for each user and batch, the user's state after it, from a stream of (user_id, at, seq)."""
    return searches.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
