"""Keyed stateful rules for `applyInPandasWithState`. Rows of a key come in one micro-batch in any order, and are put in event order first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _wake(state: GroupState, at_ms: int) -> None:
    """Ask to be called once the watermark has passed a time."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def stalls(events: DataFrame, bound_ms: int = 5000) -> DataFrame:
    """events (user_id, event_id, kind, ms) with kind begin, end or tick: a row for each begin that no end follows within the bound; re-armed by the next begin.

    A stall is told by the user's next event, or by the watermark if none comes."""

    def rule(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], int(begun)))
            begun = None
        else:
            for kind, ms in pd.concat(list(frames)).sort_values(["ms", "event_id"])[["kind", "ms"]].itertuples(index=False):
                if begun is not None and ms - begun > bound_ms:
                    out.append((key[0], int(begun)))
                    begun = None
                if kind == "begin":
                    begun = ms
                elif kind == "end":
                    begun = None
        if begun is not None:
            state.update((int(begun),))
            _wake(state, int(begun) + bound_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "begun_ms"])

    timed = events.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "0 seconds")
    return timed.groupBy("user_id").applyInPandasWithState(rule, "user_id long, begun_ms long", "begun long", "append", GroupStateTimeout.EventTimeTimeout)
