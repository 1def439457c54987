"""Keyed rules as stateful processors for `transformWithStateInPandas`: state by name, timers on the watermark that also end its life, a state to begin with.

They need the RocksDB state store (`runs.run_append(..., rocks=True)` sets it for the query)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def _timed(rows: DataFrame, ms: Column, late: str) -> DataFrame:
    """The rows with a watermark on their time, a millisecond on: what lies on the epoch would be late from the start."""
    return rows.withColumn("at", F.timestamp_millis(ms + 1)).withWatermark("at", late)


class Tickets(StatefulProcessor):
    """A dataset's tickets.  Events wait until the watermark has passed them, and then count in their order; so a replay gives the same, however it is cut.

    State: what waits, the pending tickets (`most` at most), and the ended ones for `keep_s` seconds, so that none is minted twice."""

    def __init__(self, ttl_s: int, most: int, keep_s: int):
        self.ttl_s, self.most, self.keep_s = ttl_s, most, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_s long, action string, ticket long")
        self.pending = handle.getMapState("pending", "ticket long", "minted_s long")
        self.ended = handle.getMapState("ended", "ticket long", "ended_s long")

    def _wake(self, pending: dict[int, int], ended: dict[int, int], waiting: list[tuple], watermark_ms: int) -> None:
        """One timer, for what comes first: an event that waits, an expiry, a tombstone to drop."""
        times = [w[0] for w in waiting] + [m + self.ttl_s for m in pending.values()] + [e + self.keep_s for e in ended.values()]
        if times:
            self.handle.registerTimer(max(1000 * min(times), watermark_ms) + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        for ticket, minted in initialState[["ticket", "minted_s"]].itertuples(index=False):
            self.pending.updateValue((int(ticket),), (int(minted),))
            self.handle.registerTimer(max(1000 * (int(minted) + self.ttl_s), timerValues.getCurrentWatermarkInMs()) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), action, int(ticket)) for frame in rows for at, action, ticket in frame[["at_s", "action", "ticket"]].dropna().itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self._wake({}, {}, new, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((w for w in waiting if 1000 * w[0] < now_ms), key=lambda w: (w[0], w[1] != "mint", w[1], w[2]))
        rest = [w for w in waiting if 1000 * w[0] >= now_ms]
        pending = {k[0]: v[0] for k, v in self.pending.iterator()}
        ended = {k[0]: v[0] for k, v in self.ended.iterator()}
        before, gone = dict(pending), dict(ended)
        out = []

        def end(ticket: int, minted: int, state: str, at: int) -> None:
            ended[ticket] = at
            out.append((key[0], ticket, minted, state))

        def expire(at: float) -> None:
            for ticket in [t for t, m in pending.items() if m + self.ttl_s <= at]:
                minted = pending.pop(ticket)
                end(ticket, minted, "expired", minted + self.ttl_s)

        for at, action, ticket in due:
            expire(at)
            if action == "mint":
                if ticket in pending or ticket in ended:
                    continue  # the first one counts
                if len(pending) < self.most:
                    pending[ticket] = at
                else:
                    end(ticket, at, "refused", at)
            elif ticket in pending:  # of others nothing is kept: never minted, or ended
                end(ticket, pending.pop(ticket), "redeemed" if action == "redeem" else "cancelled", at)
        expire(now_ms / 1000)
        ended = {t: e for t, e in ended.items() if 1000 * (e + self.keep_s) >= now_ms}
        self._store(self.pending, before, pending)
        self._store(self.ended, gone, ended)
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        self._wake(pending, ended, rest, now_ms)
        yield pd.DataFrame(out, columns=["dataset", "ticket", "minted_s", "state"])

    @staticmethod
    def _store(state, old: dict[int, int], new: dict[int, int]) -> None:
        for ticket in old.keys() - new.keys():
            state.removeKey((ticket,))
        for ticket, value in new.items():
            if old.get(ticket) != value:
                state.updateValue((ticket,), (value,))

    def close(self) -> None:
        pass


def live_tickets(events: DataFrame, ttl_s: int = 30, most: int = 8, keep_s: int = 300, late: str = "0 seconds", pending: DataFrame | None = None) -> DataFrame:
    """(dataset, ticket, minted_s, state) of each ticket minted, once it has ended: redeemed, cancelled, expired, or refused as its dataset had `most` pending.

    events: dataset, ticket, action (mint, redeem, cancel), at_s.  An event counts when the watermark, `late` behind the newest event, has passed it.
    pending (dataset, ticket, minted_s): tickets that an earlier run has left."""
    timed = _timed(events.select("dataset", "ticket", "action", "at_s"), F.col("at_s") * 1000, late)
    kinds = "dataset long, ticket long, minted_s long, state string"
    begin = None if pending is None else pending.select("dataset", "ticket", "minted_s").groupBy("dataset")
    return timed.groupBy("dataset").transformWithStateInPandas(Tickets(ttl_s, most, keep_s), kinds, "Append", "EventTime", begin)


class Throttle(StatefulProcessor):
    """When a user's last accepted request was; forgotten once the watermark is so far past it that any later one is accepted anyway."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(int(last) + self.gap)
        frame = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        taken = []
        for ms in frame["ms"].tolist():
            ok = last is None or ms - last >= self.gap
            last = ms if ok else last
            taken.append(ok)
        self.last.update((int(last),))
        self.handle.registerTimer(int(last) + self.gap)
        yield frame[["user_id", "event_id"]].assign(accepted=taken)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttle(requests: DataFrame, gap: int = 120, late: str = "0 seconds") -> DataFrame:
    """requests (user_id, event_id, ms): whether each is accepted, `gap` ms or more after the last accepted one. Those more than `late` behind the newest are dropped."""
    timed = _timed(requests.select("user_id", "event_id", "ms"), F.col("ms"), late)
    return timed.groupBy("user_id").transformWithStateInPandas(Throttle(gap), "user_id long, event_id long, accepted boolean", "Append", "EventTime")


class Supersede(StatefulProcessor):
    """The newest generation that a dataset has shown; forgotten when the watermark is the time to live past the dataset's last batch."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "generation long, wake_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest, wake = self.newest.get() if self.newest.exists() else (None, None)
        frame = pd.concat(list(rows)).sort_values("event_id")
        top = frame["generation"].cummax()
        if newest is not None:
            self.handle.deleteTimer(int(wake))
            if timerValues.getCurrentWatermarkInMs() < wake:  # else its time is up, and the timer would only have come after these rows
                top = top.clip(lower=newest)
        wake = max(int(frame["ms"].max()) + self.ttl_ms, wake or 0)
        self.newest.update((int(top.iloc[-1]), wake))
        self.handle.registerTimer(wake)
        yield frame.loc[frame["generation"] == top, ["dataset", "event_id", "generation"]]

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def supersede(batches: DataFrame, ttl_ms: int = 7 * 24 * 3600 * 1000, late: str = "0 seconds") -> DataFrame:
    """batches (dataset, event_id, generation, ms): those whose generation is the newest that their dataset has shown so far. Those more than `late` behind are dropped."""
    timed = _timed(batches.select("dataset", "event_id", "generation", "ms"), F.col("ms"), late)
    return timed.groupBy("dataset").transformWithStateInPandas(Supersede(ttl_ms), "dataset string, event_id long, generation long", "Append", "EventTime")
