"""Per-session state in event-time order: list state for rows that are not final yet, timers on the watermark, and expiry."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timers and list state need this state store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _OrderedSignal(StatefulProcessor):
    """Holds a session's rows until the watermark passes them, then folds them in time order into (first, last, count, level)."""

    def __init__(self, key: str, row_id: str, alpha: float, idle_us: int):
        self.key, self.row_id, self.alpha, self.idle_us = key, row_id, alpha, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, id long, value double")
        self.past = handle.getValueState("past", "first long, last long, n long, level double")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, us: int) -> None:
        """One timer a session: at the earliest moment at which there is something to do."""
        at, now = -(-us // 1000), self.timer.get()
        if now is not None and now[0] <= at:
            return
        if now is not None:
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest, final = None, timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            # The engine's own filter of late rows may be a batch behind the watermark that has made rows final.
            frame = frame[frame.iloc[:, 2] > final] if final > 0 else frame
            if frame.empty:
                continue
            _, _, us, ids, values = (frame.iloc[:, i] for i in range(5))  # by place: names with an underscore are replaced on the way
            values = values.astype(object).where(values.notna(), None)
            self.pending.appendList(list(zip(us.tolist(), ids.tolist(), values.tolist())))
            low = int(us.min())
            earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        final = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.pending.get()), columns=["us", "id", "value"])
        due, rest = held[held["us"] <= final], held[held["us"] > final]
        if len(due):
            if len(rest):
                value = rest["value"].astype(object).where(rest["value"].notna(), None)
                self.pending.put(list(zip(rest["us"].tolist(), rest["id"].tolist(), value.tolist())))
            else:
                self.pending.clear()
            yield self._folded(key[0], due.sort_values(["us", "id"]))
        past = self.past.get()
        if past is not None and past[1] + self.idle_us <= final:
            self.past.clear()  # a later row is at least this far away, so it starts a new run
            past = None
        if len(rest):
            self._wake(int(rest["us"].min()))
        elif past is not None:
            self._wake(past[1] + self.idle_us)

    def _smoothed(self, level: float, x: float) -> float:
        if x != x or level != level:
            return level if x != x else x
        return self.alpha * x + (1.0 - self.alpha) * level

    def _folded(self, key, due: pd.DataFrame) -> pd.DataFrame:
        us, values = due["us"].to_numpy(np.int64), due["value"].astype(float).to_numpy()
        past = self.past.get()
        new = np.append(past is None or us[0] - past[1] >= self.idle_us, np.diff(us) >= self.idle_us)
        starts = np.unique(np.append(0, np.flatnonzero(new)))
        index, first, level = np.zeros(len(us), np.int64), np.zeros(len(us), np.int64), np.zeros(len(us))
        for lo, hi in zip(starts, np.append(starts[1:], len(us))):
            begun = (int(us[lo]), None, 0, None) if new[lo] else past
            index[lo:hi] = np.arange(begun[2], begun[2] + hi - lo)
            first[lo:hi] = begun[0]
            level[lo:hi] = list(accumulate(values[lo:hi].tolist(), self._smoothed, initial=np.nan if begun[3] is None else begun[3]))[1:]
        self.past.update((int(first[-1]), int(us[-1]), int(index[-1]) + 1, None if np.isnan(level[-1]) else float(level[-1])))
        shown = pd.Series(level).astype(object).where(~np.isnan(level), None)
        return pd.DataFrame({
            self.key: [key] * len(us), self.row_id: due["id"].to_numpy(), "sample_index": index, "offset_s": (us - first) / 1e6, "level": shown.to_numpy()})

    def close(self) -> None:
        pass


def ordered_signal(stream: DataFrame, key: str, ts: str, row_id: str, value: str, alpha: float, delay: str, idle_seconds: float) -> DataFrame:
    """Index, seconds since the first row and exponentially smoothed value of each row in event-time order, per run of a session.

    A row is final, and returned, once the watermark (newest time less ``delay``) has reached its time; until then a row that
    arrives late takes its place in time and moves the later ones. Rows at or behind the watermark are dropped. A silence of
    ``idle_seconds`` or more ends a run: the next row has index 0 and its own level. State of a run goes when the watermark
    has passed that silence, so only live sessions are held: one small row each, and the rows of the last ``delay``.

    Equal times go by ``row_id`` (an integer). A NULL value keeps the level (NULL before the first value); rows without a
    time belong to no place in a run and are left out, as are rows before 1970 (the engine's watermark starts there); a NULL key is a session. Needs ``STATE_STORE`` when the query starts. A
    session's rows of one micro-batch come to one task, so bound the batches of a long backlog at the source.
    """
    types = dict(stream.dtypes)
    rows = stream.where(F.unix_micros(ts) > 0).select(
        F.col(key), F.col(ts).alias("__ts"), F.unix_micros(ts).alias("__us"), F.col(row_id).cast("long").alias("__id"), F.col(value).cast("double").alias("__value"))
    return rows.withWatermark("__ts", delay).groupBy(key).transformWithStateInPandas(
        _OrderedSignal(key, row_id, alpha, int(idle_seconds * 1e6)), f"`{key}` {types[key]}, `{row_id}` long, sample_index long, offset_s double, level double", "append", "EventTime")
