"""Alert cooldown in event time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = ["source_ip", "attack_type"]


def cooldown(alerts: DataFrame, window_seconds: float, delay: str = "10 minutes") -> DataFrame:
    """Per (source, attack type) pass an alert when the last passed one is old enough.

    State is one time per key, in microseconds, and is dropped once the watermark is past
    the cooldown, after which the next alert passes anyway.  Alerts of one batch are taken
    in time order; an alert that arrives out of order across batches is judged against what
    has passed before it in arrival order.  Alerts without a time all pass, and a null
    source or type is the same key as an empty one, as in the batch form.
    """
    schema = alerts.schema
    names = schema.names
    step = round(window_seconds * 1_000_000)

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["timestamp", "alert_id"], na_position="last")
        times = rows["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
        kept = []
        for place, timeless in enumerate(rows["timestamp"].isna()):
            if timeless or last is None or times[place] - last >= step:
                kept.append(place)
                last = last if timeless else int(times[place])
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + step) // 1_000, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept][names]

    keyed = alerts.withColumns({f"_{k}": F.coalesce(k, F.lit("")) for k in KEY})
    return keyed.withWatermark("timestamp", delay).groupBy(*[f"_{k}" for k in KEY]).applyInPandasWithState(
        judge, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK_ROWS = 50_000  # alerts in one entry of the state, at most


def _micros(rows: pd.DataFrame) -> np.ndarray:
    return rows["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()


class _Settling(StatefulProcessor):
    """Holds a key's alerts back until the watermark has passed them, then judges them in time order.

    Alerts go into the state and out of it as chunks, not one by one.
    """

    def __init__(self, names: list[str], step: int):
        self.names, self.step = names, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")
        self.waiting = handle.getListState("waiting", "chunk binary")

    def _chunks(self, rows: pd.DataFrame) -> list[tuple[bytes]]:
        return [(pickle.dumps(rows.iloc[i:i + CHUNK_ROWS]),) for i in range(0, len(rows), CHUNK_ROWS)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            timeless = part["timestamp"].isna()
            if timeless.any():
                yield part.loc[timeless, self.names]
            part = part.loc[~timeless, self.names]
            if len(part):
                self.waiting.appendList(self._chunks(part))
                low = int(_micros(part).min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first // 1_000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1_000
        held = [pickle.loads(bytes(r[0])) for r in self.waiting.get()] if self.waiting.exists() else []
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        times = _micros(rows)
        order = np.argsort(times, kind="stable")
        rows, times = rows.iloc[order], times[order]
        n_due = int(np.searchsorted(times, until, "right"))
        due, ids = times[:n_due], rows["alert_id"].to_numpy()
        last = self.last.get()[0] if self.last.exists() else None
        kept, at = [], 0 if last is None else int(np.searchsorted(due, last + self.step))
        while at < n_due:
            same = int(np.searchsorted(due, due[at], "right"))
            # with a cooldown the smallest id of equal times stands, without one all do
            kept += [min(range(at, same), key=lambda i: str(ids[i]))] if self.step > 0 else range(at, same)
            last = int(due[at])
            at = max(same, int(np.searchsorted(due, last + self.step)))
        if n_due < len(rows):
            if n_due:
                self.waiting.put(self._chunks(rows.iloc[n_due:]))
            self.handle.registerTimer(int(times[n_due]) // 1_000 + 1)
        else:
            self.waiting.clear()
        if kept:
            self.last.update((last,))
            yield rows.iloc[kept][self.names]

    def close(self) -> None:
        pass


def settled_cooldown(alerts: DataFrame, window_seconds: float, delay: str = "10 minutes") -> DataFrame:
    """The batch form's result on a stream, whatever batches the alerts come in.

    An alert waits in the state of its key until the watermark, ``delay`` behind the newest
    alert, has passed it; an event-time timer then judges what is due in time order.  So
    alerts out of order by less than ``delay`` are judged where they belong, and a result
    comes ``delay`` late; later ones are dropped by the watermark.  Alerts without a time
    all pass at once; of alerts with equal times the smallest ``alert_id`` stands.  State
    is one time a key and the alerts of the last ``delay``.
    """
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = alerts.withColumns({f"_{k}": F.coalesce(k, F.lit("")) for k in KEY})
    return keyed.withWatermark("timestamp", delay).groupBy(*[f"_{k}" for k in KEY]).transformWithStateInPandas(
        _Settling(alerts.columns, round(window_seconds * 1_000_000)), alerts.schema, "append", "eventTime")
