"""State of the settled cooldown: chunks of alerts, judged as one by one."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from packetloom.streaming.cooldown import _Settling


class State:
    """One key's state and timers, as a handle and its variables."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], []

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        held = State()
        held.exists, held.get = lambda: bool(held.rows), lambda: iter(held.rows)
        self.held = held
        return held

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("step", [0, 7_000_000])
def test_alerts_wait_in_chunks(step):
    rng = random.Random(3)
    rows = [(f"a{i}", 1_000_000 * rng.randrange(4000)) for i in range(10_000)]
    state = State()
    processor = _Settling(["alert_id", "timestamp"], step)
    processor.init(state)
    frames = [pd.DataFrame({"alert_id": [i for i, _ in part], "timestamp": pd.to_datetime([t for _, t in part], unit="us")}) for part in (rows[:6000], rows[6000:])]
    frames.append(pd.DataFrame({"alert_id": ["none"], "timestamp": pd.to_datetime([None])}))
    out = [pd.concat(processor.handleInputRows(("k",), iter(frames), None))]
    assert list(out[0].alert_id) == ["none"]
    assert len(state.held.rows) <= 2  # two parts, not ten thousand rows
    for ms in (1_500_000, 1_500_000, 5_000_000):
        out += processor.handleExpiredTimer(("k",), Watermark(ms), None)
        assert bool(state.held.rows) == (ms < 4_000_000)
    want, last = [], None
    for t, i in sorted((t, i) for i, t in rows):
        if last is None or t - last >= step:
            want.append(i)
            last = t
    assert sorted(pd.concat(out[1:]).alert_id) == sorted(want)
