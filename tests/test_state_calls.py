"""How often the processors of streams ask the state: per key and batch, not per event."""

import numpy as np
import pandas as pd

from colmerge.streaming.live import ReactiveRow, TimelyDebounce, TimelyOutcome


class Held:
    """A value or a list of state that counts the calls."""

    def __init__(self, calls):
        self.calls, self.it = calls, None

    def get(self):
        self.calls.append("get")
        return iter(list(self.it or [])) if isinstance(self.it, list | None) and self.many else self.it

    def update(self, value):
        self.calls.append("update")
        self.it = value

    put = update

    def appendList(self, more):
        self.calls.append("append")
        self.it = [*(self.it or []), *more]

    def exists(self):
        self.calls.append("exists")
        return self.it is not None

    def clear(self):
        self.calls.append("clear")
        self.it = None


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def _made(self, many):
        held = Held(self.calls)
        held.many = many
        return held

    def getValueState(self, name, schema):
        return self._made(False)

    def getListState(self, name, schema):
        return self._made(True)

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def fed(processor, key, n, kinds):
    handle = Handle()
    processor.init(handle)
    rng = np.random.default_rng(1)
    for k in range(2):  # the same events again in part: they count once
        part = pd.DataFrame({"at_ms": np.arange(n) * 10, "position": np.arange(n), "kind": kinds})[k * (n // 2) :]
        order = rng.permutation(len(part))
        assert [*processor.handleInputRows(key, iter([part.iloc[order]]), Now(0))] == []
    out = pd.concat([*processor.handleExpiredTimer(key, Now(10**9), None)])
    return handle, out


def test_events_wait_in_blocks():
    handle, out = fed(TimelyDebounce(1000), ("x",), 5000, 0)
    assert len(handle.calls) < 15
    assert out["topic"].unique().tolist() == ["x"] and out["edge"].tolist()[0] == "leading" and out["position"].tolist()[:3] == [0, 99, 199]
    handle, out = fed(TimelyOutcome(10**6, 10**6), (7,), 5000, np.arange(5000) % 2)
    assert len(handle.calls) < 15 and out.values.tolist() == [[7, "Synced", 2500]]


def test_a_row_of_a_view_is_read_and_written_once():
    processor, handle = ReactiveRow(), Handle()
    processor.init(handle)
    processor.handleInitialState(("t", "r"), pd.DataFrame({"cid": ["a", "b"], "val": ["1", None], "position": [1, 2]}), None)
    part = pd.DataFrame({"cid": [f"c{k}" for k in range(200)], "val": [None] + ["v"] * 199, "position": range(5, 205)})
    out = pd.concat([*processor.handleInputRows(("t", "r"), iter([part]), None)])
    assert len(out) == 202 and len(handle.calls) < 8 and out[out.cid == "b"].val.tolist() == [None]
