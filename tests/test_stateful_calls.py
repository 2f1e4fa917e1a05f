"""How often the state of a key is asked: a few times a batch, however many rows it has."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd

from oscilla.streaming import stateful


class Handle:
    """State of one key in memory, which counts what it is asked."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def _do(self, f):
        self.calls += 1
        return f()

    def getValueState(self, *_):  # noqa: N802
        put = lambda v: self._do(lambda: setattr(self, "value", v))
        return SimpleNamespace(exists=lambda: self._do(lambda: self.value is not None), get=lambda: self._do(lambda: self.value), update=put, clear=lambda: put(None))

    def getMapState(self, *_):  # noqa: N802
        m = self.map
        return SimpleNamespace(
            containsKey=lambda k: self._do(lambda: k in m), getValue=lambda k: self._do(lambda: m[k]), updateValue=lambda k, v: self._do(lambda: m.__setitem__(k, v)), removeKey=lambda k: self._do(lambda: m.pop(k)),
            iterator=lambda: self._do(lambda: iter(list(m.items()))), keys=lambda: self._do(lambda: iter(list(m))), clear=lambda: self._do(m.clear),
        )

    def listTimers(self):  # noqa: N802
        return self._do(lambda: iter(sorted(self.timers)))

    def registerTimer(self, t):  # noqa: N802
        self._do(lambda: self.timers.add(t))

    def deleteTimer(self, t):  # noqa: N802
        self._do(lambda: self.timers.discard(t))


def test_calls_do_not_grow_with_rows(monkeypatch):
    monkeypatch.setattr(stateful, "CHUNK", 1500, raising=False)
    handle, made = Handle(), stateful._Sessions("key", 1_000_000, 10_000_000)
    made.init(handle)
    at = np.arange(4000) * 10_000 + 5_000_000
    at[2000:] += 3_000_000
    now = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    for part in (at[::2], at[1::2]):
        assert list(made.handleInputRows((7,), iter([pd.DataFrame({"at": part})]), now(0))) == []
    out = []
    for ms in (30_000, 100_000):
        handle.timers = set()
        out += list(made.handleExpiredTimer((7,), now(ms), None))
    rows = [tuple(r) for f in out for r in f.itertuples(index=False)]
    assert [(r[2], r[4]) for r in rows] == [(5_000_000, 1000), (15_000_000, 1000), (28_000_000, 1000), (38_000_000, 1000)] and sum(r[4] for r in rows) == 4000
    assert not handle.map and handle.value is None and handle.calls < 40
