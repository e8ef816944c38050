"""What keyed state costs: calls into the store grow with Arrow batches and slots, not with rows."""

import numpy as np
import pandas as pd

from chronopanel.streaming import stateful as sf
from chronopanel.streaming import steps


class Handle:
    """State in dictionaries that counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, name, key, value=None, ttl=None):
        return Cells(self)

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Cells:
    def __init__(self, handle):
        self.handle, self.cells = handle, {}

    def do(self, work):
        self.handle.calls += 1
        return work()

    def getValue(self, key):
        return self.do(lambda: self.cells.get(key))

    def containsKey(self, key):
        return self.do(lambda: key in self.cells)

    def updateValue(self, key, value):
        self.do(lambda: self.cells.__setitem__(key, value))

    def removeKey(self, key):
        self.do(lambda: self.cells.pop(key))

    def get(self):
        return self.getValue(())

    def exists(self):
        return self.containsKey(())

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self.do(self.cells.clear)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_a_slot_of_rows_costs_few_calls(spark):
    day, n = 86_400_000, 500
    fold = sf.OrderedFold(["user_id"], "ts", "at long, as_of long, value double", steps.CHANGE_STATE, "user_id long, as_of long, probability double", steps.change(50.0), day, 100 * day)
    handle = Handle()
    fold.init(handle)
    at = np.random.default_rng(3).permutation(n) * 1_000_000                                     # one day, any order
    value = (at // 1_000_000 % 7 * 10).astype(float)
    value[at == 5_000_000] = 3.5
    frames = [pd.DataFrame({"ts": pd.to_datetime(part, unit="us"), "at": part, "as_of": part // 1_000_000, "value": v}) for part, v in zip(np.split(at, 2), np.split(value, 2))]
    assert not sum(len(x) for x in fold.handleInputRows((7,), iter(frames), None) or [])
    assert handle.timers == {day}
    out = pd.concat(list(fold.handleExpiredTimer((7,), None, Clock(day))))
    assert handle.calls < 40
    state, want = None, []
    for k in np.argsort(at):
        state, emitted = steps.change(50.0)(state, (int(at[k]), int(at[k]) // 1_000_000, float(value[k])))
        want.append((7, *emitted))
    assert [tuple(r) for r in out.itertuples(index=False, name=None)] == want


def test_audited_blocks_cost_few_calls_and_expire(spark):
    handle, n = Handle(), 3 * sf.BLOCK
    audit = sf.DeliveryAudit("item", "digest", False, "item long, verdict string", 1_000)
    audit.init(handle)
    frame = pd.DataFrame({"item": np.arange(n), "digest": np.arange(n) * 17})
    verdicts = lambda f, now: pd.concat(list(audit.handleInputRows((0,), iter([f]), Clock(now)))).verdict.value_counts().to_dict()
    assert verdicts(frame, 0) == {sf.ACCEPTED: n}
    assert verdicts(frame.assign(digest=frame.digest + (frame.item < 10)), 999) == {sf.DUPLICATE: n - 10, sf.CONFLICT: 10}
    assert handle.calls < 30
    assert verdicts(frame, 1_001) == {sf.ACCEPTED: n}
