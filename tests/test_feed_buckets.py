"""A bucket of feeds is read and written once a micro-batch and has one timer."""

import pandas as pd

from oddsloom.streaming.feeds import FeedWatch

MS = 10**6


class Bucket:
    def __init__(self):
        self.value, self.calls, self.timers = None, [], set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def told(frames):
    return sorted((r.feed, r.change, r.state) for f in frames for r in f.itertuples(index=False))


def test_feeds_of_a_bucket_share_state_and_timer():
    store, watch = Bucket(), FeedWatch(stale_ns=100 * MS, future_ns=5 * MS)
    watch.init(store)
    names = [f"f{i:03d}" for i in range(200)]
    rows = [(f, "required", 0) for f in names] + [(f, "event", (1_000 + i) * MS) for i, f in enumerate(names) if i % 2] + [("f001", "event", 7), (None, "event", 9)]
    first = told(watch.handleInputRows((3,), iter([pd.DataFrame(rows, columns=["feed", "kind", "ts_ns"])]), Now(1_050)))
    assert sorted(store.calls) == ["get", "register", "update"]
    assert len(first) == 200 and {s for f, _, s in first if int(f[1:]) % 2 == 0} == {"silent"}
    assert [s for f, _, s in first if f in ("f001", "f055", "f057", "f199")] == ["ok", "ok", "future", "future"]
    # The first that is no longer ahead; then those that are, each told once; the clock moves on to the first that grows stale.
    assert store.timers == {1_053}
    store.timers.clear()
    second = told(watch.handleExpiredTimer((3,), Now(1_101), None))
    assert second[0] == ("f057", 2, "ok") and len(second) == 25 and store.timers == {1_102}
    store.timers.clear()
    last = told(watch.handleExpiredTimer((3,), Now(5_000), None))
    assert len(last) == 100 and {s for _, _, s in last} == {"stale"} and store.timers == set()
