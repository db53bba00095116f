"""Few calls of the state store: the gate's ids lie in buckets, equal to one pass however rows are cut; open decisions share a timer."""

import pandas as pd
import pytest

from oddsloom.streaming import gate
from oddsloom.streaming.venue import VenueState
from tests.test_gate_pieces import SCHEMA, events, in_order
from tests.test_ladder import Store
from tests.test_venue_state import MS, SCHEMA as VENUE_SCHEMA, Clock, Handle

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def run(rows, step, **how):
    store, made, out = Store(), gate.QualityGate(max_delay_ns=5, **how), {}
    made.init(store)
    calls = []
    for name in ("containsKey", "getValue", "updateValue"):
        plain = getattr(store.states["seen"], name)
        setattr(store.states["seen"], name, lambda *a, plain=plain: calls.append(a) or plain(*a))
    for a in range(0, len(rows), step):
        frame = pd.DataFrame(rows[a : a + step], columns=COLUMNS)
        for found in made.handleInputRows((1,), iter([frame]), Clock(0)):
            out |= {(r.user_id, r.pos): (r.status, r.epoch_id, r.stale) for r in found.itertuples(index=False)}
    return out, calls


@pytest.mark.parametrize("step", [1, 17, 1_000])
@pytest.mark.parametrize("max_seen", [None, 6])
@pytest.mark.parametrize("size", [1, 256])
def test_buckets_equal_one_pass(monkeypatch, step, max_seen, size):
    monkeypatch.setattr(gate, "BUCKET_IDS", size)
    rows = [r for r in events(21, n=700, idents=60, back=1, gaps=0.01) if r[0] == 1]
    assert run(rows, step, max_seen=max_seen)[0] == in_order(rows, max_seen)


def test_a_batch_of_new_ids_is_one_write():
    rows = [(1, i, f"h{i}", i, i, i, False) for i in range(200)]
    out, calls = run(rows, 200)
    assert len(calls) == 1 and {v[0] for v in out.values()} == {"accepted"}


def test_open_decisions_share_one_timer():
    handle, state = Handle(), VenueState("key", {"a": 50 * MS}, 300 * MS, slot_ns=20 * MS)
    state.init(handle)
    rows = [(0, i, (i + 1) * MS, None, "decision", 0.0, 0.0, 0.0, *[0.0] * 4, 0, 0) for i in range(30)]
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in VENUE_SCHEMA.split(", ")])
    list(state.handleInputRows((0,), iter([frame]), Clock(0)))
    assert handle.timers == {2}
    handle.timers.clear()
    first = pd.concat(state.handleExpiredTimer((0,), Clock(11), None))
    assert len(first) == 10 and handle.timers == {12}
    rest = pd.concat(state.handleExpiredTimer((0,), Clock(100), None))
    assert sorted([*first["pos"], *rest["pos"]]) == list(range(30)) and handle.timers == {12}
