"""Feature state in event time against a replay that keeps every fact."""

import math

import numpy as np
import pandas as pd
import pytest

from oddsloom.operators import features
from oddsloom.streaming import run as st
from oddsloom.streaming.venue import VenueState, venue_features
from tests.test_streams_and_splits import batches

MS = 1_000_000
WINDOWS = {"a": 7 * MS, "b": 50 * MS, "c": 400 * MS}
RETENTION = 300 * MS
SCHEMA = (
    "key bigint, pos bigint, ts_ns bigint, ts timestamp, kind string, price double, quantity double, sign double, bid double, ask double, "
    "bid_size double, ask_size double, source_ns bigint, start_ns bigint"
)


def rows_of(seed, n=400, keys=3, kinds=("trade", "trade", "trade", "book", "reference", "decision", "gap"), jitter=0):
    rng = np.random.default_rng(seed)
    out, at = [], 0
    for pos in range(n):
        at += int(rng.integers(0, 9)) * MS + int(rng.integers(0, 3)) * 300_000
        kind = kinds[int(rng.integers(0, len(kinds)))]
        if kind == "gap" and rng.random() < 0.7:
            kind = "trade"
        # Spark takes rows of the epoch itself for late.
        ts = max(MS, at - int(rng.integers(0, jitter + 1)) * MS)
        number = lambda k: round(float(rng.random()) * k + 0.1, 3)
        out.append((
            int(rng.integers(0, keys)), pos, ts, pd.Timestamp(ts).to_pydatetime(), kind, 0.0 if rng.random() < 0.03 else number(10), number(3), float(rng.integers(-1, 2)),
            number(1), number(1) + 1, number(5), number(5), ts - int(rng.integers(0, 200)) * MS, ts - int(rng.integers(0, 150)) * MS,
        ))
    return out


def replay(rows, windows=WINDOWS, retention=RETENTION):
    """Every decision from the full history of its key."""
    out = {}
    for d in (r for r in rows if r[4] == "decision"):
        past = sorted((r for r in rows if r[0] == d[0] and r[2] <= d[2] and r[4] != "decision"), key=lambda r: (r[2], r[1]))
        gaps = [i for i, r in enumerate(past) if r[4] == "gap"]
        live = past[gaps[-1] + 1 :] if gaps else past
        trades = [r for r in live if r[4] == "trade" and r[5] > 0]
        books = [r for r in live if r[4] == "book"]
        refs = [r for r in live if r[4] == "reference"]
        got = []
        for span in windows.values():
            inside = [r for r in trades if r[2] >= d[2] - span]
            if not inside:
                got += [0.0, 0.0, 0.0]
                continue
            worth = [r[5] * r[6] for r in inside]
            r2 = sum(math.log(b[5] / a[5]) ** 2 for a, b in zip(inside, inside[1:]))
            got += [math.log(inside[-1][5] / inside[0][5]), math.sqrt(r2), sum(w * r[7] for w, r in zip(worth, inside)) / sum(worth)]
        kept = [r for r in refs if r[2] >= refs[-1][2] - retention]
        opening = [r for r in kept if r[12] <= d[13]]
        got += [trades[-1][5], trades[-1][2]] if trades else [None, None]
        got += [*books[-1][8:12], books[-1][2]] if books else [None] * 5
        got += [refs[-1][5], refs[-1][2]] if refs else [None, None]
        out[d[0], d[1]] = [*got, opening[-1][5] if opening else None, bool(gaps)]
    return out


def same(found, want):
    assert {(r[0], r[1]) for r in found} == set(want)
    for r in found:
        for a, b in zip(r[3:], want[r[0], r[1]], strict=True):
            assert (a is None) == (b is None) and (a is None or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (r, want[r[0], r[1]])


def run(spark, rows, n, late="0 milliseconds", **more):
    # A last row far ahead lets the watermark pass every decision.
    end = (99, 10**6, 10**12, pd.Timestamp(10**12).to_pydatetime(), "book", *[1.0] * 7, 0, 0)
    stream = batches(spark, spark.createDataFrame([*rows, end], SCHEMA), "pos", n)
    out = venue_features(stream, key="key", event_time="ts", late=late, windows_ns=WINDOWS, retention_ns=RETENTION, **more)
    return [tuple(r) for r in st.drain(out).collect()]


@pytest.mark.parametrize("seed, n, slot", [(1, 1, None), (2, 6, 5 * MS), (3, 12, 1000 * MS), (4, 4, MS)])
def test_decisions_equal_a_full_replay(spark, seed, n, slot):
    rows = rows_of(seed)
    same(run(spark, rows, n, slot_ns=slot), replay(rows))


def test_late_facts_within_the_watermark_count(spark):
    rows = rows_of(7, jitter=40)
    same(run(spark, rows, 8, late="60 milliseconds"), replay(rows))


def test_windows_equal_the_batch_job(spark):
    rows = [r for r in rows_of(9) if r[4] in ("trade", "decision")]
    df = spark.createDataFrame(rows, SCHEMA)
    side = "CASE WHEN sign > 0 THEN 'buy' WHEN sign < 0 THEN 'sell' ELSE 'none' END AS side"
    batch = features.trade_windows(
        df.filter("kind = 'decision'").selectExpr("key", "pos", "ts_ns AS decision_ns"), df.filter("kind = 'trade'").selectExpr("key", "ts_ns", "pos AS no", "price", "quantity", side),
        keys=["key"], decision_ts="decision_ns", ts="ts_ns", tie=["no"], windows_ns=WINDOWS, width=100 * MS, side="side",
    )
    names = [f"{f}_{w}" for w in WINDOWS for f in ("return", "rv", "flow")]
    want = {(r["key"], r["pos"]): [r[c] for c in names] for r in batch.collect()}
    found = {(r[0], r[1]): list(r[3 : 3 + len(names)]) for r in run(spark, rows, 5)}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], atol=1e-9) for k in want)


class Book(dict):
    """Map and value states in memory."""

    def updateValue(self, key, value):
        self[key] = value

    getValue = dict.__getitem__
    removeKey = dict.pop
    containsKey = dict.__contains__

    def exists(self):
        return "one" in self

    def update(self, value):
        self["one"] = value

    def get(self):
        return self["one"]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Book())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def feed(state, handle, rows, step=50, span=10**9):
    """The rows in small batches, the watermark behind each; most slots ever held."""
    frame, most, out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]), 0, []
    clock = Clock(0)
    for a in range(0, len(frame), step):
        part = frame.iloc[a : a + step]
        list(state.handleInputRows((0,), iter([part]), clock))
        clock = Clock(int(part["ts_ns"].max()) // MS)
        for at in sorted(t for t in handle.timers if t <= clock.ms):
            handle.timers.discard(at)
            out += [f for f in state.handleExpiredTimer((0,), clock, None)]
        most = max(most, len(handle.states["slots"]))
    return most, pd.concat(out) if out else None


def test_state_stays_small_and_is_forgotten(spark):
    rows = rows_of(11, n=6000, keys=1)
    handle, state = Handle(), VenueState("key", WINDOWS, RETENTION, slot_ns=20 * MS, idle_ns=1000 * MS)
    state.init(handle)
    most, found = feed(state, handle, rows)
    # The rows span some 24 s of 20 ms slots; a window of 0.4 s, references of 0.3 s and one batch stay.
    assert most < 130 and len(found) > 500
    want = replay(rows[:1500])
    same([tuple(None if pd.isna(x) else x for x in r) for r in found.itertuples(index=False) if (r.key, r.pos) in want], {k: v for k, v in want.items() if k[1] < rows[1450][1]} | {k: v for k, v in want.items() if k in {(r.key, r.pos) for r in found.itertuples()}})
    for at in sorted(handle.timers):
        list(state.handleExpiredTimer((0,), Clock(10**9), None))
    assert not handle.states["slots"] and not handle.states["head"].exists()


def test_a_trade_touches_its_own_slot_only():
    handle, state = Handle(), VenueState("key", WINDOWS, RETENTION, slot_ns=20 * MS)
    state.init(handle)
    feed(state, handle, [r for r in rows_of(13, n=2000, keys=1, kinds=("trade",))])
    touched, slots = [], handle.states["slots"]
    read = slots.getValue
    slots.getValue = lambda key: touched.append(key) or read(key)
    last = max(k[1] for k in slots)
    row = (0, 10**5, last * 20 * MS + 1, None, "trade", 1.0, 1.0, 1.0, *[0.0] * 4, 0, 0)
    feed(state, handle, [row])
    assert touched == [(0, last)]
