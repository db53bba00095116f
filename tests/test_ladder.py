"""Books in the state store: touched rungs only, gone after the market closes, equal to a replay over whole books."""

import datetime
import random

import pandas as pd
import pytest

from oddsloom.streaming import ladder
from oddsloom.streaming import run as st
from tests.test_streams_and_splits import LEVELS, batches
from tests.test_venue_state import MS, Book, Clock, Handle

SECOND = 1_000_000_000


class Queue(list):
    """A list state in memory."""

    def appendList(self, values):
        self.extend(values)

    def get(self):
        return iter(self)


class Store(Handle):
    def getListState(self, name, *_):
        return self.states.setdefault(name, Queue())

    def empty(self):
        return not any(len(s) for s in self.states.values())


def processor(kind, **how):
    store, made = Store(), kind(**how)
    made.init(store)
    return store, made


def feed(made, rows, cuts, clock=None):
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if a < b:
            out += [f for f in made.handleInputRows((1,), iter([pd.DataFrame(rows[a:b])]), clock or Clock(0))]
    return [tuple(None if pd.isna(x) else x for x in r) for f in out for r in f.itertuples(index=False)]


def test_ladder_equals_a_dictionary_and_reads_what_it_touches():
    r, store, filled, want = random.Random(1), Book(), [], {1: {}, 2: {}}
    for _ in range(200):
        reads = []
        store.getValue = lambda key: reads.append(key) or dict.__getitem__(store, key)
        book = ladder.Ladder(store, filled, 0.05)
        changed = set()
        for _ in range(r.randint(1, 6)):
            side, price, size = r.choice([1, 2]), round(r.random(), 2), float(r.choice([0, 0, 1, 2]))
            if r.random() < 0.02:
                book.clear(side)
                want[side] = {}
            book.put(side, price, size)
            changed.add((side, int(price // 0.05)))
            want[side].pop(price, None)
            if size:
                want[side][price] = size
        best = [want[1] and max(want[1]), want[2] and min(want[2])]
        for side, price in zip((1, 2), best):
            assert book.best(side) == ((price, want[side][price]) if want[side] else None)
        # Rungs of changed levels (one more by rounding), and the outermost of each side as others empty.
        assert len(reads) <= 2 * len(changed) + 4
        filled = book.save()
    assert sorted((s, p, q) for (s, _), (levels,) in store.items() for p, q in levels) == sorted((s, p, q) for s in want for p, q in want[s].items())


def depth_replay(rows):
    """Whole books in dictionaries; every snapshot tries the held updates one by one."""
    book, last, held, out = None, None, [], []
    def put(book, row):
        for side in ("bids", "asks"):
            for x in row[side]:
                book[side].pop(x["price"], None)
                if x["size"]:
                    book[side][x["price"]] = x["size"]
    for row in rows:
        if row["kind"] == "delta":
            if book is None:
                held.append(row)
                status = "awaiting_snapshot"
            elif row["final_id"] <= last:
                status = "stale"
            elif row["first_id"] <= last + 1:
                put(book, row)
                last, status = row["final_id"], "applied"
            else:
                book, last, held, status = None, None, [row], "gap"
        else:
            ahead = [h for h in held if h["final_id"] > row["final_id"]]
            if ahead and ahead[0]["first_id"] > row["final_id"] + 1:
                book, last, status = None, None, "awaiting_snapshot"
            else:
                book, last, status = {"bids": {}, "asks": {}}, row["final_id"], "applied"
                put(book, row)
                while ahead:
                    if ahead[0]["final_id"] <= last:
                        status = "stale"
                    elif ahead[0]["first_id"] <= last + 1:
                        put(book, ahead[0])
                        last, status = ahead[0]["final_id"], "applied"
                    else:
                        book, last, status = None, None, "gap"
                        break
                    ahead = ahead[1:]
                held = ahead
        top = (None,) * 4
        if status == "applied" and book["bids"] and book["asks"] and max(book["bids"]) < min(book["asks"]):
            b, a = max(book["bids"]), min(book["asks"])
            top = (b, a, book["bids"][b], book["asks"][a])
        out.append((1, row["pos"], status, last, *top))
    return out


def depth_rows(seed, n=300):
    r, rows, at = random.Random(seed), [], 10
    level = lambda low: {"price": round(low + r.randint(0, 30) / 100, 2), "size": float(r.choice([0, 1, 2, 3]))}
    for pos in range(n):
        first = at + 1 - r.choice([0, 0, 0, 2]) + r.choice([0] * 12 + [3])
        final = max(first, at + r.randint(0, 3))
        snap = r.random() < 0.15
        if snap:
            final = at - r.choice([0, 0, 5, 12])
        else:
            at = max(at, final)
        rows.append({"pos": pos, "kind": "snapshot" if snap else "delta", "first_id": first, "final_id": final, "bids": [level(0.1) for _ in range(3)],
                     "asks": [level(0.42) for _ in range(3)], "ts_ns": (pos + 1) * SECOND, "close_ns": None})
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_depth_sync_over_micro_batches_equals_a_replay(seed):
    rows = depth_rows(seed)
    cuts = sorted(random.Random(seed).sample(range(1, 300), 40))
    got = feed(processor(ladder.DepthSync, rung=0.03)[1], rows, cuts)
    assert got == depth_replay(rows)
    assert {r[2] for r in got} == {"awaiting_snapshot", "applied", "stale", "gap"}


def test_held_updates_can_be_bounded():
    rows = [r for r in depth_rows(3) if r["kind"] == "delta"][:10]
    got = feed(processor(ladder.DepthSync, max_buffered=4)[1], rows, [3, 6])
    assert [r[2] for r in got] == ["awaiting_snapshot"] * 4 + ["gap"] + ["awaiting_snapshot"] * 4 + ["gap"]


@pytest.mark.parametrize("how", [{"closes": True}, {"idle_ns": 5 * SECOND}])
@pytest.mark.parametrize("kind", [ladder.DepthSync, ladder.TokenBooks])
def test_state_is_gone_after_close(kind, how):
    store, made = processor(kind, **how)
    lv = [{"price": 0.4, "size": 1.0}]
    rows = [{"pos": i, "kind": k, "first_id": i, "final_id": i, "bids": lv, "asks": [{"price": 0.6, "size": 1.0}], "event_type": "book", "source_ts": i, "receive_ts": i,
             "side": None, "price": None, "size": None, "ts_ns": SECOND + i, "close_ns": 3 * SECOND} for i, k in enumerate(["delta", "snapshot", "delta", "delta"])]
    assert feed(made, rows, [1, 2])[-1][2] == "applied"
    assert not store.empty()
    early, late = Clock(2000), Clock(7000)
    assert all(f.empty for f in made.handleExpiredTimer((1,), early, None)) and not store.empty()
    assert min(store.timers) > 2000 and max(store.timers) <= 7000
    assert all(f.empty for f in made.handleExpiredTimer((1,), late, None)) and store.empty()


@pytest.mark.parametrize("closes, last", [(True, "awaiting_snapshot"), (False, "applied")])
def test_a_closed_market_starts_anew_in_a_real_stream(spark, closes, last):
    lv = lambda *xs: [{"price": p, "size": s} for p, s in xs]
    at = lambda s: datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=s)
    row = lambda key, pos, s, kind, bids=(), asks=(), price=None: (
        key, pos, s * SECOND, s * SECOND, kind, list(bids), list(asks), "BUY" if price else None, price, 1.0 if price else None, at(s), s * SECOND, 3 * SECOND)
    book = (lv((0.4, 1.0)), lv((0.6, 2.0)))
    data = [row(7, 0, 1, "book", *book), row(8, 1, 10, "book", *book), row(8, 2, 11, "book", *book), row(7, 3, 12, "price_change", price=0.45)]
    df = spark.createDataFrame(data, f"asset_id bigint, pos bigint, source_ts bigint, receive_ts bigint, event_type string, bids {LEVELS}, asks {LEVELS}, "
                                     "side string, price double, size double, ts timestamp, ts_ns bigint, close_ns bigint")
    stream = batches(spark, df, "pos", 4).withWatermark("ts", "0 seconds")
    out = st.drain(st.process(stream, ["asset_id"], ladder.TokenBooks(closes=closes), time_mode="EventTime")).orderBy("pos").collect()
    assert [r.status for r in out] == ["applied", "applied", "applied", last]
