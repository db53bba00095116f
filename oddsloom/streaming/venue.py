"""Feature state of a venue or feed in event time: trailing trades, last book, references, gaps.

Facts and decisions of a key arrive in any order up to the watermark. A decision waits for an event-time timer, so
that every fact that was available by then is in, and is answered from that moment's facts alone, whatever came in the
same micro-batch later. Facts lie in a map state by slot of time, with a slot's trade sums beside them. A batch
reads and writes the slots it touches, never a trade's predecessors; a window is the sums of its whole slots and the facts
of the slots at its ends.

A gap mark is a fact too: nothing before it is seen from behind it, and it is told from then on.

What no open or later decision can see is removed: slots behind the longest window but the last fact before it, books but the last,
references more than `retention_ns` older than the last. With `idle_ns`, a key that hears nothing that long is forgotten
altogether by a timer of its own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping
from math import isnan, log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from oddsloom.streaming.run import Keyed, due, process

TRADE, BOOK, REFERENCE, GAP = range(4)
_KINDS = {"trade": TRADE, "book": BOOK, "reference": REFERENCE, "gap": GAP}
_MS = 1_000_000


class _Slot:
    """Facts of one kind in one stretch of time, ordered by (ts, pos), and the sums of trades over all of them."""

    __slots__ = ("rows", "r2", "notional", "signed")

    def __init__(self, rows=()):
        self.rows = sorted(rows)
        self.r2 = self.notional = self.signed = 0.0

    def total(self) -> _Slot:
        self.r2, self.notional, self.signed = _trade_sums(self.rows)
        return self


def _trade_sums(rows) -> tuple[float, float, float]:
    # Floats even if empty: the state store takes an int in a double for null.
    r2 = sum((log(b[2] / a[2]) ** 2 for a, b in zip(rows, rows[1:])), 0.0)
    return r2, sum((r[3] for r in rows), 0.0), sum((r[4] for r in rows), 0.0)


class _Run:
    """Trades of a stretch of time, grown backwards."""

    def __init__(self):
        self.first = self.last = None
        self.r2 = self.notional = self.signed = 0.0

    def before(self, rows, sums) -> _Run:
        """The run with earlier trades put in front."""
        out = _Run()
        if not rows:
            out.__dict__.update(self.__dict__)
            return out
        link = log(self.first / rows[-1][2]) ** 2 if self.first is not None else 0.0
        out.first, out.last = rows[0][2], self.last if self.last is not None else rows[-1][2]
        out.r2, out.notional, out.signed = self.r2 + sums[0] + link, self.notional + sums[1], self.signed + sums[2]
        return out


class VenueState(Keyed):
    """Answers decision rows from the trades, books, references and gap marks of their key.

    Rows: `kind` (trade, book, reference, gap, decision), `ts_ns`, `pos` (order among equal times), and `price`, `quantity`,
    `sign` of trades, `bid`, `ask`, `bid_size`, `ask_size` of books, `price`, `source_ns` of references (null: `ts_ns`), `start_ns` of
    decisions (the market's start; null: none, so no opening reference). Facts at the very time of a decision count. Trades without a positive price are left out.
    """

    def __init__(self, key: str, windows_ns: Mapping[str, int], retention_ns: int, slot_ns: int | None = None, idle_ns: int | None = None):
        self.windows = sorted(windows_ns.items(), key=lambda w: w[1])
        self.longest = max(windows_ns.values())
        self.slot_ns = slot_ns or max(1, self.longest // 32)
        self.retention_ns, self.idle_ns = retention_ns, idle_ns
        made = [f"{name}_{w} double" for w in windows_ns for name in ("return", "rv", "flow")]
        self.schema = ", ".join([
            f"{key} bigint, pos bigint, ts_ns bigint", *made, "last_price double, last_trade_ns bigint, bid double, ask double, bid_size double, ask_size double, book_ns bigint",
            "latest_reference double, latest_reference_ns bigint, opening_reference double, gap boolean",
        ])
        self.columns = [c.split()[0] for c in self.schema.split(", ")]
        self.made = {w: [f"{name}_{w}" for name in ("return", "rv", "flow")] for w in windows_ns}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState(
            "slots", "kind int, slot bigint",
            "rows array<struct<ts:bigint,pos:bigint,a:double,b:double,c:double,d:double,s:bigint>>, r2 double, notional double, signed double",
        )
        # Which slots are filled, so that none is looked for in vain; decisions still open; last time heard of; whether a gap fell out of the slots.
        self.head = handle.getValueState(
            "head", "filled array<struct<kind:int,slot:bigint>>, open array<struct<ts:bigint,pos:bigint,start:bigint>>, heard bigint, gap boolean"
        )

    def _load(self) -> tuple[set, list, int, bool]:
        if not self.head.exists():
            return set(), [], 0, False
        filled, open_, heard, gap = self.head.get()
        return {tuple(x) for x in filled or ()}, [tuple(x) for x in open_ or ()], heard, gap

    def _keep(self, filled, open_, heard, gap) -> None:
        self.head.update((sorted(filled), sorted(open_), heard, gap))

    def _read(self, key) -> _Slot:
        rows, r2, notional, signed = self.slots.getValue(key)
        slot = _Slot()
        slot.rows, slot.r2, slot.notional, slot.signed = [tuple(r) for r in rows], r2, notional, signed
        return slot

    def answer(self, key, rows: list, timerValues) -> list[tuple]:
        filled, open_, heard, gap = self._load()
        facts: dict[tuple[int, int], list] = {}
        # One timer stands at the earliest open decision; it sets the next.
        awaited = min((due(d[0]) for d in open_), default=None)
        for row in rows:
            ts = int(row.ts_ns)
            heard = max(heard, ts)
            if row.kind == "decision":
                open_.append((ts, int(row.pos), int(row.start_ns)))
            elif row.kind in _KINDS and (row.kind != "trade" or (row.price is not None and row.price > 0)):
                kind = _KINDS[row.kind]
                facts.setdefault((kind, ts // self.slot_ns), []).append(_fact(kind, row))
        for (kind, slot), members in facts.items():
            self._add(kind, slot, members, filled)
        if open_ and (awaited is None or due(min(open_)[0]) < awaited):
            self.handle.registerTimer(due(min(open_)[0]))
        if self.idle_ns is not None:
            self.handle.registerTimer(due(heard + self.idle_ns))
        self._prune(filled, open_, timerValues.getCurrentWatermarkInMs() * _MS)
        self._keep(filled, open_, heard, gap)
        return []

    def _add(self, kind: int, slot: int, facts: list, filled: set) -> None:
        have = self._read((kind, slot)).rows if (kind, slot) in filled else []
        now = _Slot([*have, *facts])
        if kind == TRADE:
            now.total()
        self.slots.updateValue((kind, slot), (now.rows, now.r2, now.notional, now.signed))
        filled.add((kind, slot))

    def expired(self, key, timerValues) -> list[tuple]:
        filled, open_, heard, gap = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        # The first timer of a batch answers for all that are due; the others find nothing open.
        ready = sorted(d for d in open_ if due(d[0]) <= passed)
        held: dict = {}
        out = [self._answer(key[0], decision, filled, held, gap) for decision in ready]
        open_ = [d for d in open_ if due(d[0]) > passed]
        if self.idle_ns is not None and not open_ and due(heard + self.idle_ns) <= passed:
            self.slots.clear()
            self.head.clear()
        elif ready:
            if open_:
                self.handle.registerTimer(due(min(open_)[0]))
            self._prune(filled, open_, passed * _MS)
            self._keep(filled, open_, heard, gap)
        return out

    def _prune(self, filled: set, open_: list, passed: int) -> None:
        horizon = min([passed, *(d[0] for d in open_)])
        for kind, reach in ((TRADE, self.longest), (BOOK, 0), (REFERENCE, 0), (GAP, 0)):
            mine = sorted(s for k, s in filled if k == kind)
            over = [s for s in mine if (s + 1) * self.slot_ns <= horizon - reach]
            # The last slot that lies behind the horizon as a whole may hold the last fact before it.
            last = over[-1] if over else None
            if last is not None and kind == REFERENCE:
                over = [s for s in over if (s + 1) * self.slot_ns < last * self.slot_ns - self.retention_ns]
            for s in over:
                if s != last:
                    self.slots.removeKey((kind, s))
                    filled.discard((kind, s))

    def _answer(self, key, decision, filled, held, gap) -> tuple:
        ts, pos, start = decision
        at = ts // self.slot_ns

        def slot(kind: int, number: int) -> _Slot:
            if (kind, number) not in held:
                held[kind, number] = self._read((kind, number))
            return held[kind, number]

        def numbers(kind: int) -> list[int]:
            if kind not in held:
                held[kind] = sorted(s for k, s in filled if k == kind)
            return held[kind][: bisect_right(held[kind], at)]

        def upto(kind: int, number: int) -> list:
            rows = slot(kind, number).rows
            return rows[: bisect_left(rows, (ts + 1,))] if number == at else rows

        def latest(kind: int):
            for number in reversed(numbers(kind)):
                if rows := upto(kind, number):
                    return rows[-1]

        mark = latest(GAP)
        barrier = mark[:2] if mark else (-1, -1)
        behind = lambda row: row is not None and row[:2] > barrier
        trade, book = latest(TRADE), latest(BOOK)
        out = {c: None for c in self.columns} | {self.columns[0]: key, "pos": pos, "ts_ns": ts, "gap": mark is not None}
        if behind(trade):
            out |= {"last_price": trade[2], "last_trade_ns": trade[0]}
        if behind(book):
            out |= dict(zip(("bid", "ask", "bid_size", "ask_size"), book[2:6])) | {"book_ns": book[0]}
        # Windows grow backwards over the same slots, the shortest first.
        run, left = _Run(), list(reversed(numbers(TRADE)))
        for w, span in self.windows:
            cut = max((ts - span, -1), (barrier[0], barrier[1] + 1))
            while left and (left[0] * self.slot_ns, -1) >= cut:
                rows, own = upto(TRADE, left[0]), slot(TRADE, left[0])
                run = run.before(rows, (own.r2, own.notional, own.signed) if len(rows) == len(own.rows) else _trade_sums(rows))
                left.pop(0)
            edge = upto(TRADE, left[0]) if left else []
            edge = edge[bisect_left(edge, cut) :]
            got = run.before(edge, _trade_sums(edge))
            made = (log(got.last / got.first), sqrt(got.r2), got.signed / got.notional if got.notional > 0 else 0.0) if got.first is not None else (0.0, 0.0, 0.0)
            out |= dict(zip(self.made[w], made))
        newest = latest(REFERENCE)
        if behind(newest):
            out |= {"latest_reference": newest[2], "latest_reference_ns": newest[0]}
            oldest = (newest[0] - self.retention_ns, -1)
            for number in reversed(numbers(REFERENCE)):
                rows = [r for r in upto(REFERENCE, number) if r[:2] > barrier and r[:2] >= oldest and r[6] <= start]
                if rows:
                    out["opening_reference"] = rows[-1][2]
                    break
                if (number * self.slot_ns, -1) < oldest:
                    break
        return tuple(out.values())


def _number(x) -> float | None:
    return None if x is None or isnan(x) else float(x)


def _fact(kind: int, row) -> tuple:
    """(ts, pos, a, b, c, d, s) of a fact: price, notional, signed of trades; both sides of books; price and source time of references."""
    if kind == TRADE:
        notional = row.price * row.quantity
        parts = (row.price, notional, row.sign * notional, None, None)
    elif kind == BOOK:
        parts = (*(_number(x) for x in (row.bid, row.ask, row.bid_size, row.ask_size)), None)
    elif kind == REFERENCE:
        parts = (_number(row.price), None, None, None, int(row.source_ns))
    else:
        parts = (None,) * 5
    return int(row.ts_ns), int(row.pos), *parts


def venue_features(
    stream: DataFrame, *, key: str, event_time: str, late: str, windows_ns: Mapping[str, int], retention_ns: int,
    slot_ns: int | None = None, idle_ns: int | None = None,
) -> DataFrame:
    """A row per decision, once the watermark (`late` behind the newest event time) has passed it."""
    state = VenueState(key, windows_ns, retention_ns, slot_ns, idle_ns)
    # A null among whole numbers would make them floats on the way to Python, which hold no nanoseconds.
    times = {"source_ns": F.coalesce("source_ns", "ts_ns"), "start_ns": F.coalesce("start_ns", F.lit(0))}
    return process(stream.withColumns(times).withWatermark(event_time, late), [key], state, time_mode="EventTime")
