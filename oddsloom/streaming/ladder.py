"""Order books in the state store that are touched level by level and end with their market.

Prices are cut into rungs; a rung's levels are one entry of a map state. A change reads and writes its own rung, the best
price is that of the outermost filled rung, and the rest of the book stays in the store. A market that closes, or that hears
nothing for `idle_ns`, is forgotten by an event-time timer.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable
from math import floor

from pyspark.sql.streaming import StatefulProcessorHandle

from oddsloom.streaming.run import Expiring

BID, ASK = 1, 2
LEVEL = "array<struct<price:double,size:double>>"


class Ladder:
    """The book of one key during a micro-batch: rungs are read when needed, and written back once."""

    def __init__(self, store, filled: Iterable[tuple[int, int]], width: float):
        self.store, self.width = store, width
        self.rungs: dict[int, list[int]] = {BID: [], ASK: []}
        for side, rung in sorted(filled):
            self.rungs[side].append(rung)
        self.held: dict[tuple[int, int], dict[float, float]] = {}
        self.dirty: set[tuple[int, int]] = set()
        self.stored = {(s, r) for s in self.rungs for r in self.rungs[s]}

    def _rung(self, key: tuple[int, int]) -> dict[float, float]:
        if key not in self.held:
            known = key in self.stored
            self.held[key] = {p: q for p, q in self.store.getValue(key)[0]} if known else {}
        return self.held[key]

    def put(self, side: int, price: float, size: float) -> None:
        """Set a level; size 0 removes it."""
        key = (side, floor(price / self.width))
        levels = self._rung(key)
        if size:
            if not levels:
                insort(self.rungs[side], key[1])
            levels[price] = size
        elif levels.pop(price, None) is not None and not levels:
            del self.rungs[side][bisect_left(self.rungs[side], key[1])]
        self.dirty.add(key)

    def best(self, side: int) -> tuple[float, float] | None:
        if not (rungs := self.rungs[side]):
            return None
        levels = self._rung((side, rungs[-1] if side == BID else rungs[0]))
        price = max(levels) if side == BID else min(levels)
        return price, levels[price]

    def top(self) -> tuple[float, float, float, float] | None:
        """(bid, ask, bid size, ask size), unless a side is empty or they cross."""
        bid, ask = self.best(BID), self.best(ASK)
        return (bid[0], ask[0], bid[1], ask[1]) if bid and ask and bid[0] < ask[0] else None

    def clear(self, side: int | None = None) -> None:
        for s in self.rungs if side is None else (side,):
            for rung in self.rungs[s]:
                self.held[s, rung] = {}
                self.dirty.add((s, rung))
            self.rungs[s] = []

    def save(self) -> list[tuple[int, int]]:
        """Write what changed; the filled rungs."""
        for key in self.dirty:
            if levels := self.held[key]:
                self.store.updateValue(key, (sorted(levels.items()),))
            elif key in self.stored:
                self.store.removeKey(key)
        return [(s, r) for s in self.rungs for r in self.rungs[s]]


class _Books(Expiring):
    """Books of levels that end with their market."""

    def __init__(self, rung: float = 0.01, **life):
        super().__init__(**life)
        self.rung = rung

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.levels = handle.getMapState("levels", "side int, rung bigint", f"levels {LEVEL}")
        self.states.append(self.levels)


def _ordered(rows: list) -> list:
    return sorted(rows, key=lambda r: r.pos)


def _pairs(levels) -> list[tuple[float, float]]:
    return [(x["price"], x["size"]) for x in levels]


class DepthSync(_Books):
    """A depth book that follows contiguous updates from a snapshot on.

    Rows: `kind` (snapshot, delta), ids `first_id`, `final_id`, and levels `bids`, `asks`; size 0 removes a level. An update
    follows on id L if it covers L + 1, and is stale if it ends by L. Until there is a snapshot, updates are held. A
    snapshot takes up those held beyond its own id: if the first of them does not follow on it, the snapshot is too old and is left
    aside; if a later one does not, there is a gap and holding goes on from there. A gap in a running book starts over with the
    update that showed it. Held updates stay in a list in the store that only a snapshot reads; `max_buffered` bounds it, if given: a
    longer wait drops what was held.
    """

    schema = "user_id bigint, pos bigint, status string, last_id bigint, bid double, ask double, bid_size double, ask_size double"

    def __init__(self, max_buffered: int | None = None, **life):
        super().__init__(**life)
        self.max_buffered = max_buffered

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.head = handle.getValueState("head", "last bigint, waiting bigint, filled array<struct<side:int,rung:bigint>>")
        self.waiting = handle.getListState("waiting", f"first_id bigint, final_id bigint, bids {LEVEL}, asks {LEVEL}")
        self.states += [self.head, self.waiting]

    def answer(self, key, rows: list, timerValues) -> list[tuple]:
        batch = _ordered(rows)
        self.lives(batch)
        # Without a last id the book is not in step.
        last, waiting, filled = self.head.get() if self.head.exists() else (None, 0, [])
        book, out = Ladder(self.levels, [tuple(x) for x in filled or ()], self.rung), []

        def hold(updates: list, afresh: bool) -> None:
            nonlocal waiting
            if afresh:
                self.waiting.clear()
                waiting = 0
            if updates:
                self.waiting.appendList(updates)
                waiting += len(updates)

        def write(update) -> None:
            for side, changes in ((BID, update[2]), (ASK, update[3])):
                for price, size in changes:
                    book.put(side, price, size)

        def lose() -> None:
            nonlocal last
            last = None
            book.clear()

        for row in batch:
            update = (int(row.first_id), int(row.final_id), _pairs(row.bids), _pairs(row.asks))
            if row.kind == "delta" and last is None:
                status = "awaiting_snapshot"
                hold([update], afresh=False)
                if self.max_buffered is not None and waiting > self.max_buffered:
                    status = "gap"
                    hold([], afresh=True)
            elif row.kind == "delta":
                status = "stale" if update[1] <= last else "applied" if update[0] <= last + 1 else "gap"
                if status == "applied":
                    write(update)
                    last = update[1]
                elif status == "gap":
                    lose()
                    hold([update], afresh=True)
            else:
                status, last = self._snapshot(book, update, waiting, hold, write, lose)
            top = book.top() if status == "applied" else None
            out.append((key[0], int(row.pos), status, last, *(top or (None,) * 4)))
        self.head.update((last, waiting, book.save()))
        return out

    def _snapshot(self, book, snapshot, waiting, hold, write, lose) -> tuple[str, int | None]:
        held = self.waiting.get() if waiting else ()
        ahead = [(a, z, *([tuple(level) for level in side] for side in sides)) for a, z, *sides in held if z > snapshot[1]]
        reach, status, broken = snapshot[1], "applied", None
        for place, (first, final, *_) in enumerate(ahead):
            if final > reach and first > reach + 1:
                broken = place
                break
            status = "applied" if final > reach else "stale"
            reach = max(reach, final)
        lose()
        if broken == 0:
            return "awaiting_snapshot", None
        if broken is not None:
            hold(ahead[broken:], afresh=True)
            return "gap", None
        write(snapshot)
        upto = snapshot[1]
        for update in ahead:
            if update[1] > upto:
                write(update)
                upto = update[1]
        hold([], afresh=True)
        return status, reach


class TokenBooks(_Books):
    """Per-token book from snapshots and changes; a crossed or one-sided book waits for a snapshot.

    Availability never falls behind what was already known, unless the source clock fell back by `tolerance_ns` or more.
    """

    schema = "asset_id bigint, pos bigint, status string, available_ts bigint, bid double, ask double, bid_size double, ask_size double"

    def __init__(self, tolerance_ns: int = 1_000_000_000, **life):
        super().__init__(**life)
        self.tolerance_ns = tolerance_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.head = handle.getValueState("head", "ready boolean, available bigint, source bigint, filled array<struct<side:int,rung:bigint>>")
        self.states.append(self.head)

    def answer(self, key, rows: list, timerValues) -> list[tuple]:
        batch = _ordered(rows)
        self.lives(batch)
        ready, available, source, filled = self.head.get() if self.head.exists() else (False, None, None, [])
        book, out = Ladder(self.levels, [tuple(x) for x in filled or ()], self.rung), []
        for row in batch:
            known = max(int(row.source_ts), int(row.receive_ts))
            if available is not None and int(row.source_ts) + self.tolerance_ns > source:
                known = max(known, available)
            status, top = "applied", None
            if row.event_type == "price_change" and not ready:
                status = "awaiting_snapshot"
            elif row.event_type in ("book", "price_change"):
                if row.event_type == "book":
                    book.clear()
                    for side, levels in ((BID, row.bids), (ASK, row.asks)):
                        for price, size in _pairs(levels):
                            if size > 0:
                                book.put(side, price, size)
                else:
                    book.put(BID if row.side == "BUY" else ASK, row.price, row.size)
                top = book.top()
                ready = top is not None
                if not ready:
                    # Nothing but a snapshot can mend it, so its levels need not be kept.
                    status = "invalid"
                    book.clear()
            if status == "applied":
                available, source = known, int(row.source_ts)
            out.append((key[0], int(row.pos), status, known, *(top or (None,) * 4)))
        self.head.update((ready, available, source, book.save()))
        return out
