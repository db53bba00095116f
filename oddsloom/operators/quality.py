"""The event quality gate as a batch job, equal row by row to the stateful stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from oddsloom.operators.timeline import (
    Timeline,
    before,
    latest,
    previous,
    running_count,
    running_max,
    running_sum,
    scan,
)
from oddsloom.session import NANOS, release, settle

#: Passes over all keys before keys that still change are replayed event by event.
ROUNDS = 6
#: Events of a key that one task replays at a time.
REPLAY_ROWS = 200_000
MAX_DELAY_NS = NANOS


def is_stale(source_ts: str, receive_ts: str, max_delay_ns: int = MAX_DELAY_NS) -> Column:
    """Receipt further than `max_delay_ns` from the source time, in either direction."""
    return F.coalesce(F.abs(F.col(receive_ts) - F.col(source_ts)) > max_delay_ns, F.lit(False))


def quality_gate(
    events: DataFrame,
    *,
    keys: Sequence[str],
    pos: str,
    identifier: str,
    available: str,
    source_ts: str,
    receive_ts: str,
    width: int,
    max_seen: int | None = None,
    max_delay_ns: int = MAX_DELAY_NS,
    rounds: int = ROUNDS,
    gap: Column | None = None,
    replay_rows: int = REPLAY_ROWS,
) -> DataFrame:
    """`status` (accepted, duplicate, out_of_order; gap), `epoch_id` and `stale` of every event.

    In arrival order: a repeat of an identifier accepted in the current epoch (among the last
    `max_seen` accepted, if given) is a duplicate; an event available before the last accepted one is out of
    order and opens the next epoch; anything else is accepted. Every event has a time.

    Duplicates depend on epochs and epochs on duplicates, so the job guesses the duplicates, derives
    everything else with scans, and repeats until the guess reproduces itself. As each row's status
    follows from earlier rows only, such a fixed point is the sequential answer. It may be many rounds
    away where few identifiers repeat and times fall back often: keys that still change after
    `rounds` passes are replayed in pieces of `replay_rows` events, see `_replay`.

    Rows where `gap` is true are control marks, not events: each opens an epoch that knows no identifier and no time. The
    stretches between marks are gates of their own, and epochs are counted over all of them.
    """
    keys = list(keys)
    if gap is not None:
        line = Timeline.of(keys, [pos], width)
        marked = settle(scan(events.withColumn("__gap", F.coalesce(gap, F.lit(False))), line, {"__part": running_count(F.col("__gap"))}))
        inner = quality_gate(
            marked.filter("NOT __gap"), keys=[*keys, "__part"], pos=pos, identifier=identifier, available=available, source_ts=source_ts,
            receive_ts=receive_ts, width=width, max_seen=max_seen, max_delay_ns=max_delay_ns, rounds=rounds, replay_rows=replay_rows,
        ).drop("epoch_id")
        marks = marked.filter("__gap").withColumns({"status": F.lit("gap"), "stale": F.lit(False)})
        opens = F.col("status").isin("gap", "out_of_order")
        every = scan(settle(inner.unionByName(marks)), line, {"epoch_id": running_count(opens)})
        return every.select(*events.columns, "status", "epoch_id", "stale")
    line = Timeline.of(keys, [pos], width)
    same = Timeline.of([*keys, identifier], [pos], width)
    columns = events.columns
    rows = settle(
        scan(events, same, {"__seen": before(running_count())}).withColumn("__dup", F.col("__seen") > 0).drop("__seen")
    )
    table = rows
    for _ in range(max(1, rounds)):
        live = ~F.col("__dup")
        step = scan(
            rows,
            line,
            {"__last": before(latest(F.when(live, F.col(available)))), "__n": running_count(live)},
            hold=True,
        )
        falls = F.coalesce(F.col(available) < F.col("__last"), F.lit(False))
        step = scan(
            step.withColumn("__falls", falls), line,
            {"__calm": latest(F.when(live & ~F.col("__falls"), F.col("__n")))},
        )
        # An out-of-order event forgets the last time, so in a run of falls every second one passes.
        ooo = live & F.col("__falls") & ((F.col("__n") - F.col("__calm")) % 2 == 1)
        step = half = settle(step.withColumn("__ooo", F.coalesce(ooo, F.lit(False))))
        accepted = ~F.col("__dup") & ~F.col("__ooo")
        step = scan(
            step,
            line,
            {"__epoch": before(running_count(F.col("__ooo"))), "__acc": before(running_count(accepted))},
        )
        again = Timeline.of([*keys, identifier, "__epoch"], [pos], width)
        step = scan(step, again, {"__kept": before(latest(F.when(accepted, F.col("__acc"))))})
        dup = F.col("__kept").isNotNull()
        if max_seen is not None:
            dup = dup & (F.col("__acc") - F.col("__kept") - 1 < max_seen)
        step = settle(step.withColumn("__dup2", F.coalesce(dup, F.lit(False))))
        release(table, half)
        table = step
        if step.filter("__dup <> __dup2").limit(1).count() == 0:
            break
        rows = step.select(*columns, F.col("__dup2").alias("__dup"))
    else:
        moving = step.filter("__dup <> __dup2").select(*keys).distinct()
        done = step.join(moving, keys, "left_anti").select(*columns, "__dup2", "__ooo", "__epoch")
        rest = step.join(moving, keys, "left_semi").select(*columns)
        step = done.unionByName(_replay(rest, keys, pos, identifier, available, max_seen, width, replay_rows))
    status = F.when(F.col("__dup2"), "duplicate").when(F.col("__ooo"), "out_of_order").otherwise("accepted")
    epoch = F.col("__epoch") + F.when(F.col("__ooo"), 1).otherwise(0)
    return step.select(
        *columns,
        status.alias("status"),
        epoch.cast("bigint").alias("epoch_id"),
        (is_stale(source_ts, receive_ts, max_delay_ns) & (status == "accepted")).alias("stale"),
    )


def _replay(
    events: DataFrame, keys: list[str], pos: str, identifier: str, available: str, max_seen: int | None, width: int, replay_rows: int
) -> DataFrame:
    """`__dup2`, `__ooo` and `__epoch` of each event of keys that are gone through in order.

    A key is cut into pieces of `replay_rows` events, each a group of its own. What a piece does depends on what it starts
    with only until its first reset: from an out-of-order event on, nothing earlier is remembered. So all pieces first start
    empty; those that in truth start with something else are gone through again with what the piece before ended with, until
    no start changes. Pieces that hold resets settle in the second pass, whatever the number of pieces."""
    columns = events.columns
    line = Timeline.of(keys, [pos], width)
    pieces = scan(events, line, {"__nth": before(running_count())})
    pieces = settle(pieces.withColumn("__piece", F.floor(F.coalesce("__nth", F.lit(0)) / replay_rows)).drop("__nth"))
    own = [F.col(k) for k in keys]
    facts = F.struct(*columns)
    kinds = {n: pieces.schema[n].dataType.simpleString() for n in (*keys, pos, identifier, available)}
    shape = ", ".join(f"`{k}` {t}" for k, t in kinds.items() if k in keys)
    told = f"{shape}, __piece bigint, row {pieces.select(facts.alias('r')).schema['r'].dataType.simpleString()}, dup boolean, ooo boolean, opened bigint, ids array<{kinds[identifier]}>, last {kinds[available]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a piece arrive behind the row with its start; a row with what it ends with follows them."""
        here, seen, last, opened = None, {}, None, 0

        def end():
            return {**dict(zip(keys, here[:-1])), "__piece": here[-1], "opened": opened, "ids": list(seen), "last": last}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                place = (*(row[k] for k in keys), row["__piece"])
                if place != here:
                    if here is not None:
                        out.append(end())
                    here, seen, last, opened = place, {}, None, 0
                if row["row"] is None:
                    # Identifiers are kept in order of acceptance.
                    seen, last = dict.fromkeys(row["ids"] or ()), row["last"]
                    continue
                ident, at = row["row"][identifier], row["row"][available]
                known = ident in seen
                fell = not known and last is not None and at is not None and at < last
                out.append({**dict(zip(keys, here[:-1])), "__piece": here[-1], "row": row["row"], "dup": known, "ooo": fell, "opened": opened})
                if fell:
                    seen, last, opened = {}, None, opened + 1
                elif not known:
                    seen[ident] = None
                    last = last if at is None else at
                    if max_seen is not None and len(seen) > max_seen:
                        del seen[next(iter(seen))]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if here is not None:
            yield pa.RecordBatch.from_pylist([end()], schema=arrow)

    nothing = {"ids": F.lit(None).cast(f"array<{kinds[identifier]}>"), "last": F.lit(None).cast(kinds[available])}
    feed = pieces.select(*own, "__piece", F.col(pos).alias("__at"), facts.alias("row"), *[c.alias(n) for n, c in nothing.items()])
    shell = events.sparkSession.createDataFrame([], told)
    arrow = to_arrow_schema(shell.schema)

    def through(starts: DataFrame | None) -> DataFrame:
        rows = feed
        if starts is not None:
            rows = feed.join(starts.select(*own, "__piece"), [*keys, "__piece"], "left_semi").select(*feed.columns)
            rows = rows.unionByName(starts.select(*own, "__piece", F.lit(None).cast(kinds[pos]).alias("__at"), F.lit(None).cast(feed.schema["row"].dataType).alias("row"), "ids", "last"))
        return settle(rows.repartition(*keys, "__piece").sortWithinPartitions(*keys, "__piece", F.asc_nulls_first("__at")).mapInArrow(run, told))

    def starts_of(ends: DataFrame) -> DataFrame:
        return ends.select(*own, (F.col("__piece") + 1).alias("__piece"), "ids", "last")

    done, begun = through(None), None
    while True:
        ends = done.filter("row IS NULL")
        wanted = starts_of(ends).join(pieces.select(*keys, "__piece").distinct(), [*keys, "__piece"], "left_semi")
        had = begun if begun is not None else wanted.limit(0)
        was = had.select(*own, "__piece", F.col("ids").alias("__ids"), F.col("last").alias("__last"), F.lit(True).alias("__had"))
        differs = F.when(F.col("__had").isNull(), (F.size("ids") > 0) | F.col("last").isNotNull()).otherwise(
            ~F.col("ids").eqNullSafe(F.col("__ids")) | ~F.col("last").eqNullSafe(F.col("__last"))
        )
        joined = wanted.join(was, [*keys, "__piece"], "left")
        changed = settle(joined.filter(differs).select(*wanted.columns))
        if not changed.limit(1).count():
            break
        begun = settle(joined.select(*wanted.columns))
        again = through(changed)
        done = settle(done.join(changed.select(*own, "__piece"), [*keys, "__piece"], "left_anti").select(*again.columns).unionByName(again))
    base = Timeline.of(keys, "__piece", None)
    opened = scan(done.filter("row IS NULL").select(*own, "__piece", "opened"), base, {"__before": before(running_sum(F.col("opened")))})
    met = done.filter("row IS NOT NULL").join(opened.select(*own, "__piece", "__before"), [*keys, "__piece"])
    return met.select(
        *[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("dup").alias("__dup2"), F.col("ooo").alias("__ooo"),
        (F.col("opened") + F.coalesce("__before", F.lit(0))).cast("bigint").alias("__epoch"),
    )


def quality_counters(gated: DataFrame, *, keys: Sequence[str], gaps: bool = False) -> DataFrame:
    """Totals per stream: accepted, duplicate, out of order, stale, epochs; gap marks if asked for."""
    return gated.groupBy(*keys).agg(
        F.count_if(F.col("status") != "gap").alias("total_events"),
        F.count_if(F.col("status") == "accepted").alias("accepted_events"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_events"),
        F.count_if(F.col("status") == "out_of_order").alias("out_of_order_events"),
        F.count_if(F.col("stale")).alias("stale_events"),
        *([F.count_if(F.col("status") == "gap").alias("gap_events")] if gaps else []),
        (F.max("epoch_id") + 1).alias("epochs"),
    )


def monotone_availability(
    events: DataFrame, *, keys: Sequence[str], order: Sequence[str], source_ts: str, receive_ts: str, width: int,
    tolerance_ns: int = NANOS, out: str = "available_ts",
) -> DataFrame:
    """max(source, receive, previous availability); a source time falling back by the tolerance or
    more drops the carried value."""
    line = Timeline.of(keys, order, width)
    seen = scan(events, line, {"__was": previous(F.col(source_ts))}, hold=True)
    seen = seen.withColumn("__back", F.coalesce(F.col(source_ts) + tolerance_ns <= F.col("__was"), F.lit(False)))
    seen = scan(seen, line, {"__part": running_count(F.col("__back"))})
    base = F.greatest(F.col(source_ts), F.col(receive_ts))
    inner = Timeline.of([*keys, "__part"], order, width)
    return scan(seen, inner, {out: running_max(base)}).drop("__was", "__back", "__part")
