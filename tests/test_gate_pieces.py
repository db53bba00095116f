"""The quality gate with gap marks, and its replay of hot keys in pieces, against going through every event in order."""

from collections import OrderedDict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import quality
from oddsloom.streaming import gate
from oddsloom.streaming import run as st
from tests.test_ladder import Store
from tests.test_streams_and_splits import batches
from tests.test_venue_state import MS, Clock

SCHEMA = "user_id bigint, pos bigint, identifier string, available_ts bigint, source_ts bigint, receive_ts bigint, gap boolean"


def events(seed, n=900, idents=25, back=30, gaps=0.02):
    rng = np.random.default_rng(seed)
    return [
        (int(rng.integers(1, 3)) if i % 3 else 1, i, f"h{rng.integers(0, idents)}", int(i * 2 - rng.integers(0, back)) if rng.random() > 0.03 else None, 2 * i,
         2 * i + int(rng.integers(0, 9)), bool(rng.random() < gaps)) for i in range(n)
    ]


def in_order(rows, max_seen=None, max_delay=5):
    out, state = {}, {}
    for key, pos, ident, at, source, receive, gap in rows:
        epoch, last, seen = state.get(key, (0, None, OrderedDict()))
        stale = False
        if gap:
            told, epoch, last, seen = "gap", epoch + 1, None, OrderedDict()
        elif ident in seen:
            told = "duplicate"
        elif last is not None and at is not None and at < last:
            told, epoch, last, seen = "out_of_order", epoch + 1, None, OrderedDict()
        else:
            told, last, stale = "accepted", last if at is None else at, abs(receive - source) > max_delay
            seen[ident] = None
            if max_seen is not None and len(seen) > max_seen:
                seen.popitem(last=False)
        state[key] = (epoch, last, seen)
        out[key, pos] = (told, epoch, stale)
    return out


def gated(df, **how):
    found = quality.quality_gate(
        df, keys=["user_id"], pos="pos", identifier="identifier", available="available_ts", source_ts="source_ts", receive_ts="receive_ts", width=100, max_delay_ns=5, **how
    )
    return {(r.user_id, r.pos): (r.status, r.epoch_id, r.stale) for r in found.collect()}


@pytest.mark.parametrize("piece", [1, 40, 10_000])
@pytest.mark.parametrize("max_seen", [None, 4])
def test_replay_in_pieces_equals_one_pass(spark, piece, max_seen):
    rows = events(3, n=25 if piece == 1 else 900, gaps=0)
    assert gated(spark.createDataFrame(rows, SCHEMA), rounds=1, replay_rows=piece, max_seen=max_seen) == in_order(rows, max_seen)


def test_pieces_without_a_reset_hand_everything_on(spark):
    rows = [(1, i, f"h{i * 7 % 60}", i, i, i, False) for i in range(200)]
    assert gated(spark.createDataFrame(rows, SCHEMA), rounds=1, replay_rows=30) == in_order(rows)
    keys = ["user_id"]
    out = quality._replay(spark.createDataFrame(rows, SCHEMA), keys, "pos", "identifier", "available_ts", None, 100, 30)
    assert sum(r["__dup2"] for r in out.collect()) == 140


def test_replay_takes_numbers_for_identifiers(spark):
    rows = events(5, n=200, gaps=0)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("identifier", F.expr("cast(substring(identifier, 2) AS bigint)"))
    assert gated(df, rounds=1, replay_rows=17) == in_order(rows)


@pytest.mark.parametrize("rounds", [1, 6])
def test_gap_marks_open_epochs(spark, rounds):
    rows = events(7)
    got = gated(spark.createDataFrame(rows, SCHEMA), rounds=rounds, replay_rows=50, gap=F.col("gap"))
    assert got == in_order(rows)
    counts = quality.quality_counters(spark.createDataFrame([(k[0], *v) for k, v in got.items()], "user_id long, status string, epoch_id long, stale boolean"), keys=["user_id"], gaps=True)
    for r in counts.collect():
        mine = [v for k, v in got.items() if k[0] == r.user_id]
        assert r.gap_events == sum(v[0] == "gap" for v in mine) and r.total_events == len(mine) - r.gap_events and r.epochs == max(v[1] for v in mine) + 1


def test_stream_with_gap_marks_equals_the_batch_job(spark):
    rows = events(9, n=300)
    df = spark.createDataFrame(rows, SCHEMA)
    out = st.drain(st.process(batches(spark, df, "pos", 5), ["user_id"], gate.QualityGate(max_delay_ns=5)))
    assert {(r.user_id, r.pos): (r.status, r.epoch_id, r.stale) for r in out.collect()} == in_order(rows) == gated(df, gap=F.col("gap"))


def test_gate_state_is_gone_when_idle():
    store, made = Store(), gate.QualityGate(idle_ns=50 * MS)
    made.init(store)
    frame = pd.DataFrame([(1, 0, "a", 5, 5, 5, False, 10 * MS)], columns=[*[c.split()[0] for c in SCHEMA.split(", ")], "ts_ns"])
    list(made.handleInputRows((1,), iter([frame]), Clock(0)))
    list(made.handleExpiredTimer((1,), Clock(60), None))
    assert not store.empty()
    list(made.handleExpiredTimer((1,), Clock(61), None))
    assert store.empty()
