"""Known inputs and outputs of the normalisation, settlement, fee and signal rules."""

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import fees
from oddsloom.functions.normal import normal_cdf
from oddsloom.operators import books, edge, evaluate, portfolio, quality, trades

NS = 1_000_000_000


def test_snapshot_differences(spark, rows):
    snaps = spark.createDataFrame(
        [
            ("t", 90, 0, [".10"], ["1"], [".80"], ["1"]),
            ("t", 100, 1, [".10", ".09"], ["1", "2"], [".80", ".90"], ["1", "2"]),
            ("t", 110, 2, [".10", ".08"], ["3", "4"], [".80", ".95"], ["3", "4"]),
            ("t", 120, 3, [".08"], ["4"], [".95"], ["4"]),
        ],
        "token string, timestamp_ns bigint, pos bigint, bid_prices array<string>, bid_sizes array<string>, ask_prices array<string>, ask_sizes array<string>",
    )
    out = books.snapshot_diffs(snaps, token="token", start=100, end=120, width=7)
    got = list(zip(*rows(out, "event_index", "action", "side", "price", "size", "flags", "sequence", "ts_event", order=["event_index", "part"])))
    assert got[0] == (0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2)
    assert got[1] == (4, 1, 1, 1, 1, 2, 3, 2, 2, 3, 2, 3, 3)
    assert got[2] == (0, 1, 1, 2, 2, 1, 1, 1, 2, 2, 2, 1, 2)
    assert got[3] == (0, 0.09, 0.10, 0.90, 0.80, 0.08, 0.09, 0.10, 0.95, 0.90, 0.80, 0.10, 0.80)
    assert got[4] == (0, 2, 1, 2, 1, 4, 0, 3, 4, 0, 3, 0, 0)
    assert got[5] == (0, 0, 0, 0, 128, 0, 0, 0, 0, 0, 128, 0, 128)
    assert got[6] == (0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 1, 2)
    assert got[7] == (100,) * 5 + (110,) * 6 + (120,) * 2


def test_raw_book_rows_to_deltas(spark, rows):
    base = 1_771_767_624_001_290_000
    raw = spark.createDataFrame(
        [
            ("price_change", base + 6_000, base + 8_000, "t", None, None, ".49", "13.5", "BUY", 0),
            ("book", base + 5_000, base + 7_000, "t", '[[".48","11"]]', '[[".52","9"]]', None, None, None, 1),
        ],
        "event_type string, timestamp_ns bigint, timestamp_received_ns bigint, asset_id string, bids string, asks string, price string, size string, side string, pos bigint",
    )
    out = books.l2_deltas(raw, start=base, end=base + NS, width=NS)
    got = list(zip(*rows(out, "event_index", "action", "side", "price", "size", "flags", "ts_event", "ts_init", order=["event_index", "part"])))
    assert got[0] == (0, 0, 0, 1)
    assert got[1] == (4, 1, 1, 2)
    assert got[2] == (0, 1, 2, 1)
    assert got[3] == (0, 0.48, 0.52, 0.49)
    assert got[4] == (0, 11, 9, 13.5)
    assert got[5] == (0, 0, 128, 128)
    assert got[6][0] == base + 5_000 and got[7][3] == base + 8_000


def test_changes_before_a_snapshot_are_dropped_and_resumed_rows_skip(spark, rows):
    raw = spark.createDataFrame(
        [
            ("price_change", 1, 1, "t", None, None, ".4", "1", "BUY", 0),
            ("book", 2, 2, "t", '[[".3","1"]]', "[]", None, None, None, 1),
            ("price_change", 3, 3, "t", None, None, ".3", "0", "BUY", 2),
        ],
        "event_type string, timestamp_ns bigint, timestamp_received_ns bigint, asset_id string, bids string, asks string, price string, size string, side string, pos bigint",
    )
    out = books.l2_deltas(raw, start=0, end=9, width=10)
    assert rows(out, "event_index", "action", "flags", order=["event_index", "part"]) == [(0, 4, 0), (0, 1, 128), (1, 3, 128)]
    resumed = books.l2_deltas(raw, start=0, end=9, width=10, after=(2, 1), seeded=True)
    assert rows(resumed, "action") == [(3,)]


def test_onchain_fills(spark, rows):
    raw = spark.createDataFrame(
        [
            ("t", 99, ".20", "1", "buy", "pre", 0),
            ("t", 100, "bad", "8", "sell", "bad", 1),
            ("t", 100, ".42", "9", "ask", "txabcdefghijklmnopqrstuvwxyz", 2),
            ("t", 101, ".43", "10", "taker-sell", "txabcdefghijklmnopqrstuvwxyz", 3),
            ("t", 102, ".44", "11", "none", "nan", 4),
        ],
        "token string, timestamp_ns bigint, price string, size string, side string, id string, pos bigint",
    )
    out = trades.onchain_fills(raw, token="token", start=100, end=102, width=50, suffix=F.lit("3456"))
    assert rows(out, "price", "size", "aggressor_side", "ts_event", "trade_id", order=["ts_event"]) == [
        (0.42, 9.0, 2, 100, "cdefghijklmnopqrstuvwxyz-3456-000000"),
        (0.43, 10.0, 2, 101, "cdefghijklmnopqrstuvwxyz-3456-000001"),
        (0.44, 11.0, 0, 102, "telonex-102-3456-000000"),
    ]
    bare = trades.onchain_fills(raw, token="token", raw_id=None, start=100, end=102, width=50)
    assert rows(bare, "trade_id", order=["ts_event"])[0] == ("telonex-100-1-000000",)


def test_public_trades(spark, rows):
    raw = spark.createDataFrame(
        [
            (1771767624, "0xcccc", "asset9876", "mint", ".42", "2"),
            (1771767624, "0xaaaa", "asset9876", "BUY", "1.0", "3"),
            (1771767624, "0xaaaa", "asset9876", "SELL", ".41", "4"),
        ],
        "timestamp bigint, transaction_hash string, asset string, side string, price string, size string",
    )
    all_rows = trades.public_trades(raw, width_s=3600)
    assert rows(trades.accepted_trades(all_rows), "price_value", "size_value", "aggressor_side", "trade_id", "ts_event", order=["ts_event"]) == [
        (0.41, 4.0, 2, "0xaaaa-9876-000001", 1771767624 * NS + 1),
        (0.42, 2.0, 0, "0xcccc-9876-000000", 1771767624 * NS + 2),
    ]
    rejected = trades.rejected_trades(all_rows, token="asset", width_ns=NS)
    assert rows(rejected, "reason", "record_index", order=["record_index"]) == [("skipped_price", 0), ("unexpected_side", 2)]


def test_exchange_trades_ids_prices_and_ties(spark, rows):
    import hashlib

    raw = spark.createDataFrame(
        [
            ("T", 999_999_999, "42", "1", "yes", "", 0),
            ("T", 999_999_999, "42", "1", "yes", "", 1),
            ("T", 2_000_000_000, "1", "2", "no", "x", 2),
            ("T", 2_000_000_000, "1.0", "2", "maybe", "y", 3),
            ("T", 2_000_000_000, "oops", "2", "no", "z", 4),
        ],
        "ticker string, ts_ns bigint, yes_price string, count string, taker_side string, trade_id string, pos bigint",
    )
    got = rows(trades.exchange_trades(raw, width=NS), "price", "aggressor_side", "ts_event", "trade_id", order=["ts_event", "trade_id"])
    ids = {hashlib.shake_256(f"T|999999999|42|1|yes|{n}".encode()).hexdigest(18) for n in (0, 1)}
    assert {g[3] for g in got[:2]} == ids and [g[2] for g in got[:2]] == [999_999_999, 999_999_999]
    assert [g[:3] for g in got[2:]] == [(0.01, 2, 2_000_000_000), (1.0, 0, 2_000_000_001)]


def test_replay_order(spark, rows):
    make = lambda data: spark.createDataFrame(data, "key int, ts_event bigint, ts_init bigint, pos bigint, name string")
    book = make([(1, 10, 30, 0, "book0"), (1, 5, 5, 1, "book1"), (1, 10, 20, 2, "book2")])
    trade = make([(1, 10, 1, 0, "trade0"), (1, 5, 6, 1, "trade1")])
    out = trades.replay_order(book, trade, key="key", width=3)
    assert [r[0] for r in rows(out, "name", order=["replay_pos"])] == ["book1", "trade1", "book2", "book0", "trade0"]


def test_settlement_pnl(spark, rows):
    data = [
        ("a", 1, "buy", "yes", 0.90, 25.0, 0.0), ("b", 1, "buy", "yes", 0.40, 10.0, 0.10), ("b", 2, "sell", "yes", 0.55, 4.0, 0.05),
        ("c", 1, "sell", "yes", 0.70, 10.0, 0.0), ("d", 1, "buy", "yes", 0.70, 0.0, 0.0), ("e", 1, "buy", "no", 0.30, 10.0, 0.0),
    ]
    fills = spark.createDataFrame(data, "market string, ts bigint, action string, side string, price double, quantity double, commission double")
    outcome = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0), ("e", 0.0)], "market string, outcome double")
    got = dict(rows(portfolio.settlement_pnl(fills, outcome, market="market", order=["ts"]), "market", "settlement_pnl"))
    assert got == {"a": pytest.approx(2.5), "b": pytest.approx(4.05), "c": pytest.approx(-3.0), "e": pytest.approx(7.0)}


def _series(spark, *lists):
    data = [(m, i, float(v), j) for m, xs in enumerate(lists) for j, (i, v) in enumerate(xs)]
    return spark.createDataFrame(data, "market int, ts bigint, value double, pos int").withColumn("folio", F.lit(1))


@pytest.mark.parametrize(
    "a,b,want",
    [
        ([(0, 100), (1, 90), (2, 110), (3, 100)], [(0, 100), (1, 110), (2, 90), (3, 100)], 0.0),
        ([(0, 100), (1, 80), (2, 100)], [(0, 100), (1, 80), (2, 100)], 40.0),
    ],
)
def test_joint_drawdown(spark, a, b, want):
    joint = portfolio.joint_series(
        _series(spark, a, b), portfolio="folio", market="market", ts="ts", value="value", tie=["pos"], width=2
    )
    dd = portfolio.drawdown(joint, keys=["folio"], order=["ts"], value="value", width=2)
    assert dd.agg(F.max("drawdown")).first()[0] == pytest.approx(want)


def test_joint_drawdown_counts_the_last_of_duplicate_times(spark):
    s = _series(spark, [(0, 100), (60, 95), (60, 90)], [(30, 50), (90, 50)])
    joint = portfolio.joint_series(s, portfolio="folio", market="market", ts="ts", value="value", tie=["pos"], width=20)
    dd = portfolio.drawdown(joint, keys=["folio"], order=["ts"], value="value", width=20)
    assert dd.agg(F.max("drawdown")).first()[0] == pytest.approx(10.0)


def test_scores_and_fill_attribution(spark):
    df = spark.createDataFrame([(0.6, 1), (0.8, 0)], "p double, y int")
    assert evaluate.probability_scores(df, p="p", y="y").first().brier_score == pytest.approx(0.4)
    fill = spark.createDataFrame(
        [(0.58, 0.64, 0.61, 0.60, 10.0, 0.1, 0.0, 1)],
        "p_boundary double, p_fair double, p_market double, entry_price double, shares double, fee double, rebate double, outcome int",
    )
    s = evaluate.maker_fill_summary(fill).first()
    assert (s.net_expected_value, s.realized_pnl) == (pytest.approx(0.3), pytest.approx(3.9))


def test_fees(spark):
    c = lambda x: F.lit(float(x))
    row = spark.range(1).select(
        fees.quadratic_fee(c(100), c(0.5), c(0.003), F.lit(True)).alias("a"),
        fees.quadratic_fee(c(1), c(0.5), c(0.00022), F.lit(True)).alias("b"),
        fees.quadratic_fee(c(100), c(0.5), c(0.003), F.lit(False)).alias("c"),
        fees.maker_rebate(c(100), c(0.5), F.lit(30), F.lit("0.25").cast("decimal(4,2)")).alias("d"),
        fees.ceiling_fee(c(10), c(0.5), c(0.07)).alias("e"),
        *[
            fees.maker_rebate_rate(F.array(*[F.lit(x) for x in labels]).cast("array<string>"), F.lit(bps)).cast("double").alias(name)
            for name, labels, bps in [("r1", ["Crypto"], 30), ("r2", ["sports"], 30), ("r3", [], 0), ("r4", [], 35), ("r5", [], 700)]
        ],
    ).first()
    assert tuple(row)[:5] == (0.075, 0.00006, 0.0, 0.01875, 0.18)
    assert tuple(row)[5:] == (0.20, 0.25, 0.0, 0.0, 0.20)


def test_normal_cdf_is_exact(spark):
    from math import erf, sqrt

    zs = [-4.9, -3.0, -1.2345, -0.1, 0.0, 0.3, 2.0, 4.2]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(0.5 * (1 + erf(r.z / sqrt(2))), abs=1e-15)


def _candidates(spark, data):
    return spark.createDataFrame(data, "market string, side string, regime string, t bigint, predicted_edge double")


def test_persistent_entry(spark, rows):
    c = _candidates(spark, [("m", "up", "early", 5, 0.14), ("m", "up", "early", 10, 0.15), ("m", "up", "late", 65, 0.14)])
    pick = lambda **k: edge.first_persistent_entry(
        c, market="market", ts="t", side="side", passes=F.col("predicted_edge") >= 0.10, max_gap=5, width=20, **k
    )
    assert rows(pick(signals=2), "t") == [(10,)]
    assert rows(pick(signals=1), "t") == [(5,)]
    assert rows(pick(signals=3), "t") == []


def test_regime_thresholds_remove_rows_before_counting(spark, rows):
    c = _candidates(
        spark,
        [("m", "down", "early", 10, 0.11), ("m", "down", "early", 12, 0.12), ("m", "down", "mid", 65, 0.06), ("m", "down", "mid", 67, 0.07)],
    )
    limit = F.when(F.col("regime") == "early", 0.15).when(F.col("regime") == "mid", 0.05)
    out = edge.first_persistent_entry(
        c, market="market", ts="t", side="side", passes=F.col("predicted_edge") >= limit, signals=2, max_gap=5, width=20,
        drop_failing_first=True,
    )
    assert rows(out, "t") == [(67,)]


def gate_rows(spark):
    ms = 1_000_000
    return spark.createDataFrame(
        [
            (1, 0, "one", 0, 0, 0), (1, 1, "one", 0, 0, 0), (1, 2, "two", 20 * ms, 0, 20 * ms), (1, 3, "three", 10 * ms, 10 * ms, 10 * ms),
            (1, 4, "one", 11 * ms, 11 * ms, None),
        ],
        "user_id bigint, pos bigint, identifier string, available_ts bigint, source_ts bigint, receive_ts bigint",
    )


def test_quality_gate(spark, rows):
    out = quality.quality_gate(
        gate_rows(spark), keys=["user_id"], pos="pos", identifier="identifier", available="available_ts", source_ts="source_ts",
        receive_ts="receive_ts", width=2, max_delay_ns=10_000_000,
    )
    assert rows(out, "status", "epoch_id", "stale", order=["pos"]) == [
        ("accepted", 0, False), ("duplicate", 0, False), ("accepted", 0, True), ("out_of_order", 1, False), ("accepted", 1, False),
    ]


def test_quality_gate_forgets_old_identifiers_like_a_bounded_set(spark):
    """Against a direct replay, with a memory of three identifiers and frequent regressions."""
    import numpy as np

    rng = np.random.default_rng(5)
    n = 400
    data = [(int(k), i, f"h{rng.integers(0, 12)}", int(a), 0, 0) for i, (k, a) in enumerate(zip(rng.integers(0, 3, n), np.arange(n) - rng.integers(0, 6, n)))]
    df = spark.createDataFrame(data, "user_id bigint, pos bigint, identifier string, available_ts bigint, source_ts bigint, receive_ts bigint")
    got = quality.quality_gate(
        df, keys=["user_id"], pos="pos", identifier="identifier", available="available_ts", source_ts="source_ts",
        receive_ts="receive_ts", width=40, max_seen=3,
    ).select("pos", "status", "epoch_id").toPandas().set_index("pos")
    state = {}
    for k, pos, ident, a, _, _ in data:
        epoch, last, seen = state.get(k, (0, None, []))
        if ident in seen:
            want = "duplicate"
        elif last is not None and a < last:
            want, epoch, last, seen = "out_of_order", epoch + 1, None, []
        else:
            want, last, seen = "accepted", a, [*seen, ident][-3:]
        state[k] = (epoch, last, seen)
        assert (got.status[pos], got.epoch_id[pos]) == (want, epoch), pos


def test_top_of_book_chunks_equal_one_replay(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = []
    for e in range(200):
        if e % 60 == 0:
            data.append(("t", e, 0, 4, 0, 0.0, 0.0, e))
            continue
        side = int(rng.integers(1, 3))
        price = float(rng.integers(1, 40) if side == 1 else rng.integers(41, 80)) / 100
        size = float(rng.integers(0, 4))
        data.append(("t", e, 0, 2 if size else 3, side, price, size, e))
    df = spark.createDataFrame(data, "token string, event_index bigint, part int, action int, side int, price double, size double, ts_event bigint")
    got = books.top_of_book(df, token="token", events_per_chunk=9, keep=["ts_event"]).toPandas().set_index("event_index")
    book = {1: {}, 2: {}}
    seen = 0
    for _, e, _, action, side, price, size, _ in data:
        if action == 4:
            book = {1: {}, 2: {}}
        elif size:
            book[side][price] = size
        else:
            book[side].pop(price, None)
        if book[1] and book[2]:
            b, a = max(book[1]), min(book[2])
            assert tuple(got.loc[e, ["bid", "ask", "bid_size", "ask_size"]]) == (b, a, book[1][b], book[2][a])
            seen += 1
    assert seen == len(got)


