import math

import pytest
from helpers import at, bucket, values
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import contracts as X
from tidemark.operators import panel as P
from tidemark.operators import profiles as R
from tidemark.operators import windows as W

END = bucket(at("2026-04-23 12:00:00"))
LOOKBACK = 30
NAMES = ("a", "b", "c")


def market(spark):
    """Three venues; trades and quotes at chosen distances before END (and one of each outside)."""
    ticks = [
        ("a", 30, 10.0, 1.0, "buy"),
        ("a", 5, 12.0, 2.0, "sell"),
        ("a", 5, 13.0, 3.0, "b"),
        ("a", 1, 14.0, 1.0, None),
        ("b", 2, 20.0, 1.0, "s"),
        ("a", 31, 99.0, 9.0, "buy"),
        ("a", 0, 99.0, 9.0, "buy"),
    ]
    quotes = [
        ("a", 20, 9.0, 1.0, 11.0, 3.0),
        ("a", 10, 10.0, 2.0, 12.0, 2.0),
        ("b", 15, 19.0, 1.0, 21.0, 1.0),
        ("c", 3, 29.0, 1.0, 31.0, 1.0),
    ]
    tick_rows = [
        (exchange, "S", at("1970-01-01 00:00:00"), END - before, price, qty, seq, str(seq), side)
        for seq, (exchange, before, price, qty, side) in enumerate(ticks)
    ]
    t = spark.createDataFrame(
        tick_rows,
        "exchange string, symbol string, zero timestamp, s long, price double, qty double, seq long, trade_id string, side string",
    ).withColumn("ts_event", F.timestamp_micros(F.col("s") * 1_000_000 + 10 * F.col("seq")))
    q = spark.createDataFrame(
        [(e, "S", END - before, bp, bq, ap, aq, n) for n, (e, before, bp, bq, ap, aq) in enumerate(quotes)],
        "exchange string, symbol string, s long, bid_price double, bid_qty double, ask_price double, ask_qty double, seq long",
    ).withColumn("ts_event", F.timestamp_micros(F.col("s") * 1_000_000))
    return B.market_buckets(B.tick_buckets(B.clean_ticks(t)), B.quote_buckets(B.clean_quotes(q))), t, q


def windows(spark, ids=("e1",)):
    events = spark.createDataFrame([(i, "UP", END) for i in ids], "event_id string, direction string, event_start_bucket long")
    return W.event_windows(events, LOOKBACK)


@pytest.fixture(scope="module")
def panel(spark):
    return P.build_panel(market(spark)[0], windows(spark), LOOKBACK).cache()


def test_panel_is_dense_for_every_venue_seen(spark, panel):
    assert panel.count() == X.expected_panel_rows(1, 3, LOOKBACK)
    assert X.dense_violations(panel, LOOKBACK).count() == 0
    assert X.dense_violations(panel.filter("second_before_event <> 7"), LOOKBACK).count() == 3


def test_panel_fills_trades_with_zero_and_prices_not_at_all(panel):
    a = panel.filter("exchange = 'a'")
    assert values(a.filter("trade_count > 0"), "second_before_event", "trade_count", "trade_volume", "buy_qty", "sell_qty", "last_trade_price") == [
        (1, 1, 1.0, 0.0, 0.0, 14.0),
        (5, 2, 5.0, 3.0, 2.0, 13.0),
        (30, 1, 1.0, 1.0, 0.0, 10.0),
    ]
    assert a.filter("trade_count = 0 and (trade_volume <> 0 or last_trade_price is not null)").count() == 0


def test_panel_carries_quotes_forward_inside_the_window_only(panel):
    rows = {r.second_before_event: r for r in panel.filter("exchange = 'a'").collect()}
    assert [rows[s].last_mid_price for s in (30, 21, 20, 15, 10, 1)] == [None, None, 10.0, 10.0, 11.0, 11.0]
    assert [rows[s].bbo_quote_age_seconds for s in (30, 20, 15, 10, 1)] == [None, 0, 5, 0, 9]
    assert [(rows[s].has_bbo_update, rows[s].is_bbo_forward_filled) for s in (30, 20, 15)] == [(False, False), (True, False), (False, True)]
    # Averages of a bucket are not carried.
    assert [rows[s].avg_spread_bps is None for s in (20, 15)] == [False, True]


def test_forward_fill_is_per_column(spark):
    row = ("w", "e", "UP", END, "a", "S")
    names = [f"last_{n}" for n in B.QUOTE_LAST]
    frame = spark.createDataFrame(
        [(*row, END - 3, 1, 1.0, 2.0), (*row, END - 2, 1, None, 3.0), (*row, END - 1, 0, None, None)],
        "window_id string, event_id string, direction string, window_end_bucket long, exchange string, symbol string, "
        "bucket long, bbo_update_count long, last_bid_price double, last_ask_price double",
    )
    for name in (*names, "last_bbo_update_ts"):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast("double"))
    filled = P.panel_ffill(frame)
    assert values(filled, "bucket", "last_bid_price", "last_ask_price", "last_update_bucket") == [
        (END - 3, 1.0, 2.0, END - 3),
        (END - 2, 1.0, 3.0, END - 2),
        (END - 1, 1.0, 3.0, END - 2),
    ]


def test_windows_of_one_batch_do_not_mix(spark):
    both = P.build_panel(market(spark)[0], windows(spark, ("e1", "e2")), LOOKBACK)
    assert values(both.groupBy("window_id").agg(F.count("*").alias("n"), F.sum("trade_count").alias("t")), "window_id", "n", "t") == [
        ("e1", 90, 5),
        ("e2", 90, 5),
    ]


def test_raw_extraction_is_half_open_and_salting_changes_nothing(spark):
    _, ticks, _ = market(spark)
    for salts in (1, 8):
        found = W.extract_windows(B.clean_ticks(ticks), windows(spark), slice_seconds=7, salts=salts)
        assert sorted(round(r[0], 3) for r in found.select("seconds_before_event").collect()) == [1.0, 2.0, 5.0, 5.0, 30.0]


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_range_join_equals_nested_loops(spark, width):
    rows = spark.createDataFrame([(k % 3, k * 7 % 101 - 20) for k in range(60)], "key long, pos long")
    spans = spark.createDataFrame([(n, n % 3, n * 5 - 30, n * 5 - 30 + n % 4 * 6) for n in range(20)], "id long, key long, lo long, hi long")
    found = W.range_join_bucketed(rows, spans, position=F.col("pos"), start=F.col("lo"), end=F.col("hi"), width=width, on=["key"])
    expected = sorted(
        (s.id, r.pos) for s in spans.collect() for r in rows.collect() if s.key == r.key and s.lo <= r.pos < s.hi
    )
    assert values(found, "id", "pos") == expected


def test_profile_windows_overlap_and_tile():
    scaled = R.scaled_windows(10)
    assert [(w.first, w.last) for w in scaled] == [(1, 30), (1, 12), (1, 6), (1, 3), (1, 1), (13, 30), (7, 12), (4, 6), (2, 3), (1, 1)]
    tiles = sorted((w for w in R.PROFILE_WINDOWS if w.mode == "bucket"), key=lambda w: w.first)
    assert [w.first for w in tiles[1:]] == [w.last + 1 for w in tiles[:-1]] and tiles[-1].last == 300


def test_entity_profile(panel):
    profile = R.entity_profile(panel, R.scaled_windows(10))
    assert profile.count() == X.expected_profile_rows(1, 3)["entity"]
    rows = {(r.exchange, r.window_label): r for r in profile.collect()}
    whole = rows["a", "last_300s"]
    assert (whole.seconds_observed, whole.seconds_with_trades, whole.seconds_with_bbo_update, whole.seconds_forward_filled_bbo) == (30, 3, 2, 18)
    assert (whole.trade_count_sum, whole.trade_count_per_second_max, whole.buy_qty_sum, whole.sell_qty_sum) == (4, 2, 4.0, 2.0)
    assert whole.trade_imbalance_qty_ratio == pytest.approx(2 / 6)
    assert (whole.first_last_trade_price, whole.last_last_trade_price) == (10.0, 14.0)
    assert whole.last_trade_return_bps == pytest.approx(4000)
    # The first second of the shorter window has neither trade nor earlier quote of its own.
    short = rows["a", "last_120s"]
    assert (short.first_last_trade_price, short.last_trade_return_bps) == (None, None)
    assert (short.first_last_mid_price, short.last_last_mid_price) == (10.0, 11.0)
    assert whole.avg_spread_bps_mean == pytest.approx((2 / 10 + 2 / 11) / 2 * 1e4)
    assert whole.bbo_quote_age_seconds_max == 9
    assert rows["c", "last_300s"].trade_imbalance_qty_ratio is None


def test_pair_profile_follows_the_order_of_venues(panel):
    forward = R.pair_profile(panel, NAMES, R.scaled_windows(10))
    rows = {(r.exchange_pair, r.window_label): r for r in forward.collect()}
    ab = rows["a__b", "last_300s"]
    assert ab.seconds_compared == 15
    assert ab.last_mid_diff_bps == pytest.approx((11 - 20) / 20 * 1e4) and ab.last_abs_mid_diff_bps == -ab.last_mid_diff_bps
    assert ("a__b", "bucket_300_120s") in rows and ("a__c", "bucket_300_120s") not in rows
    backward = {r.exchange_pair for r in R.pair_profile(panel, tuple(reversed(NAMES)), R.scaled_windows(10)).collect()}
    assert backward == {"c__b", "c__a", "b__a"}


def test_bucket_change(panel):
    change = R.bucket_change(R.entity_profile(panel, R.scaled_windows(10)), R.scaled_windows(10))
    assert change.count() == X.expected_profile_rows(1, 3)["change"]
    rows = {(r.exchange, r.metric_name, r.to_bucket): r for r in change.collect()}
    trades = rows["a", "trade_count_per_second", "bucket_60_30s"]
    assert (trades.from_bucket, trades.from_bucket_value, trades.relative_change) == ("bucket_120_60s", 0.0, None)
    assert trades.absolute_change == pytest.approx(2 / 3)
    assert math.isclose(rows["a", "trade_count_per_second", "bucket_120_60s"].relative_change, -1.0)


def test_profiles_need_no_shuffle_beyond_the_panel(spark):
    plan = R.entity_profile(P.build_panel(market(spark)[0], windows(spark), LOOKBACK))
    text = plan._jdf.queryExecution().executedPlan().toString()
    after_panel = text.split("REPARTITION_BY_COL")[0]
    assert "Exchange" not in after_panel.replace("AdaptiveSparkPlan", "").rsplit("Exchange hashpartitioning(window_id", 1)[0]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
