import datetime as dt

import pytest
from helpers import at, values
from pyspark.sql import functions as F

from tidemark.functions import measures
from tidemark.functions.timeaxis import bucket_index, normalize_ts, window_dates
from tidemark.operators import bars as B


@pytest.mark.parametrize(
    ("epoch", "kind"),
    [
        (1_776_902_400, "long"),
        (1_776_902_400, "int"),
        (1_776_902_400_000, "long"),
        (1_776_902_400_000_000, "long"),
        (1_776_902_400_000_000_000, "long"),
        (1_776_902_400.0, "double"),
        (1_776_902_400_000.0, "double"),
    ],
)
def test_normalize_ts_infers_the_epoch_unit(spark, epoch, kind):
    frame = spark.createDataFrame([(epoch,)], f"t {kind}")
    assert normalize_ts(frame, "t").select(F.unix_micros("t")).first()[0] == 1_776_902_400_000_000


def test_normalize_ts_reads_mixed_units_row_by_row(spark):
    rows = [(1_776_902_400,), (1_776_902_400_000,), (1_776_902_400_000_000,), (1_776_902_400_000_000_000,)]
    frame = spark.createDataFrame(rows, "t long")
    assert {r.m for r in normalize_ts(frame, "t").select(F.unix_micros("t").alias("m")).collect()} == {1_776_902_400_000_000}
    named = normalize_ts(spark.createDataFrame([(5000,)], "t long"), "t", unit="us")
    assert named.select(F.unix_micros("t")).first()[0] == 5000


def test_normalize_ts_reads_ntz_as_utc_and_rejects_text(spark):
    ntz = spark.sql("select timestamp_ntz'2026-04-23 00:00:00' as t")
    assert normalize_ts(ntz, "t").select(F.unix_seconds("t")).first()[0] == 1_776_902_400
    with pytest.raises(TypeError):
        normalize_ts(spark.createDataFrame([("x",)], "t string"), "t")


def test_bucket_index_floors_before_the_epoch_too(spark):
    frame = spark.createDataFrame([(-1,), (0,), (999_999,), (1_000_000,)], "m long")
    found = frame.select("m", bucket_index(F.timestamp_micros("m"), 1).alias("b"))
    assert values(found, "m", "b") == [(-1, -1), (0, 0), (999_999, 0), (1_000_000, 1)]


def test_window_dates_excludes_the_end(spark):
    frame = spark.createDataFrame(
        [(1, at("2026-04-22 23:58:00"), at("2026-04-23 00:03:00")), (2, at("2026-04-22 23:55:00"), at("2026-04-23 00:00:00"))],
        "id int, a timestamp, b timestamp",
    )
    assert values(window_dates(frame, "a", "b"), "id", "partition_date") == [(1, "20260422"), (1, "20260423"), (2, "20260422")]


def test_side_spellings(spark):
    frame = spark.createDataFrame([("BUY",), ("b",), (" Sell",), ("s",), ("unknown",), (None,)], "side string")
    assert [row[0] for row in frame.select(measures.side_of(F.col("side"))).collect()] == ["buy", "buy", "sell", "sell", None, None]


def test_quote_metrics_and_their_zero_denominators(spark):
    frame = spark.createDataFrame(
        [(100.0, 3.0, 101.0, 1.0), (-1.0, 0.0, 1.0, 0.0)], "bid_price double, bid_qty double, ask_price double, ask_qty double"
    )
    rows = B.quote_metrics(frame).collect()
    assert (rows[0].mid_price, rows[0].spread, rows[0].book_imbalance) == (100.5, 1.0, 0.5)
    assert rows[0].spread_bps == pytest.approx(99.50248756218905)
    assert (rows[1].mid_price, rows[1].spread, rows[1].spread_bps, rows[1].book_imbalance) == (0.0, 2.0, None, None)


def test_bps_math(spark):
    frame = spark.createDataFrame([(100.0, 101.0, -2.0, 1.0, 0.0)], "a double, b double, c double, d double, z double")
    row = frame.select(
        measures.return_bps(F.col("a"), F.col("b")),
        measures.diff_bps(F.col("b"), F.col("a")),
        measures.relative_change(F.col("c"), F.col("d")),
        measures.relative_change(F.col("z"), F.col("d")),
        measures.z_score(F.lit(12.0), F.lit(10.0), F.lit(2.0)),
        measures.z_score(F.lit(12.0), F.lit(10.0), F.lit(0.0)),
        measures.ratio(F.col("a"), F.col("z")),
    ).first()
    assert row[0] == pytest.approx(100) and row[1] == pytest.approx(100)
    assert tuple(row[2:]) == (1.5, None, 1.0, None, None)


def ticks(spark, rows):
    return spark.createDataFrame(
        rows, "exchange string, symbol string, ts_event timestamp, price string, qty double, seq long, trade_id string, side string"
    )


def test_clean_ticks_drops_unusable_rows(spark):
    t = at("2026-04-23 00:00:00")
    rows = [
        ("A", "S", t, "1.5", 1.0, 1, "1", None),
        (None, "S", t, "1", 1.0, 1, "1", None),
        ("a", None, t, "1", 1.0, 1, "1", None),
        ("a", "S", None, "1", 1.0, 1, "1", None),
        ("a", "S", t, "0", 1.0, 1, "1", None),
        ("a", "S", t, "x", 1.0, 1, "1", None),
        ("a", "S", t, "1", None, 1, "1", None),
    ]
    assert values(B.clean_ticks(ticks(spark, rows)), "exchange", "price") == [("a", 1.5)]
    assert values(B.clean_ticks(ticks(spark, rows), positive_price=False), "exchange", "price") == [("a", 0.0), ("a", 1.5)]


def test_clean_ticks_needs_its_columns(spark):
    with pytest.raises(ValueError, match="qty"):
        B.clean_ticks(spark.createDataFrame([("a", "S", at("2026-01-01"), 1.0)], "exchange string, symbol string, ts_event timestamp, price double"))


def test_open_and_close_break_ties_with_nulls_last(spark):
    t = at("2026-04-23 00:00:00")
    rows = [
        ("a", "S", t, "10", 1.0, None, "1", None),
        ("a", "S", t, "11", 1.0, 5, "2", None),
        ("a", "S", t, "12", 1.0, 5, None, None),
        ("a", "S", t, "13", 1.0, 7, "0", None),
    ]
    bar = B.ohlcv_bars(B.clean_ticks(ticks(spark, rows))).first()
    # Ascending nulls last: (5, "2") opens. Descending nulls last: (7, "0") closes.
    assert (bar.open_price, bar.high_price, bar.low_price, bar.close_price, bar.trade_count, bar.volume) == (11, 13, 10, 13, 4, 4)


def test_bars_from_buckets_equal_bars(spark):
    t = at("2026-04-23 00:00:00")
    rows = [("a", "S", t + dt.timedelta(seconds=i % 7, microseconds=i), str(100 + i % 5), float(i % 3 + 1), i, str(i), "b") for i in range(200)]
    clean = B.clean_ticks(ticks(spark, rows))
    columns = ("bucket", "open_price", "high_price", "low_price", "close_price", "trade_count", "volume")
    assert values(B.bars_from_buckets(B.tick_buckets(clean, 2)), *columns) == values(B.ohlcv_bars(clean, 2), *columns)
