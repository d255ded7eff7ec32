"""Streaming operators: equal to their batch counterparts however the feed is cut, late rows, restarts."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import at, values
from tidemark.operators import bars, clusters, moves
from tidemark.streaming import feeds, operators

TICK = "ts_event timestamp, exchange string, symbol string, price double, qty double, seq long, trade_id string"
BAR = "exchange string, symbol string, bucket long, high_price double, low_price double, close_price double"
CANDIDATE = (
    "exchange string, symbol string, direction string, is_ambiguous boolean, start_bucket long, end_bucket long, "
    "base_price double, touch_price double, move_pct double"
)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex}")


def deliver(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def tick(second, seq, exchange="a", price=100.0):
    return (at("2024-01-01T00:00:00").replace(minute=second // 60 % 60, hour=second // 3600, second=second % 60), exchange, "X", price, 1.0, seq, f"t{seq}")


def some_ticks(n=300, seed=1):
    rnd = random.Random(seed)
    return [tick(second, seq, rnd.choice("ab"), float(rnd.randint(90, 110))) for seq, second in enumerate(sorted(rnd.randint(0, 900) for _ in range(n)))]


CLOSING = tick(7200, 10**9, "~")


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_bars_do_not_depend_on_the_cut(spark, folder, files_per_batch):
    rows, feed = some_ticks(), folder("ticks")
    rnd = random.Random(2)
    for low in range(0, 900, 150):  # each delivery is shuffled, and holds rows of the one before
        part = [row for row in rows if low <= (row[0] - rows[0][0].replace(minute=0, second=0, hour=0)).total_seconds() < low + 150]
        deliver(spark, feed, rnd.sample(part, len(part)), TICK)
    deliver(spark, feed, [CLOSING], TICK)
    expected = spark.createDataFrame([row for row in rows if row[0] < tick(900, 0)[0]], TICK)
    stream = feeds.read_feed(spark, feed, expected.schema, files_per_batch)
    found = feeds.drain(operators.ohlcv_bars_stream(stream, 10, "1 minute"), folder("bars"), folder("checkpoint"))
    batch = bars.ohlcv_bars(expected, 10)
    assert values(found, *batch.columns) == values(batch, *batch.columns)


def test_late_ticks_are_left_out_and_bars_are_not_revised(spark, folder):
    feed = folder("ticks")
    deliver(spark, feed, [tick(5, 1), tick(300, 2)], TICK)
    deliver(spark, feed, [tick(299, 5)], TICK)  # closes the first bucket
    deliver(spark, feed, [tick(6, 3), tick(290, 4)], TICK)  # the first is 294 s behind, the second 10
    deliver(spark, feed, [CLOSING], TICK)
    stream = feeds.read_feed(spark, feed, spark.createDataFrame([], TICK).schema, 1)
    found = feeds.drain(operators.ohlcv_bars_stream(stream, 60, "30 seconds"), folder("bars"), folder("checkpoint"))
    first = int(tick(0, 0)[0].timestamp()) // 60
    assert values(found, "bucket", "trade_count") == [(first, 1), (first + 4, 2), (first + 5, 1)]


def test_a_restart_goes_on_where_the_stream_stopped(spark, folder):
    """Copies in one delivery, in the next, and after a restart are removed; nothing is written twice."""
    feed, out, checkpoint = folder("ticks"), folder("out"), folder("checkpoint")
    schema = spark.createDataFrame([], TICK).schema

    def run():
        return feeds.drain(operators.dedupe_ticks_stream(feeds.read_feed(spark, feed, schema, 1), "10 minutes"), out, checkpoint)

    keyless = (*tick(4, 0)[:5], None, "k")
    deliver(spark, feed, [tick(1, 1), tick(1, 1), tick(2, 2), keyless, keyless], TICK)
    deliver(spark, feed, [tick(2, 2), tick(3, 3), tick(3, 3, "b")], TICK)
    assert sorted(values(run(), "seq", "exchange"), key=str) == sorted([(1, "a"), (2, "a"), (3, "a"), (3, "b"), (None, "a"), (None, "a")], key=str)
    assert run().count() == 6
    deliver(spark, feed, [tick(1, 1), tick(3, 3, "b"), tick(5, 5)], TICK)
    assert sorted(r.seq for r in run().collect() if r.seq) == [1, 2, 3, 3, 5]


def some_bars(n=240, seed=5):
    rnd = random.Random(seed)
    rows = []
    for exchange in "ab":
        price = 100.0
        for bucket in range(1, n):  # time 0 is not later than the watermark that a stream begins with
            if rnd.random() < 0.8:
                price *= 1 + rnd.choice([-1, 1]) * rnd.random() / 100
                rows.append((exchange, "X", bucket, price * 1.004, price * 0.996, price))
    return sorted(rows, key=lambda row: row[2])


TOUCH = ["start_bucket", "exchange", "symbol", "base_price", "up_bucket", "up_price", "down_bucket", "down_price"]


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_first_touches_do_not_depend_on_the_cut(spark, folder, files_per_batch):
    rows, feed, rnd = some_bars(), folder("bars"), random.Random(3)
    for low in range(0, 240, 60):
        part = [row for row in rows if low <= row[2] < low + 60]
        deliver(spark, feed, rnd.sample(part, len(part)), BAR)
    deliver(spark, feed, [("~", "X", 10_000, 1.0, 1.0, 1.0)], BAR)
    batch = spark.createDataFrame(rows, BAR)
    first, second = (feeds.read_feed(spark, feed, batch.schema, files_per_batch) for _ in range(2))
    found = operators.first_touch_stream(first, second, 1.0, 7, bucket_seconds=60, delay="10 minutes")
    found = feeds.drain(found, folder("touch"), folder("checkpoint"))
    assert values(found, *TOUCH) == values(moves.first_touch(batch, 1.0, 7), *TOUCH)


def test_a_late_bar_touches_nothing(spark, folder):
    def bar(bucket, close, high):
        return ("a", "X", bucket, high, close, close)

    def run(*deliveries):
        feed = folder("bars")
        for rows in (*deliveries, [("~", "X", 10_000, 1.0, 1.0, 1.0)]):
            deliver(spark, feed, rows, BAR)
        schema = spark.createDataFrame([], BAR).schema
        first, second = (feeds.read_feed(spark, feed, schema, 1) for _ in range(2))
        touched = operators.first_touch_stream(first, second, 5.0, 3, bucket_seconds=60, delay="2 minutes")
        return values(feeds.drain(touched, folder("touch"), folder("checkpoint")), "start_bucket", "up_bucket", "up_price")

    base, touch, later = bar(10, 100.0, 100.0), bar(12, 100.0, 106.0), bar(40, 100.0, 100.0)
    assert run([base], [touch], [later]) == [(10, 12, 106.0)]
    assert run([base], [later], [bar(41, 100.0, 100.0)], [touch]) == []


CLUSTER = [
    "exchange", "symbol", "direction", "is_ambiguous", "event_start_bucket", "event_end_bucket", "base_price", "touch_price",
    "move_pct", "raw_candidate_count", "candidate_group_start_bucket", "candidate_group_end_bucket", "group_number", "event_id",
]


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_chained_clusters_do_not_depend_on_the_cut(spark, folder, files_per_batch):
    rnd = random.Random(8)
    starts = sorted({*rnd.sample(range(300), 60), 400, 406, 412, 419})  # 6 apart joins, 7 apart does not
    rows = [(rnd.choice(["A", "b"]), "X", rnd.choice(["UP", "DOWN"]), False, s, s + rnd.randint(1, 6), 100.0, 101.0, rnd.choice([1.0, -1.0, 2.0])) for s in starts]
    rows += [("c", "X", "UP", False, s, s + 1, 100.0, 101.0, 1.0) for s in (400, 406, 412, 419)]
    rows += [("c", "X", "AMBIGUOUS", True, s, s + 1, 100.0, None, None) for s in (400, 403)]
    feed = folder("candidates")
    for low in range(0, 500, 100):
        part = [row for row in rows if low <= row[4] < low + 100]
        deliver(spark, feed, rnd.sample(part, len(part)), CANDIDATE)
    deliver(spark, feed, [("~", "X", "UP", False, 10_000, 10_001, 1.0, 1.0, 1.0)], CANDIDATE)
    batch = spark.createDataFrame(rows, CANDIDATE)
    stream = feeds.read_feed(spark, feed, batch.schema, files_per_batch)
    found = feeds.drain(operators.cluster_chained_stream(stream, 6, bucket_seconds=60, delay="110 minutes"), folder("out"), folder("checkpoint"))
    events = clusters.number_clusters(found, bucket_seconds=60)
    expected = clusters.cluster_chained(batch, 6, bucket_seconds=60)
    assert values(events.filter("exchange <> '~'"), *CLUSTER) == values(expected, *CLUSTER)
    assert sorted(r.raw_candidate_count for r in events.filter("exchange = 'c'").collect()) == [1, 2, 3]


def test_streams_of_nothing(spark, folder):
    feed = folder("ticks")
    deliver(spark, feed, [], TICK)
    schema = spark.createDataFrame([], TICK).schema
    stream = operators.ohlcv_bars_stream(feeds.read_feed(spark, feed, schema), 10, "1 minute")
    assert feeds.drain(stream, folder("bars"), folder("checkpoint")).count() == 0


def test_ticks_to_touches_through_tables(spark, folder):
    """The bars a stream has closed are themselves a feed."""
    rows, feed, made = some_ticks(400, 9), folder("ticks"), folder("bars")
    deliver(spark, feed, rows, TICK)
    deliver(spark, feed, [CLOSING], TICK)
    batch = bars.ohlcv_bars(spark.createDataFrame(rows, TICK), 10)
    stream = feeds.read_feed(spark, feed, spark.createDataFrame([], TICK).schema, 1)
    closed = feeds.drain(operators.ohlcv_bars_stream(stream, 10, "1 minute"), made, folder("checkpoint"))
    far = closed.limit(1).withColumns({"exchange": F.lit("~"), "bucket": F.col("bucket") + 100_000})
    again = folder("feed")
    closed.coalesce(1).write.parquet(again)
    far.write.mode("append").parquet(again)
    first, second = (feeds.read_feed(spark, again, closed.schema, 1) for _ in range(2))
    found = operators.first_touch_stream(first, second, 4.0, 6, bucket_seconds=10, delay="1 hour")
    found = feeds.drain(found, folder("touch"), folder("checkpoint"))
    assert values(found, *TOUCH) == values(moves.first_touch(batch, 4.0, 6), *TOUCH)


def test_a_delivery_of_many_files_is_written_at_once_and_read_whole(spark, folder):
    rows, feed, out, checkpoint = some_ticks(), folder("ticks"), folder("bars"), folder("checkpoint")
    ticks = spark.createDataFrame(rows, TICK).repartition(8, "seq")  # each file reaches over the whole slice
    first = int(tick(0, 0)[0].timestamp())
    position = F.unix_seconds("ts_event")
    for low in range(first, first + 900, 300):
        before = len(ticks.sparkSession.read.parquet(feed).inputFiles()) if low > first else 0
        feeds.publish(ticks.filter(position < first + 900), feed, position, [low, low + 300])
        assert len(spark.read.parquet(feed).inputFiles()) - before > 1
        stream = feeds.read_feed(spark, feed, ticks.schema)
        feeds.drain(operators.ohlcv_bars_stream(stream, 10, "30 seconds"), out, checkpoint)
    feeds.publish(spark.createDataFrame([CLOSING], TICK), feed, position, [0, 2**40])
    found = feeds.drain(operators.ohlcv_bars_stream(feeds.read_feed(spark, feed, ticks.schema), 10, "30 seconds"), out, checkpoint)
    batch = bars.ohlcv_bars(ticks.filter(position < first + 900), 10)
    assert values(found, *batch.columns) == values(batch, *batch.columns)
