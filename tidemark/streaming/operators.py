"""Bars, first touches, chained clusters and duplicate removal over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeaxis import MICROS, bucket_index, bucket_start, floor_div
from tidemark.operators.bars import BUCKET_KEYS, bar_aggregates
from tidemark.operators.clusters import CLUSTER_KEYS, chained_aggregates, with_keys
from tidemark.operators.moves import ENTITY, levels, touch_aggregates


def interval(micros: int) -> str:
    return f"{micros} microseconds"


def in_buckets(buckets: int, bucket_seconds: float) -> int:
    return buckets * round(bucket_seconds * MICROS)


def dedupe_ticks_stream(ticks: DataFrame, delay: str, keys: Sequence[str] = ("exchange", "symbol", "seq")) -> DataFrame:
    """Ticks without those whose ``keys`` came before within ``delay``; the keys are the state, kept for that long.

    Ticks that lack a key are no duplicates of each other and all pass. The result depends on no batch border: a
    copy is either found in the state or too late to count.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    timed = ticks.withWatermark("ts_event", delay)
    return timed.filter(known).dropDuplicatesWithinWatermark(list(keys)).unionByName(timed.filter(~known))


def ohlcv_bars_stream(ticks: DataFrame, bucket_seconds: float, delay: str) -> DataFrame:
    """Bars as ``ohlcv_bars`` makes them, each once the watermark has passed the end of its bucket.

    The state holds one partial bar per open bucket, venue and symbol, whatever the number of its ticks.
    """
    slot = F.window("ts_event", interval(round(bucket_seconds * MICROS)))
    bars = ticks.withWatermark("ts_event", delay).groupBy(slot.alias("_slot"), "exchange", "symbol").agg(*bar_aggregates())
    return bars.withColumn("bucket", bucket_index(F.col("_slot.start"), bucket_seconds)).select(
        *BUCKET_KEYS, "open_price", "high_price", "low_price", "close_price", "trade_count", "volume"
    )


def lookahead_stream(bars: DataFrame, future: DataFrame, horizon: int, bucket_seconds: float, delay: str, hit: Column) -> DataFrame:
    """Each base bar with the bars of its next ``horizon`` buckets that satisfy ``hit``: an interval join of two streams.

    The state is keyed by venue, symbol and horizon-wide block, so one venue spreads over many tasks; a base
    bar lies in two blocks. Both sides are given up when the watermark is a horizon past them.
    """
    block = floor_div(F.col("bucket"), horizon)
    base = (
        bars.select(
            *ENTITY,
            F.explode(F.array(block, block + 1)).alias("block"),
            F.col("bucket").alias("start_bucket"),
            F.col("close_price").alias("base_price"),
            bucket_start(F.col("bucket"), bucket_seconds).alias("start_ts"),
        )
        .withWatermark("start_ts", delay)
        .alias("base")
    )
    ahead = (
        future.select(
            *[F.col(name).alias(f"ahead_{name}") for name in ENTITY],
            block.alias("ahead_block"),
            F.col("bucket").alias("touch_bucket"),
            "high_price",
            "low_price",
            bucket_start(F.col("bucket"), bucket_seconds).alias("touch_ts"),
        )
        .withWatermark("touch_ts", delay)
        .alias("ahead")
    )
    same = F.col("block") == F.col("ahead_block")
    for name in ENTITY:
        same = same & (F.col(name) == F.col(f"ahead_{name}"))
    reach = F.expr(f"touch_ts > start_ts AND touch_ts <= start_ts + INTERVAL {in_buckets(horizon, bucket_seconds)} MICROSECONDS")
    return base.join(ahead, same & reach & hit)


def first_touch_stream(bars: DataFrame, future: DataFrame, threshold_pct: float, horizon: int, *, bucket_seconds: float, delay: str) -> DataFrame:
    """First touches as ``first_touch`` finds them, each once the watermark is a horizon past its base bar.

    ``bars`` and ``future`` are two streams of the same bars, complete ones as ``ohlcv_bars_stream`` emits them.
    """
    up_level, down_level = levels(threshold_pct)
    up, down = F.col("high_price") >= up_level, F.col("low_price") <= down_level
    hits = lookahead_stream(bars, future, horizon, bucket_seconds, delay, up | down)
    touched = hits.groupBy("start_ts", "start_bucket", *ENTITY).agg(*touch_aggregates(up, down))
    return touched.drop("start_ts")


def cluster_chained_stream(candidates: DataFrame, horizon: int, *, bucket_seconds: float, delay: str) -> DataFrame:
    """Clusters as ``cluster_chained`` chains them, each once the watermark is a horizon past its last start.

    A session holds starts at most ``horizon`` apart, exactly that included. Events are numbered over all clusters
    of a date, so that is left to ``number_clusters``, on the table of clusters that this stream writes.
    """
    timed = with_keys(candidates).withColumn("start_ts", bucket_start(F.col("start_bucket"), bucket_seconds))
    # Starts lie on bucket borders; a microsecond more than the horizon takes in its end and nothing else.
    gap = F.session_window("start_ts", interval(in_buckets(horizon, bucket_seconds) + 1))
    chained = timed.withWatermark("start_ts", delay).groupBy(gap.alias("_session"), *CLUSTER_KEYS).agg(*chained_aggregates())
    return chained.drop("_session")
