"""Rows inside half-open time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeaxis import MICROS, bucket_start, floor_div, window_dates


def event_windows(events: DataFrame, lookback: int, *, bucket_seconds: float = 1) -> DataFrame:
    """One window ``[start - lookback, start)`` per event, keyed by ``window_id``."""
    return _with_window_times(
        events.select(
            F.col("event_id").alias("window_id"),
            "event_id",
            "direction",
            F.col("event_start_bucket").alias("window_end_bucket"),
        ),
        lookback,
        bucket_seconds,
    )


def control_windows(controls: DataFrame, lookback: int, *, bucket_seconds: float = 1) -> DataFrame:
    """One window per control sample; ``event_id`` is the event it is matched to."""
    return _with_window_times(
        controls.select(
            F.col("sample_id").alias("window_id"),
            "event_id",
            F.lit(None).cast("string").alias("direction"),
            F.col("anchor_bucket").alias("window_end_bucket"),
        ),
        lookback,
        bucket_seconds,
    )


def _with_window_times(windows: DataFrame, lookback: int, bucket_seconds: float) -> DataFrame:
    start = F.col("window_end_bucket") - F.lit(lookback)
    return windows.withColumns(
        {
            "window_start_bucket": start,
            "window_start_ts": bucket_start(start, bucket_seconds),
            "window_end_ts": bucket_start(F.col("window_end_bucket"), bucket_seconds),
        }
    )


def window_filter(rows: DataFrame, ts: str, start: str, end: str, out: str = "seconds_before_event") -> DataFrame:
    """Keep rows with ``start <= ts < end`` and add the distance to ``end`` in seconds."""
    distance = (F.unix_micros(F.col(end)) - F.unix_micros(F.col(ts))) / F.lit(float(MICROS))
    return rows.filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).withColumn(out, distance)


def range_join_bucketed(
    rows: DataFrame,
    windows: DataFrame,
    *,
    position: Column,
    start: Column,
    end: Column,
    width: int,
    on: Sequence[str] = (),
    salts: int = 1,
    salt_by: Sequence[str] = (),
) -> DataFrame:
    """Inner interval join ``start <= position < end`` on integers, as an equi-join on slices of the axis.

    Windows are copied to every slice they touch and rows go to their one slice, so Spark hashes
    instead of nesting loops, and picks broadcast or shuffle from the size of ``windows``. ``salts``
    > 1 splits each slice by a hash of ``salt_by``, for a slice that holds a large share of all rows.
    """
    axis = F.lit(int(width)).cast("long")
    slices = F.sequence(floor_div(start, axis), floor_div(end - 1, axis))
    placed = windows.filter(start < end).withColumn("_slice", F.explode(slices))
    keyed = rows.withColumns({"_slice": floor_div(position, axis), "_position": position})
    keys = ["_slice", *on]
    if salts > 1:
        placed = placed.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        hashed = F.pmod(F.xxhash64(*[F.col(name) for name in salt_by or rows.columns]), F.lit(salts))
        keyed = keyed.withColumn("_salt", hashed.cast("int"))
        keys.append("_salt")
    joined = keyed.join(placed, keys).filter((F.col("_position") >= start) & (F.col("_position") < end))
    return joined.drop("_slice", "_salt", "_position")


def extract_windows(
    rows: DataFrame,
    windows: DataFrame,
    *,
    slice_seconds: float,
    ts: str = "ts_event",
    salts: int = 8,
    date_column: str | None = None,
) -> DataFrame:
    """Raw ticks or quotes inside each window, with the window's fields and the offset to its end.

    A burst can put much of the data into one slice of time, hence the salt over the row itself. If
    the rows are partitioned by a date key, name it: only the dates the windows touch are then read.
    """
    selected = windows.select(
        "window_id", "event_id", F.col("direction").alias("event_direction"), "window_start_ts", "window_end_ts"
    )
    if date_column is not None:
        touched = window_dates(windows, "window_start_ts", "window_end_ts", out=date_column)
        rows = rows.join(touched.select(date_column).distinct(), date_column, "left_semi")
    joined = range_join_bucketed(
        rows,
        selected,
        position=F.unix_micros(F.col(ts)),
        start=F.unix_micros("window_start_ts"),
        end=F.unix_micros("window_end_ts"),
        width=round(slice_seconds * MICROS),
        salts=salts,
        salt_by=[name for name in ("exchange", "symbol", ts, "seq") if name in rows.columns],
    )
    return window_filter(joined, ts, "window_start_ts", "window_end_ts")
