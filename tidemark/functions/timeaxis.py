"""The integer time axis.

Every operator works on ``bucket`` = floor(epoch microseconds / bucket width), a long. One-second
and one-hour studies are then the same code, and window edges are exact integers.
Timestamps are read in the session time zone, which is expected to be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000
DAY_SECONDS = 86_400

# Magnitude of the largest epoch value -> unit.
NANOSECOND_FLOOR = 1e17
MICROSECOND_FLOOR = 1e14
MILLISECOND_FLOOR = 1e11


def floor_div(numerator: Column, divisor: Column | int) -> Column:
    """Integer division rounding down, without a detour through doubles."""
    by = divisor if isinstance(divisor, Column) else F.lit(int(divisor)).cast("long")
    return F.call_function("div", numerator - F.pmod(numerator, by), by)


def bucket_index(ts: Column, bucket_seconds: float = 1) -> Column:
    return floor_div(F.unix_micros(ts), round(bucket_seconds * MICROS))


def bucket_start(bucket: Column, bucket_seconds: float = 1) -> Column:
    return F.timestamp_micros(bucket * F.lit(round(bucket_seconds * MICROS)).cast("long"))


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def bucket_date(bucket: Column, bucket_seconds: float = 1) -> Column:
    return date_key(bucket_start(bucket, bucket_seconds))


def buckets_per_day(bucket_seconds: float) -> int:
    per_day = DAY_SECONDS / bucket_seconds
    if per_day != int(per_day):
        raise ValueError("bucket_seconds must divide a day")
    return int(per_day)


def _integral_micros(value: Column, peak: Column) -> Column:
    return (
        F.when(peak >= NANOSECOND_FLOOR, floor_div(value, 1000))
        .when(peak >= MICROSECOND_FLOOR, value)
        .when(peak >= MILLISECOND_FLOOR, value * F.lit(1000).cast("long"))
        .otherwise(value * F.lit(MICROS).cast("long"))
    )


def _fractional_micros(value: Column, peak: Column) -> Column:
    factor = (
        F.when(peak >= NANOSECOND_FLOOR, F.lit(1e-3))
        .when(peak >= MICROSECOND_FLOOR, F.lit(1.0))
        .when(peak >= MILLISECOND_FLOOR, F.lit(1e3))
        .otherwise(F.lit(1e6))
    )
    return F.floor(value.cast("double") * factor).cast("long")


# Any value of the right magnitude selects the unit in the ladders above.
_UNIT_PEAK = {"ns": 1e18, "us": 1e15, "ms": 1e12, "s": 1e9}


def normalize_ts(df: DataFrame, column: str, out: str | None = None, unit: str = "auto") -> DataFrame:
    """Add ``out`` as a timestamp read from a timestamp, timestamp_ntz or numeric epoch column.

    ``unit="auto"`` infers s/ms/us/ns row by row from the magnitude, without a pass over the column. A
    file with one unit reads as it would by its largest value, as long as its times lie after 1973
    (seconds before that look like nothing else); a file with mixed units reads right as well.
    """
    out = out or column
    dtype = df.schema[column].dataType
    value = F.col(column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(out, value.cast("timestamp"))
    if not isinstance(dtype, T.NumericType):
        raise TypeError(f"{column} is {dtype.simpleString()}; expected a timestamp or a numeric epoch")
    if unit == "auto":
        peak = F.abs(value.cast("double"))
    elif unit in _UNIT_PEAK:
        peak = F.lit(_UNIT_PEAK[unit])
    else:
        raise ValueError(f"unknown epoch unit {unit!r}")
    if isinstance(dtype, T.IntegralType):
        micros = _integral_micros(value.cast("long"), peak)
    else:
        micros = _fractional_micros(value, peak)
    return df.withColumn(out, F.timestamp_micros(micros))


def window_dates(windows: DataFrame, start: str, end: str, out: str = "partition_date") -> DataFrame:
    """One row per UTC date key touched by each half-open window ``[start, end)``."""
    last = F.timestamp_micros(F.unix_micros(F.col(end)) - F.lit(1))
    days = F.sequence(F.to_date(F.col(start)), F.to_date(last), F.expr("interval 1 day"))
    return windows.filter(F.col(start) < F.col(end)).withColumn(out, F.explode(days)).withColumn(
        out, F.date_format(F.col(out), "yyyyMMdd")
    )
