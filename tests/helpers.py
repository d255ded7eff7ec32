"""Small literal tables."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def bucket(moment: datetime, seconds: int = 1) -> int:
    return int((moment - EPOCH) / timedelta(seconds=1)) // seconds


def candidates(spark, rows):
    """Rows of (exchange, symbol, direction, start_bucket, end_bucket, base, touch, move[, ambiguous])."""
    full = [row if len(row) == 9 else (*row, False) for row in rows]
    schema = (
        "exchange string, symbol string, direction string, start_bucket long, end_bucket long, base_price double, "
        "touch_price double, move_pct double, is_ambiguous boolean"
    )
    return spark.createDataFrame(full, schema)


def starts_of(spark, offsets, origin=0, exchange="binance", symbol="BTCUSDT", direction="UP"):
    rows = [(exchange, symbol, direction, origin + o, origin + o + 5, 100.0, 101.0, 1.0) for o in offsets]
    return candidates(spark, rows)


def bars(spark, rows):
    """Rows of (exchange, bucket, high, low, close)."""
    rows = [(exchange, at_, float(high), float(low), float(close)) for exchange, at_, high, low, close in rows]
    frame = spark.createDataFrame(rows, "exchange string, bucket long, high_price double, low_price double, close_price double")
    return frame.withColumn("symbol", F.lit("X"))


def values(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr if not columns else lambda row: tuple((v is not None, v) for v in row))
