"""Ticks, quotes and catalogs read from the driver's tables. Every row of a table is used.

* events -> ticks: venue = event type, price from value, quantity from props, side from user_id.
* events -> quotes: the same rows quoting the next venue in a ring, so that buckets with a trade and
  buckets with a quote differ. Prices are multiples of 1/128: their sums are exact in any order.
* lineitem -> ticks: venue = return flag, day-sized buckets.
* events -> catalog: a (date, venue, stream) exists if a row of it does; large values stand for quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VENUES = ("click", "error", "purchase", "signup", "view")
QUOTE_STREAM_VALUE = 150.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
        F.col("ts").alias("ts_event"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + k * F.lit(1000)).alias("ts_recv"),
        (F.lit(100.0) + F.floor(F.col("value") * 2) / F.lit(128.0)).alias("price"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelling = F.array(*[F.lit(word) for word in ("Buy", "SELL ", "b", "s", "unknown")])
    return _priced_events(spark, sf_dir).select(
        F.upper("event_type").alias("exchange"),
        F.lit("IDX").alias("symbol"),
        "ts_event",
        "ts_recv",
        "price",
        (F.col("k") + 1).cast("double").alias("qty"),
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("trade_id"),
        F.element_at(spelling, (F.pmod("user_id", F.lit(5)) + 1).cast("int")).alias("side"),
    )


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.create_map(
        *[F.lit(name) for pair in zip(VENUES, (*VENUES[1:], VENUES[0]), strict=True) for name in pair]
    )
    half = (F.pmod("k", F.lit(5)) + 1) / F.lit(128.0)
    return _priced_events(spark, sf_dir).select(
        F.upper(ring[F.col("event_type")]).alias("exchange"),
        F.lit("IDX").alias("symbol"),
        "ts_event",
        "ts_recv",
        (F.col("price") - half).alias("bid_price"),
        (F.pmod("k", F.lit(7)) + 1).cast("double").alias("bid_qty"),
        (F.col("price") + half).alias("ask_price"),
        (F.pmod("user_id", F.lit(5)) + 1).cast("double").alias("ask_qty"),
        F.col("event_id").alias("seq"),
    )


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks whose ids are the four keys that tell lineitem rows apart."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_returnflag").alias("exchange"),
        F.lit("LI").alias("symbol"),
        F.col("l_shipdate").alias("ts_event"),
        F.col("l_shipdate").alias("ts_recv"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.col("l_linestatus").alias("side"),
    )


def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stream = F.when(F.col("value") >= QUOTE_STREAM_VALUE, F.lit("bbo")).otherwise(F.lit("trade"))
    keyed = events.select(
        F.date_format("ts", "yyyyMMdd").alias("date"),
        F.col("event_type").alias("exchange"),
        stream.alias("stream"),
        F.lit("IDXUSD").alias("symbol"),
        "value",
    )
    # An entry whose largest value stays small counts as published but not available.
    found = keyed.groupBy("date", "exchange", "stream", "symbol").agg(F.max("value").alias("_peak"))
    root = F.concat_ws(
        "/",
        F.concat(F.lit("exchange="), "exchange"),
        F.concat(F.lit("stream="), "stream"),
        F.concat(F.lit("symbol="), "symbol"),
        F.concat(F.lit("date="), "date"),
    )
    return found.select(
        "date",
        "exchange",
        "stream",
        "symbol",
        (F.col("_peak") >= 60.0).alias("available"),
        F.concat(root, F.lit("/data.parquet")).alias("data_key"),
        F.concat(root, F.lit("/meta.json")).alias("meta_key"),
        F.concat(root, F.lit("/quality_day.json")).alias("quality_day_key"),
    )
