"""The partition catalog: which (date, exchange, stream, symbol) files exist."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: nesting of the manifest document, innermost first.
ENTRY_TYPE = "struct<available:boolean, artifacts:map<string,string>>"
for _level in ("symbols", "streams", "exchanges"):
    ENTRY_TYPE = f"struct<{_level}:map<string,{ENTRY_TYPE}>>"
MANIFEST_TYPE = f"struct<schema_version:int, updated_at:string, dates:map<string,{ENTRY_TYPE}>>"
# Fixed value: layout of a partition path.
PATH_PATTERN = r"(?:^|/)exchange=([^/]+)/stream=([^/]+)/symbol=([^/]+)/date=([^/]+)(?:/|$)"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Partition rows of a JSON manifest; an empty or invalid document raises when rows are read."""
    text = spark.read.text(path, wholetext=True)
    body = F.col("value")
    parsed = F.from_json(body, MANIFEST_TYPE)
    checked = (
        F.when(F.trim(body) == "", F.raise_error(F.lit("manifest is empty")))
        .when(
            parsed.isNull() | (F.json_object_keys(body).isNull()), F.raise_error(F.lit("manifest is not valid JSON"))
        )
        .otherwise(F.lit(True))
    )
    by_date = text.select(parsed.alias("doc"), checked.alias("ok")).filter("ok").select(F.explode("doc.dates"))
    by_exchange = by_date.select(F.col("key").alias("date"), F.explode("value.exchanges"))
    by_stream = by_exchange.select("date", F.col("key").alias("exchange"), F.explode("value.streams"))
    by_symbol = by_stream.select("date", "exchange", F.col("key").alias("stream"), F.explode("value.symbols"))
    return by_symbol.select(
        "date",
        "exchange",
        "stream",
        F.col("key").alias("symbol"),
        F.col("value.available").alias("available"),
        F.col("value.artifacts")["data_key"].alias("data_key"),
        F.col("value.artifacts")["meta_key"].alias("meta_key"),
        F.col("value.artifacts")["quality_day_key"].alias("quality_day_key"),
    )


def partition_fields(path: Column) -> dict[str, Column]:
    """exchange / stream / symbol / date found in a partition path, null where the path does not match."""
    names = ("exchange", "stream", "symbol", "date")
    return {
        name: F.nullif(F.regexp_extract(path, PATH_PATTERN, group), F.lit(""))
        for group, name in enumerate(names, start=1)
    }


def partition_from_path(paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path follows the partition layout, with its fields as columns."""
    fields = partition_fields(F.col(column))
    return paths.select(F.col(column), *[field.alias(name) for name, field in fields.items()]).filter(
        F.col("date").isNotNull()
    )


def select_partitions(
    catalog: DataFrame,
    *,
    exchanges: Iterable[str],
    streams: Iterable[str] = ("trade",),
    symbol_family: str = "",
    dates: Iterable[str] | None = None,
    first_date: str | None = None,
    last_date: str | None = None,
) -> DataFrame:
    """Available partitions of the wanted venues, streams, symbol family and dates."""
    wanted = (
        F.coalesce(F.col("available"), F.lit(True))
        & F.lower("exchange").isin(*[name.lower() for name in exchanges])
        & F.lower("stream").isin(*[name.lower() for name in streams])
        & F.lower("symbol").contains(symbol_family.lower())
        & F.col("date").isNotNull()
    )
    if dates is not None:
        wanted = wanted & F.col("date").isin(*list(dates))
    if first_date is not None:
        wanted = wanted & (F.col("date") >= first_date)
    if last_date is not None:
        wanted = wanted & (F.col("date") <= last_date)
    return catalog.filter(wanted)


def catalog_dates(partitions: DataFrame) -> DataFrame:
    """Distinct dates of the given partitions."""
    return partitions.select("date").distinct()


def requested_dates(partitions: DataFrame, first: str = "auto", last: str = "auto") -> DataFrame:
    """Every day from ``first`` to ``last``; ``auto`` takes the ends of the partitions' own dates."""
    ends = partitions.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo = F.col("lo") if first == "auto" else F.lit(first)
    hi = F.col("hi") if last == "auto" else F.lit(last)
    last_day = F.when(hi < lo, F.raise_error(F.lit("last date is before first date"))).otherwise(hi)
    days = F.sequence(F.to_date(lo, "yyyyMMdd"), F.to_date(last_day, "yyyyMMdd"), F.expr("interval 1 day"))
    return ends.select(F.explode(days).alias("day")).select(F.date_format("day", "yyyyMMdd").alias("date"))
