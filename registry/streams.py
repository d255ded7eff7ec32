"""Queries of the streaming operators: the driver's tables are delivered to a folder in slices, and drained from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registry.oracles import BASE, EVENT_COLUMNS, HOURLY_DETECTION
from registry.queries import BAR_COLUMNS, FINE_BUCKETS, TICK_COLUMNS, fresh_path, hourly_clusters, kinds, register
from registry.settings import FINE, HOURLY
from registry.workspace import Workspace
from tidemark.operators import bars, clusters
from tidemark.streaming import feeds, operators

SLICES = 4
DELAY = "1 day"
CLOSING = "~"  # venue of the row that closes a feed


def deliver(
    w: Workspace,
    rows: DataFrame,
    position: str | Column,
    name: str,
    made: Callable[[str], DataFrame],
    *,
    again: bool = False,
    closing: Callable[[int], dict[str, Column]] | None = None,
) -> DataFrame:
    """What the stream ``made`` of a feed gives when all rows are delivered in slices of ``position``, each drained before the next.

    With ``again`` each slice comes a second time with the next one. ``closing`` has the changes that make a last row,
    far ahead of the last position, which moves the watermark past everything before; it closes nothing of its own.
    """
    place = F.col(position) if isinstance(position, str) else position
    path, out, progress = (fresh_path(w, part) for part in (name, f"{name}_out", f"{name}_progress"))
    low, high = rows.agg(F.min(place), F.max(place)).first()
    edges = [low + (high + 1 - low) * i // SLICES for i in range(SLICES + 1)]
    for i in range(SLICES):
        feeds.publish(rows, path, place, [edges[max(0, i - 1)] if again else edges[i], edges[i + 1]])
        table = feeds.drain(made(path), out, progress)
    if closing is None:
        return table
    rows.limit(1).withColumns({"exchange": F.lit(CLOSING)} | closing(high)).write.mode("append").parquet(path)
    return feeds.drain(made(path), out, progress)


def far_ahead(position: str) -> Callable[[int], dict[str, Column]]:
    return lambda last: {position: F.lit(last + 10_000).cast("long")}


@register("dedupe_ticks_stream", TICK_COLUMNS, BASE, "raw_ticks")
def _(w):
    ticks = bars.clean_ticks(w.ticks)

    def made(path):
        return operators.dedupe_ticks_stream(feeds.read_feed(w.spark, path, ticks.schema), DELAY)

    return deliver(w, ticks, F.unix_micros("ts_event"), "ticks", made, again=True)


@register("ohlcv_bars_stream", BAR_COLUMNS, FINE_BUCKETS, "bars")
def _(w):
    ticks = bars.clean_ticks(w.ticks)

    def made(path):
        return operators.ohlcv_bars_stream(feeds.read_feed(w.spark, path, ticks.schema), FINE.bucket_seconds, DELAY)

    def closing(last):
        return {"ts_event": F.timestamp_micros(F.lit(last)) + F.expr("INTERVAL 30 DAYS")}

    return deliver(w, ticks, F.unix_micros("ts_event"), "ticks", made, closing=closing)


@register(
    "first_touch_stream",
    kinds(s="exchange symbol", i="start_bucket up_bucket down_bucket", d="base_price up_price down_price"),
    HOURLY_DETECTION,
    "touch",
)
def _(w):
    rows = w.hourly_bars

    def made(path):
        first, second = (feeds.read_feed(w.spark, path, rows.schema) for _ in range(2))
        return operators.first_touch_stream(
            first, second, HOURLY.threshold_pct, HOURLY.horizon, bucket_seconds=HOURLY.bucket_seconds, delay=DELAY
        )

    return deliver(w, rows, "bucket", "bars", made, closing=far_ahead("bucket"))


@register("cluster_chained_stream", EVENT_COLUMNS, hourly_clusters("ev"), "ev")
def _(w):
    rows = w.hourly_candidates.filter("not is_ambiguous")

    def made(path):
        stream = feeds.read_feed(w.spark, path, rows.schema)
        return operators.cluster_chained_stream(stream, HOURLY.horizon, bucket_seconds=HOURLY.bucket_seconds, delay=DELAY)

    table = deliver(w, rows, "start_bucket", "candidates", made, closing=far_ahead("start_bucket"))
    return clusters.number_clusters(table, bucket_seconds=HOURLY.bucket_seconds)
