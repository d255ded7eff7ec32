"""Dense panels: every bucket of every window for every venue and symbol seen in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timeaxis import bucket_start, floor_div
from tidemark.operators.bars import QUOTE_AVERAGES, QUOTE_LAST, TRADE_PRICES, TRADE_SUMS
from tidemark.operators.windows import range_join_bucketed

CARRIED = ("last_bbo_update_ts", *[f"last_{name}" for name in QUOTE_LAST])
PANEL_KEYS = ("window_id", "exchange", "symbol")
PANEL_PRICES = tuple(name for name in TRADE_PRICES if name != "open_price")


def in_spans_of(market: DataFrame, windows: DataFrame, span_buckets: int) -> DataFrame:
    """Buckets of the spans that windows touch. Where the table is laid out by ``span``, no file of another span is read.

    The list of spans is broadcast, which pruning needs: one number for each day on the axis at most.
    """
    span = F.lit(span_buckets).cast("long")
    start, end = F.col("window_start_bucket"), F.col("window_end_bucket")
    touched = windows.filter(start < end).select(F.explode(F.sequence(floor_div(start, span), floor_div(end - 1, span))).alias("span"))
    return market.join(F.broadcast(touched.distinct()), "span", "left_semi").drop("span")


def window_buckets(
    market: DataFrame, windows: DataFrame, lookback: int, *, salts: int = 8, span_buckets: int | None = None
) -> DataFrame:
    """Market buckets inside each window: the sparse form of the panel.

    A market-wide burst puts all windows and symbols into one slice of time, hence the salt over venue and symbol.
    ``span_buckets`` tells how wide the spans are that the column ``span`` of the market table counts, if it has one.
    """
    selected = windows.select("window_id", "event_id", "direction", "window_start_bucket", "window_end_bucket")
    if span_buckets is not None and "span" in market.columns:
        market = in_spans_of(market, selected, span_buckets)
    return range_join_bucketed(
        market,
        selected,
        position=F.col("bucket"),
        start=F.col("window_start_bucket"),
        end=F.col("window_end_bucket"),
        width=lookback,
        salts=salts,
        salt_by=("exchange", "symbol"),
    )


def panel_ffill(sparse: DataFrame) -> DataFrame:
    """Carry every quote column forward on its own, over rows of the same window, venue and symbol."""
    upto = Window.partitionBy(*PANEL_KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    updated_at = F.when(F.col("bbo_update_count") > 0, F.col("bucket"))
    carried = {name: F.last(name, ignorenulls=True).over(upto) for name in CARRIED}
    return sparse.withColumn("last_update_bucket", F.last(updated_at, ignorenulls=True).over(upto)).withColumns(carried)


def densify(sparse: DataFrame) -> DataFrame:
    """Fill the gaps of each (window, venue, symbol) so that every bucket of the window has a row.

    Each present row emits itself and the empty buckets up to the next one; the first also emits the
    buckets before it. Sorting the sparse rows is enough, no grid is joined.
    """
    order = Window.partitionBy(*PANEL_KEYS).orderBy("bucket")
    until = F.coalesce(F.lead("bucket").over(order), F.col("window_end_bucket"))
    since = F.when(F.lag("bucket").over(order).isNull(), F.col("window_start_bucket")).otherwise(F.col("bucket"))
    filled = sparse.withColumns({"_since": since, "_until": until}).withColumn(
        "_at", F.explode(F.sequence("_since", F.col("_until") - 1))
    )
    present = F.col("_at") == F.col("bucket")
    known = F.col("_at") >= F.col("bucket")

    def zero_fill(name: str) -> Column:
        kind = sparse.schema[name].dataType
        return F.when(present, F.coalesce(F.col(name), F.lit(0).cast(kind))).otherwise(F.lit(0).cast(kind)).alias(name)

    return filled.select(
        "window_id",
        "event_id",
        "direction",
        "exchange",
        "symbol",
        F.col("_at").alias("bucket"),
        "window_end_bucket",
        *[zero_fill(name) for name in (*TRADE_SUMS, "bbo_update_count")],
        *[F.when(present, F.col(name)).alias(name) for name in (*PANEL_PRICES, *QUOTE_AVERAGES)],
        *[F.when(known, F.col(name)).alias(name) for name in (*CARRIED, "last_update_bucket")],
    )


def build_panel(
    market: DataFrame, windows: DataFrame, lookback: int, *, bucket_seconds: float = 1, span_buckets: int | None = None
) -> DataFrame:
    """The dense panel: trade sums 0 where nothing traded, quotes carried forward inside the window.

    Rows are placed by ``window_id`` alone. A window has at most lookback x entities rows, and the
    forward fill, both profiles and the pair profile then need no further shuffle.
    """
    sparse = window_buckets(market, windows, lookback, span_buckets=span_buckets).repartition("window_id")
    dense = densify(panel_ffill(sparse))
    updated = F.col("bbo_update_count") > 0
    age = (F.col("bucket") - F.col("last_update_bucket")) * F.lit(bucket_seconds)
    return dense.withColumns(
        {
            "second_before_event": (F.col("window_end_bucket") - F.col("bucket")).cast("int"),
            "ts_second": bucket_start(F.col("bucket"), bucket_seconds),
            "has_bbo_update": updated,
            "is_bbo_forward_filled": ~updated & F.col("last_update_bucket").isNotNull(),
            "bbo_quote_age_seconds": age.cast("long"),
        }
    ).drop("last_update_bucket", "window_end_bucket")
