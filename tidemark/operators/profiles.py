"""Window profiles of panels: per venue, per venue pair, and changes between sub-windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import measures
from tidemark.functions.exact import exact_avg, exact_sum
from tidemark.functions.taxonomy import CHANGE_METRICS


@dataclass(frozen=True)
class ProfileWindow:
    label: str
    mode: str
    first: int
    last: int


# Offsets before the event (1 = closest) of the trailing windows and the tiles.
PROFILE_WINDOWS = (
    ProfileWindow("last_300s", "trailing", 1, 300),
    ProfileWindow("last_120s", "trailing", 1, 120),
    ProfileWindow("last_60s", "trailing", 1, 60),
    ProfileWindow("last_30s", "trailing", 1, 30),
    ProfileWindow("last_10s", "trailing", 1, 10),
    ProfileWindow("bucket_300_120s", "bucket", 121, 300),
    ProfileWindow("bucket_120_60s", "bucket", 61, 120),
    ProfileWindow("bucket_60_30s", "bucket", 31, 60),
    ProfileWindow("bucket_30_10s", "bucket", 11, 30),
    ProfileWindow("bucket_10_0s", "bucket", 1, 10),
)


def scaled_windows(divisor: int) -> tuple[ProfileWindow, ...]:
    """The same ten windows over a lookback of 300 / ``divisor`` buckets, labels kept."""
    return tuple(
        ProfileWindow(w.label, w.mode, (w.first - 1) // divisor + 1, w.last // divisor) for w in PROFILE_WINDOWS
    )


OWNER = ("window_id", "event_id", "direction")


def _in_windows(panel: DataFrame, windows: Sequence[ProfileWindow]) -> DataFrame:
    """Each panel row once per profile window holding its offset; the window list is a constant."""
    offset = F.col("second_before_event")
    choices = F.array(
        *[
            F.when(
                offset.between(w.first, w.last), F.struct(F.lit(w.mode).alias("mode"), F.lit(w.label).alias("label"))
            )
            for w in windows
        ]
    )
    placed = panel.withColumn("_window", F.explode(F.array_compact(choices)))
    return placed.withColumns({"window_mode": F.col("_window.mode"), "window_label": F.col("_window.label")}).drop(
        "_window"
    )


def entity_profile(panel: DataFrame, windows: Sequence[ProfileWindow] = PROFILE_WINDOWS) -> DataFrame:
    """Activity, returns, spread and book measures per venue, symbol and profile window."""
    offset = F.col("second_before_event")

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    measured = (
        _in_windows(panel, windows)
        .groupBy(*OWNER, "exchange", "symbol", "window_mode", "window_label")
        .agg(
            F.count(F.lit(1)).alias("seconds_observed"),
            count(F.col("trade_count") > 0).alias("seconds_with_trades"),
            count(F.col("bbo_update_count") > 0).alias("seconds_with_bbo_update"),
            count(F.col("is_bbo_forward_filled")).alias("seconds_forward_filled_bbo"),
            F.sum("trade_count").alias("trade_count_sum"),
            F.avg("trade_count").alias("trade_count_per_second_avg"),
            F.max("trade_count").alias("trade_count_per_second_max"),
            exact_sum("trade_volume").alias("trade_volume_sum"),
            exact_sum("trade_notional").alias("trade_notional_sum"),
            exact_sum("buy_qty").alias("buy_qty_sum"),
            exact_sum("sell_qty").alias("sell_qty_sum"),
            exact_sum("trade_imbalance_qty").alias("trade_imbalance_qty_sum"),
            exact_avg("trade_imbalance_qty").alias("trade_imbalance_qty_per_second"),
            F.max_by("last_trade_price", offset).alias("first_last_trade_price"),
            F.min_by("last_trade_price", offset).alias("last_last_trade_price"),
            F.min("last_trade_price").alias("min_last_trade_price"),
            F.max("last_trade_price").alias("max_last_trade_price"),
            F.max_by("last_mid_price", offset).alias("first_last_mid_price"),
            F.min_by("last_mid_price", offset).alias("last_last_mid_price"),
            exact_avg("avg_spread_bps").alias("avg_spread_bps_mean"),
            F.max("avg_spread_bps").alias("avg_spread_bps_max"),
            F.min_by("last_spread_bps", offset).alias("last_spread_bps_last"),
            exact_avg("avg_book_imbalance").alias("avg_book_imbalance_mean"),
            F.min_by("last_book_imbalance", offset).alias("last_book_imbalance_last"),
            F.max("bbo_quote_age_seconds").alias("bbo_quote_age_seconds_max"),
        )
    )
    traded = F.col("buy_qty_sum") + F.col("sell_qty_sum")
    return measured.withColumns(
        {
            "trade_imbalance_qty_ratio": measures.ratio(F.col("trade_imbalance_qty_sum"), traded),
            "last_trade_return_bps": measures.return_bps(
                F.col("first_last_trade_price"), F.col("last_last_trade_price")
            ),
            "last_mid_return_bps": measures.return_bps(F.col("first_last_mid_price"), F.col("last_last_mid_price")),
        }
    )


def pair_mids(panel: DataFrame, exchanges: Sequence[str]) -> DataFrame:
    """Per window, symbol and bucket, one row per ordered venue pair with both mids known.

    The venue list is an argument, so mids pivot into one column per venue by plain aggregates and
    the panel is never joined with itself. Pair order follows the list and sets the sign.
    """
    names = [name.lower() for name in exchanges]
    mids = (
        panel.filter(F.col("last_mid_price").isNotNull())
        .groupBy(*OWNER, F.lower("symbol").alias("symbol_key"), "second_before_event")
        .agg(
            *[
                F.max(F.when(F.lower("exchange") == name, F.col("last_mid_price"))).alias(f"_mid_{index}")
                for index, name in enumerate(names)
            ]
        )
    )
    pairs = F.array(
        *[
            F.when(
                F.col(f"_mid_{i}").isNotNull() & F.col(f"_mid_{j}").isNotNull(),
                F.struct(
                    F.lit(f"{names[i]}__{names[j]}").alias("exchange_pair"),
                    F.lit(names[i]).alias("exchange_a"),
                    F.lit(names[j]).alias("exchange_b"),
                    F.col(f"_mid_{i}").alias("mid_a"),
                    F.col(f"_mid_{j}").alias("mid_b"),
                ),
            )
            for i, j in combinations(range(len(names)), 2)
        ]
    )
    return mids.select(*OWNER, "symbol_key", "second_before_event", F.inline(F.array_compact(pairs))).withColumn(
        "mid_diff_bps", measures.diff_bps(F.col("mid_a"), F.col("mid_b"))
    )


def pair_profile(
    panel: DataFrame, exchanges: Sequence[str], windows: Sequence[ProfileWindow] = PROFILE_WINDOWS
) -> DataFrame:
    """Mid-price differences per venue pair and profile window."""
    offset = F.col("second_before_event")
    keys = ("symbol_key", "window_mode", "window_label", "exchange_pair", "exchange_a", "exchange_b")
    return (
        _in_windows(pair_mids(panel, exchanges), windows)
        .groupBy(*OWNER, *keys)
        .agg(
            F.count(F.lit(1)).alias("seconds_compared"),
            exact_avg("mid_diff_bps").alias("avg_mid_diff_bps"),
            F.max(F.abs("mid_diff_bps")).alias("max_abs_mid_diff_bps"),
            F.min_by("mid_diff_bps", offset).alias("last_mid_diff_bps"),
        )
        .withColumn("last_abs_mid_diff_bps", F.abs("last_mid_diff_bps"))
    )


# Profile column behind each compared change.
CHANGE_SOURCES = dict(
    zip(
        CHANGE_METRICS,
        (
            "trade_count_per_second_avg",
            "trade_imbalance_qty_per_second",
            "avg_spread_bps_mean",
            "avg_book_imbalance_mean",
        ),
        strict=True,
    )
)


def bucket_change(profile: DataFrame, windows: Sequence[ProfileWindow] = PROFILE_WINDOWS) -> DataFrame:
    """Change of four measures from each tile to the next one closer to the event."""
    tiles = sorted((w for w in windows if w.mode == "bucket"), key=lambda w: -w.last)
    closeness = F.lit(None).cast("int")
    for place, tile in enumerate(tiles):
        closeness = F.when(F.col("window_label") == tile.label, place).otherwise(closeness)
    approach = Window.partitionBy("window_id", "exchange", "symbol").orderBy("_place")
    fields = ["window_label", "_place", *CHANGE_SOURCES.values()]
    steps = (
        profile.filter(F.col("window_mode") == "bucket")
        .withColumn("_place", closeness)
        .filter(F.col("_place").isNotNull())
        .withColumn("_next", F.lead(F.struct(*fields)).over(approach))
        .filter(F.col("_next._place") == F.col("_place") + 1)
    )
    values = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric_name"),
                F.col(source).cast("double").alias("from_bucket_value"),
                F.col(f"_next.{source}").cast("double").alias("to_bucket_value"),
            )
            for metric, source in CHANGE_SOURCES.items()
        ]
    )
    before, after = F.col("from_bucket_value"), F.col("to_bucket_value")
    return steps.select(
        *OWNER,
        "exchange",
        "symbol",
        F.col("window_label").alias("from_bucket"),
        F.col("_next.window_label").alias("to_bucket"),
        F.inline(values),
    ).withColumns(
        {"absolute_change": after - before, "relative_change": measures.relative_change(before, after)}
    )


def build_profiles(
    panel: DataFrame, exchanges: Sequence[str], windows: Sequence[ProfileWindow] = PROFILE_WINDOWS
) -> dict[str, DataFrame]:
    """The three profile tables of a panel."""
    entity = entity_profile(panel, windows)
    return {
        "entity": entity,
        "pair": pair_profile(panel, exchanges, windows),
        "change": bucket_change(entity, windows),
    }
