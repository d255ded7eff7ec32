"""Metric names, metric groups and the review labels that depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = "context"
SIGNAL_CANDIDATE = "signal_candidate"
PRICE_DISLOCATION = "price_dislocation"
UNSTABLE = "unstable"

# The metrics compared per report group, and the group of each metric.
ENTITY_METRICS = (
    "seconds_observed",
    "seconds_with_trades",
    "seconds_with_bbo_update",
    "seconds_forward_filled_bbo",
    "trade_count_sum",
    "trade_count_per_second_avg",
    "trade_count_per_second_max",
    "trade_volume_sum",
    "trade_notional_sum",
    "buy_qty_sum",
    "sell_qty_sum",
    "trade_imbalance_qty_sum",
    "trade_imbalance_qty_per_second",
    "trade_imbalance_qty_ratio",
    "last_trade_return_bps",
    "last_mid_return_bps",
    "avg_spread_bps_mean",
    "avg_spread_bps_max",
    "last_spread_bps_last",
    "avg_book_imbalance_mean",
    "last_book_imbalance_last",
    "bbo_quote_age_seconds_max",
)
PAIR_METRICS = (
    "avg_mid_diff_bps",
    "max_abs_mid_diff_bps",
    "last_mid_diff_bps",
    "last_abs_mid_diff_bps",
    "seconds_compared",
)
CHANGE_METRICS = (
    "trade_count_per_second",
    "trade_imbalance_qty_per_second",
    "avg_spread_bps",
    "avg_book_imbalance",
)
CHANGE_FIELDS = ("absolute_change", "relative_change")

METRICS_BY_GROUP = {
    CONTEXT: (
        "seconds_observed",
        "seconds_with_trades",
        "seconds_with_bbo_update",
        "seconds_forward_filled_bbo",
        "seconds_compared",
        "trade_count_sum",
        "trade_count_per_second_avg",
        "trade_count_per_second_max",
        "trade_volume_sum",
        "trade_notional_sum",
        "buy_qty_sum",
        "sell_qty_sum",
        "bbo_quote_age_seconds_max",
        "trade_count_per_second.absolute_change",
    ),
    SIGNAL_CANDIDATE: (
        "buy_trade_count",
        "sell_trade_count",
        "trade_imbalance_qty_sum",
        "trade_imbalance_qty_per_second",
        "trade_imbalance_qty_ratio",
        "buy_notional",
        "sell_notional",
        "avg_spread_bps_mean",
        "avg_spread_bps_max",
        "last_spread_bps_last",
        "avg_book_imbalance_mean",
        "last_book_imbalance_last",
        "trade_imbalance_qty_per_second.absolute_change",
        "avg_spread_bps.absolute_change",
        "avg_book_imbalance.absolute_change",
    ),
    PRICE_DISLOCATION: (
        "last_trade_return_bps",
        "last_mid_return_bps",
        "avg_mid_diff_bps",
        "max_abs_mid_diff_bps",
        "last_mid_diff_bps",
        "last_abs_mid_diff_bps",
    ),
}
RELATIVE_SUFFIX = ".relative_change"


def metric_group(metric: Column, strict: bool = True) -> Column:
    """Group of a metric; an unknown metric raises at run time, or is null if not ``strict``."""
    label = F.when(metric.endswith(RELATIVE_SUFFIX), F.lit(UNSTABLE))
    for group, metrics in METRICS_BY_GROUP.items():
        label = label.when(metric.isin(*metrics), F.lit(group))
    if strict:
        label = label.otherwise(F.raise_error(F.concat(F.lit("no metric group for "), metric)).cast("string"))
    return label


def is_unstable(group: Column, metric: Column) -> Column:
    return F.coalesce(group == UNSTABLE, F.lit(False)) | F.coalesce(metric.endswith(RELATIVE_SUFFIX), F.lit(False))


def expected_sign_policy(group: Column, metric: Column) -> Column:
    """How the sign of a difference may be read. ``abs`` metrics come first."""
    return (
        F.when(metric.contains("abs"), F.lit("no_directional_sign"))
        .when(is_unstable(group, metric), F.lit("unstable_no_primary_sign"))
        .when(group == CONTEXT, F.lit("context_no_signal_sign"))
        .when(
            (group == PRICE_DISLOCATION) & (metric.contains("return_bps") | metric.endswith("mid_diff_bps")),
            F.lit("direction_normalized"),
        )
        .otherwise(F.lit("observed_signed"))
    )


# Window labels that sit close to, or too close to, the event.
PROXIMATE_WINDOWS = ("last_30s", "last_10s", "bucket_30_10s", "bucket_10_0s")
LATE_WINDOWS = ("last_10s", "bucket_10_0s")


def window_proximity(label: Column) -> Column:
    return (
        F.when(label.isin(*LATE_WINDOWS), F.lit("late_reaction"))
        .when(label.isin(*PROXIMATE_WINDOWS), F.lit("event_proximate"))
        .otherwise(F.lit("earlier"))
    )


def entity_relevance(primary: str, exchange: Column, pair: Column) -> Column:
    """Does a row concern the primary venue itself, a pair containing it, or neither?"""
    name = primary.lower()
    pair_key = F.coalesce(F.lower(pair), F.lit(""))
    return (
        F.when(F.lower(exchange) == name, F.lit(f"{name}_exchange"))
        .when(pair_key.contains(name), F.lit(f"{name}_pair"))
        .when(pair_key != "", F.lit(f"non_{name}_pair"))
        .otherwise(F.lit(f"no_{name}_reference"))
    )


def metric_policy(
    group: Column, metric: Column, risk_events: Column, source_events: Column, seen_events: Column
) -> dict[str, Column]:
    """The policy decision and its wording; every field follows the same branch."""
    branches = (
        (
            is_unstable(group, metric),
            ("diagnostic", F.lit("unstable_or_relative_change_metric"), "appendix_only"),
        ),
        (
            (source_events > 0) & (risk_events >= source_events),
            ("exclude", F.lit("denominator_risk_in_all_source_events"), "exclude_primary"),
        ),
        (
            risk_events > 0,
            ("diagnostic", F.lit("denominator_risk_present"), "exclude_primary"),
        ),
        (
            group == CONTEXT,
            ("context_filter", F.lit("context_metric_for_matching_regime_or_diagnostic"), "none_observed"),
        ),
        (
            group.isin(PRICE_DISLOCATION, SIGNAL_CANDIDATE),
            (
                "core_feature",
                F.concat(group, F.lit("_candidate_seen_in_"), seen_events.cast("string"), F.lit("_events")),
                "none_observed",
            ),
        ),
    )
    decision = None
    for condition, (bucket, reason, denominator) in branches:
        row = F.struct(
            F.lit(bucket).alias("policy_bucket"), reason.alias("reason"), F.lit(denominator).alias("denominator_policy")
        )
        decision = F.when(condition, row) if decision is None else decision.when(condition, row)
    decision = decision.otherwise(
        F.struct(
            F.lit("diagnostic").alias("policy_bucket"),
            F.lit("unknown_metric_group").alias("reason"),
            F.lit("review_required").alias("denominator_policy"),
        )
    )
    return {
        "policy_bucket": decision["policy_bucket"],
        "reason": decision["reason"],
        "denominator_risk_policy": decision["denominator_policy"],
    }
