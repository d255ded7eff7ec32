"""Events against their controls, metric by metric."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import measures
from tidemark.functions.exact import exact_avg, sorted_deviation
from tidemark.functions.taxonomy import (
    CHANGE_FIELDS,
    ENTITY_METRICS,
    PAIR_METRICS,
    RELATIVE_SUFFIX,
    metric_group,
)

DIMENSIONS = (
    "exchange",
    "symbol",
    "symbol_key",
    "exchange_pair",
    "window_mode",
    "window_label",
    "from_bucket",
    "to_bucket",
)


@dataclass(frozen=True)
class Report:
    """How one profile table is compared: its key columns and its measured columns."""

    group: str
    keys: tuple[str, ...]
    metrics: tuple[str, ...]
    metric_prefix: str | None = None
    carried: tuple[str, ...] = field(default=())


REPORTS = {
    "entity": Report(
        "exchange_profile", ("exchange", "symbol_key", "window_mode", "window_label"), ENTITY_METRICS
    ),
    "pair": Report(
        "cross_exchange_mid_diff", ("symbol_key", "exchange_pair", "window_mode", "window_label"), PAIR_METRICS
    ),
    "change": Report(
        "bucket_change_profile",
        ("exchange", "symbol_key", "source_metric", "from_bucket", "to_bucket"),
        CHANGE_FIELDS,
        metric_prefix="source_metric",
        carried=("from_bucket_value", "to_bucket_value"),
    ),
}


def _measured(profile: DataFrame, report: Report) -> DataFrame:
    """Profile rows with the report's key columns and every measure as a double."""
    missing = [name for name in report.metrics if name not in profile.columns]
    if missing:
        raise ValueError(f"{report.group} lacks curated metrics: {', '.join(missing)}")
    keyed = profile
    if "symbol" in profile.columns:
        keyed = keyed.withColumn("symbol_key", F.lower("symbol"))
    if report.metric_prefix:
        keyed = keyed.withColumn(report.metric_prefix, F.col("metric_name"))
    values = F.struct(*[F.col(name).cast("double").alias(name) for name in (*report.metrics, *report.carried)])
    symbol = F.col("symbol") if "symbol" in profile.columns else F.lit(None).cast("string").alias("symbol")
    return keyed.select("window_id", "event_id", "direction", symbol, *report.keys, values.alias("_values"))


def event_normal_join(event_profile: DataFrame, control_profile: DataFrame, report: Report) -> DataFrame:
    """Long samples: one row per (event, key, metric, control).

    Profiles join while wide, one row per (event, key, control), and unfold into metrics afterwards:
    the shuffle moves one row instead of one per metric, and grouping by the same keys needs no other.
    """
    own = _measured(event_profile, report).select(
        "event_id", F.col("direction").alias("event_direction"), "symbol", *report.keys, F.col("_values").alias("_own")
    )
    other = _measured(control_profile, report).select(
        "event_id", F.col("window_id").alias("sample_id"), *report.keys, F.col("_values").alias("_other")
    )
    joined = own.join(other, ["event_id", *report.keys])

    def carried(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}") if name in report.carried else F.lit(None).cast("double")

    def name_of(metric: str) -> Column:
        if report.metric_prefix is None:
            return F.lit(metric)
        return F.concat(F.col(report.metric_prefix), F.lit(f".{metric}"))

    samples = F.array(
        *[
            F.struct(
                name_of(metric).alias("metric_name"),
                F.col(f"_own.{metric}").alias("event_value"),
                F.col(f"_other.{metric}").alias("normal_value"),
            )
            for metric in report.metrics
        ]
    )
    absent = [
        F.lit(None).cast("string").alias(name)
        for name in DIMENSIONS
        if name not in report.keys and name not in ("symbol",)
    ]
    unfolded = joined.select(
        "event_id",
        "event_direction",
        "sample_id",
        "symbol",
        *report.keys,
        *absent,
        carried("_own", "from_bucket_value").alias("event_from_bucket_value"),
        carried("_other", "from_bucket_value").alias("normal_from_bucket_value"),
        carried("_own", "to_bucket_value").alias("event_to_bucket_value"),
        carried("_other", "to_bucket_value").alias("normal_to_bucket_value"),
        F.inline(samples),
    )
    labels = {"report_group": F.lit(report.group), "metric_group": metric_group(F.col("metric_name"))}
    return unfolded.withColumns(labels).drop(report.metric_prefix or "")


def denominator_flags(metric: Column, normal: Column, event_from: Column, normal_from: Column) -> dict[str, Column]:
    ratio_unstable = measures.weak(normal)
    relative_unstable = metric.endswith(RELATIVE_SUFFIX) & (measures.weak(event_from) | measures.weak(normal_from))
    return {
        "ratio_unstable": ratio_unstable,
        "relative_change_unstable": relative_unstable,
        "small_denominator_flag": ratio_unstable | relative_unstable,
    }


IDENTITY = ("event_id", "event_direction", "report_group", "metric_group", "metric_name", *DIMENSIONS)
FROM_TO = ("event_from_bucket_value", "normal_from_bucket_value", "event_to_bucket_value", "normal_to_bucket_value")


def single_compare(event_profile: DataFrame, control_profile: DataFrame, report: Report) -> DataFrame:
    """Each event metric beside the same metric of one control."""
    event, normal = F.col("event_value"), F.col("normal_value")
    flags = denominator_flags(
        F.col("metric_name"), normal, F.col("event_from_bucket_value"), F.col("normal_from_bucket_value")
    )
    return (
        event_normal_join(event_profile, control_profile, report)
        .withColumns(
            {
                "signed_diff": event - normal,
                "absolute_diff": F.abs(event - normal),
                "ratio": measures.ratio(event, normal),
                **flags,
            }
        )
        .select(*IDENTITY, "sample_id", "event_value", "normal_value", "signed_diff", "absolute_diff", "ratio", *flags, *FROM_TO)
    )


def distribution_compare(
    event_profile: DataFrame, control_profile: DataFrame, report: Report, *, exact: bool = False
) -> DataFrame:
    """Each event metric against the distribution over the event's controls.

    Means are exact sums and deviations are summed in ascending order over the controls of one event, so the order of
    rows decides neither signs, ranks nor denominators, and two runs give the same bits.

    Quartiles are order statistics (``percentile_approx``, exact for a handful of controls);
    ``exact=True`` interpolates instead.
    """
    samples = event_normal_join(event_profile, control_profile, report)
    event, normal = F.col("event_value"), F.col("normal_value")
    grouping = (*IDENTITY, "event_value", "event_from_bucket_value", "event_to_bucket_value")
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    percentiles = F.percentile(normal, quartiles) if exact else F.percentile_approx(normal, [0.25, 0.5, 0.75])
    grouped = samples.groupBy(*grouping).agg(
        exact_avg(normal).alias("normal_mean"),
        percentiles.alias("_quartiles"),
        F.min(normal).alias("normal_min"),
        F.max(normal).alias("normal_max"),
        F.collect_list(normal).alias("_values"),
        F.count(F.lit(1)).alias("normal_sample_count"),
        F.count(normal).alias("normal_non_null_count"),
        F.count_if(F.abs(normal) <= measures.WEAK_DENOMINATOR).alias("normal_zero_or_near_zero_count"),
        F.count_if(normal <= event).alias("_not_above"),
        exact_avg("normal_from_bucket_value").alias("normal_from_bucket_value"),
        exact_avg("normal_to_bucket_value").alias("normal_to_bucket_value"),
    )
    mean = F.col("normal_mean")
    flags = denominator_flags(
        F.col("metric_name"), mean, F.col("event_from_bucket_value"), F.col("normal_from_bucket_value")
    )
    deviated = grouped.withColumn("normal_stddev", sorted_deviation(F.col("_values"), mean))
    measured = {
        "normal_p25": F.col("_quartiles")[0],
        "normal_median": F.col("_quartiles")[1],
        "normal_p75": F.col("_quartiles")[2],
        "signed_diff_vs_mean": event - mean,
        "absolute_diff_vs_mean": F.abs(event - mean),
        "ratio_vs_mean": measures.ratio(event, mean),
        "z_score_vs_normal": measures.z_score(event, mean, F.col("normal_stddev")),
        "normal_percentile_rank": F.when(
            event.isNotNull() & (F.col("normal_non_null_count") > 0),
            F.col("_not_above") / F.col("normal_non_null_count"),
        ),
        **flags,
    }
    return deviated.withColumns(measured).select(
        *IDENTITY,
        "event_value",
        "normal_mean",
        "normal_median",
        "normal_min",
        "normal_max",
        "normal_p25",
        "normal_p75",
        "normal_stddev",
        "normal_sample_count",
        "normal_non_null_count",
        "normal_zero_or_near_zero_count",
        "signed_diff_vs_mean",
        "absolute_diff_vs_mean",
        "ratio_vs_mean",
        "z_score_vs_normal",
        "normal_percentile_rank",
        *flags,
        *FROM_TO,
    )


def compare_profiles(
    event_profiles: dict[str, DataFrame], control_profiles: dict[str, DataFrame], *, single: bool = False
) -> dict[str, DataFrame]:
    """All three report groups, every event in one plan each."""
    compare = single_compare if single else distribution_compare
    return {name: compare(event_profiles[name], control_profiles[name], report) for name, report in REPORTS.items()}


def unmatched_keys(event_profile: DataFrame, control_profile: DataFrame, report: Report) -> DataFrame:
    """Profile keys of an event without a control, and the reverse: empty when both sides agree."""
    keys = ("event_id", *report.keys)
    sides = (
        _measured(event_profile, report)
        .select(*keys, F.lit("event").alias("_side"))
        .unionByName(_measured(control_profile, report).select(*keys, F.lit("normal").alias("_side")))
    )
    present = sides.groupBy(*keys).agg(
        F.bool_or(F.col("_side") == "event").alias("_event"), F.bool_or(F.col("_side") == "normal").alias("_normal")
    )
    return present.filter(~(F.col("_event") & F.col("_normal"))).select(
        *keys, F.when(F.col("_event"), F.lit("event_only")).otherwise(F.lit("normal_only")).alias("unmatched")
    )


def union_reports(tables: Sequence[DataFrame]) -> DataFrame:
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union
