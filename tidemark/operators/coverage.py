"""Coverage of dates by venues and streams, and what it allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeaxis import bucket_date, bucket_start, window_dates

PASS = "quality_pass_preview"


def _listed(exchanges: Sequence[str]) -> Column:
    return F.array(*[F.lit(name.lower()) for name in exchanges])


def coverage_table(partitions: DataFrame, exchanges: Sequence[str]) -> DataFrame:
    """Venues present and missing per date (sets are bounded by the venue list)."""
    names = [name.lower() for name in exchanges]
    return (
        partitions.filter(F.lower("exchange").isin(*names))
        .groupBy("date")
        .agg(F.collect_set(F.lower("exchange")).alias("_present"))
        .select(
            "date",
            F.array_sort("_present").alias("present_exchanges"),
            F.size("_present").alias("coverage_count"),
            F.array_except(_listed(exchanges), "_present").alias("missing_exchanges"),
        )
    )


def best_date(coverage: DataFrame, exchanges: int, min_coverage: int = 2) -> DataFrame:
    """The latest date all venues cover, else the latest with at least ``min_coverage``, else no row."""
    full = F.col("coverage_count") == exchanges
    return coverage.filter(full | (F.col("coverage_count") >= min_coverage)).orderBy(full.desc(), F.col("date").desc()).limit(1)


def exchange_coverage(rows: DataFrame, exchanges: Sequence[str], keys: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Expected, observed and missing venues per key; ``covered`` asks for all of them, or for any."""
    observed = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.lower("exchange"))).alias("observed_exchanges"))
    known = observed.select(
        *keys,
        _listed(exchanges).alias("expected_exchanges"),
        "observed_exchanges",
        F.array_except(_listed(exchanges), "observed_exchanges").alias("missing_exchanges"),
    )
    matched = F.size(F.array_intersect("expected_exchanges", "observed_exchanges"))
    covered = F.size("missing_exchanges") == 0 if strict else matched > 0
    return known.withColumn("covered", covered)


def coverage_diagnostics(
    requested: DataFrame, catalog: DataFrame, partitions: DataFrame, exchanges: Sequence[str]
) -> DataFrame:
    """Per requested date: presence in the catalog and the family, venue coverage per stream, missing pieces."""
    names = [name.lower() for name in exchanges]
    anywhere = (
        catalog.filter(F.coalesce(F.col("available"), F.lit(True)))
        .select("date")
        .distinct()
        .withColumn("is_present_in_catalog", F.lit(True))
    )
    kinds = ("trade", "bbo")

    def has(name: str, kind: str) -> Column:
        return F.bool_or((F.lower("exchange") == name) & (F.lower("stream") == kind)).alias(f"has_{name}_{kind}")

    family = (
        partitions.filter(F.lower("exchange").isin(*names) & F.lower("stream").isin(*kinds))
        .groupBy("date")
        .agg(F.lit(True).alias("is_present_in_family"), *[has(name, kind) for kind in kinds for name in names])
    )
    flags = [f"has_{name}_{kind}" for kind in kinds for name in names]
    joined = (
        requested.select("date")
        .join(anywhere, "date", "left")
        .join(family, "date", "left")
        .fillna(False, subset=["is_present_in_catalog", "is_present_in_family", *flags])
    )
    counts = {
        f"{kind}_coverage_count": sum((F.col(f"has_{name}_{kind}").cast("int") for name in names), F.lit(0))
        for kind in kinds
    }
    missing = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"has_{name}_{kind}"), F.lit(f"missing_{name}_{kind}"))
                for name in names
                for kind in kinds
            ]
        )
    )
    reasons = (
        F.when(~F.col("is_present_in_catalog"), F.array(F.lit("date_missing_all_streams")))
        .when(~F.col("is_present_in_family"), F.array(F.lit("date_missing_family_streams")))
        .otherwise(missing)
    )
    full_trade = F.col("trade_coverage_count") == len(names)
    full_bbo = F.col("bbo_coverage_count") == len(names)
    return joined.withColumns(counts).withColumns(
        {
            "has_full_trade_coverage": full_trade,
            "has_full_bbo_coverage": full_bbo,
            "has_full_trade_bbo_coverage": full_trade & full_bbo,
            "event_scan_possible": F.col("trade_coverage_count") > 0,
            "missing_reasons": F.array_join(reasons, ";"),
        }
    )


def event_quality(
    events: DataFrame, diagnostics: DataFrame, *, lookback: int, bucket_seconds: float = 1
) -> DataFrame:
    """Whether each event's date and every date its look-back touches are covered; the first failure, or pass."""
    timed = events.select(
        "event_id",
        "direction",
        "is_ambiguous",
        bucket_date(F.col("event_start_bucket"), bucket_seconds).alias("selected_date"),
        bucket_start(F.col("event_start_bucket") - F.lit(lookback), bucket_seconds).alias("_from"),
        bucket_start(F.col("event_start_bucket"), bucket_seconds).alias("_to"),
    )
    both = diagnostics.select(F.col("date").alias("partition_date"), "has_full_trade_bbo_coverage")
    before = (
        window_dates(timed, "_from", "_to")
        .join(both, "partition_date", "left")
        .groupBy("event_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set("partition_date")), ",").alias("pre_window_partition_dates"),
            F.bool_and(F.coalesce("has_full_trade_bbo_coverage", F.lit(False))).alias(
                "pre_window_partitions_available"
            ),
        )
    )
    own = diagnostics.select(
        F.col("date").alias("selected_date"),
        F.lit(True).alias("_known"),
        "has_full_trade_coverage",
        "has_full_bbo_coverage",
        "trade_coverage_count",
        "bbo_coverage_count",
    )
    reason = (
        F.when(F.col("is_ambiguous"), F.lit("ambiguous_event"))
        .when(F.col("_known").isNull(), F.lit("missing_date"))
        .when(~F.col("has_full_trade_coverage"), F.lit("missing_trade_coverage"))
        .when(~F.col("has_full_bbo_coverage"), F.lit("missing_bbo_coverage"))
        .when(~F.col("pre_window_partitions_available"), F.lit("pre_window_partition_missing"))
        .otherwise(F.lit(PASS))
    )
    return (
        timed.join(own, "selected_date", "left")
        .join(before, "event_id", "left")
        .fillna(False, subset=["has_full_trade_coverage", "has_full_bbo_coverage"])
        .fillna(0, subset=["trade_coverage_count", "bbo_coverage_count"])
        .select(
            "event_id",
            "direction",
            "selected_date",
            "has_full_trade_coverage",
            "has_full_bbo_coverage",
            "trade_coverage_count",
            "bbo_coverage_count",
            "pre_window_partition_dates",
            "pre_window_partitions_available",
            reason.alias("quality_reason"),
        )
    )


def direction_distribution(
    candidates: DataFrame, events: DataFrame, quality: DataFrame, *, bucket_seconds: float = 1
) -> DataFrame:
    """Candidates, events and quality-passing events per date and direction."""

    def tagged(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select("selected_date", "direction", F.lit(kind).alias("_kind"))

    raw = candidates.withColumn("selected_date", bucket_date(F.col("start_bucket"), bucket_seconds))
    passed = quality.filter(F.col("quality_reason") == PASS)
    counts = {"raw_candidate_count": "raw", "grouped_event_count": "event", "quality_pass_count": "pass"}
    return (
        tagged(raw, "raw")
        .unionByName(tagged(events, "event"))
        .unionByName(tagged(passed, "pass"))
        .groupBy("selected_date", "direction")
        .agg(*[F.count_if(F.col("_kind") == kind).alias(name) for name, kind in counts.items()])
    )


def scope_recommendation(
    diagnostics: DataFrame, events: DataFrame, quality: DataFrame, *, max_events: int = 10, min_events: int = 2
) -> DataFrame:
    """One row: what a study over these dates could use, and whether it is worth running."""
    passed = F.col("quality_reason") == PASS
    dates = F.when(passed, F.col("selected_date"))
    counted = quality.agg(
        F.count_if(passed).alias("quality_pass_count"),
        F.count_if(passed & (F.col("direction") == "UP")).alias("up_count"),
        F.count_if(passed & (F.col("direction") == "DOWN")).alias("down_count"),
        F.min(dates).alias("recommended_start_date"),
        F.max(dates).alias("recommended_end_date"),
    )
    covered = diagnostics.agg(
        F.min("date").alias("requested_start_date"),
        F.max("date").alias("requested_end_date"),
        F.count_if("is_present_in_family").alias("available_date_count"),
        F.count_if("has_full_trade_bbo_coverage").alias("full_coverage_date_count"),
        F.coalesce(F.bool_or("event_scan_possible"), F.lit(False)).alias("event_scan_possible"),
    )
    grouped = events.agg(F.count(F.lit(1)).alias("grouped_event_count"))
    one_sided = (F.col("up_count") == 0) | (F.col("down_count") == 0)
    status = (
        F.when(~F.col("event_scan_possible"), F.lit("no_event_scan_possible"))
        .when(F.col("quality_pass_count") == 0, F.lit("no_quality_preview_events"))
        .when(F.col("quality_pass_count") == 1, F.lit("weak_multi_event_coverage"))
        .when(one_sided, F.lit("direction_imbalanced"))
        .otherwise(F.lit("ready_for_phase3a_trial"))
    )
    # Three one-row aggregates side by side, two of them as scalar subqueries.
    around = covered.select(F.struct("*")).scalar()
    return (
        counted.withColumns({"_covered": around, "grouped_event_count": grouped.scalar()})
        .select("*", "_covered.*")
        .drop("_covered")
        .withColumns(
            {
                "recommended_max_events": F.least(F.lit(max_events).cast("long"), F.col("quality_pass_count")),
                "recommended_min_events": F.least(F.lit(min_events).cast("long"), F.col("quality_pass_count")),
                "direction_balance_possible": (F.col("up_count") > 0) & (F.col("down_count") > 0),
                "scope_status": status,
            }
        )
    )
