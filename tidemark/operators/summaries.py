"""Summary tables of a study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import GROUP


def metric_group_summary(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("small_denominator_flag")).alias("small_denominator_count"),
    )


def selection_quality(controls: DataFrame) -> DataFrame:
    """How close the chosen controls of each event are."""
    return controls.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("selected_normal_count"),
        F.avg("activity_distance").alias("avg_activity_distance"),
        F.max("activity_distance").alias("max_activity_distance"),
        F.min("nearest_candidate_distance").alias("min_nearest_candidate_distance"),
    )


def status_join(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Processing status of each selected event with its number of controls."""
    counts = controls.groupBy("event_id").agg(F.count(F.lit(1)).alias("_controls"))
    return events.join(counts, "event_id", "left").select(
        "event_id",
        "event_rank",
        "direction",
        F.lit("selected").alias("processing_stage"),
        F.lit(True).alias("selected"),
        F.lit(None).cast("string").alias("exclusion_reason"),
        F.coalesce("_controls", F.lit(0)).alias("normal_selection_count"),
    )


def processing_status(events: DataFrame, quality: DataFrame, controls: DataFrame, selected: DataFrame) -> DataFrame:
    """Where each event's processing ended: quality failed, too few controls, beyond the limit, or selected."""
    counts = controls.groupBy("event_id").agg(F.count(F.lit(1)).alias("_controls"))
    chosen = selected.select("event_id", F.lit(True).alias("_chosen"))
    passed = F.col("quality_reason") == "quality_pass_preview"
    stage = (
        F.when(~passed, F.lit("event_quality_failed"))
        .when(F.col("_controls").isNull(), F.lit("normal_selection_failed"))
        .when(F.col("_chosen"), F.lit("selected"))
        .otherwise(F.lit("not_needed"))
    )
    reason = F.when(~passed, F.col("quality_reason")).when(
        F.col("_controls").isNull(), F.lit("insufficient_normal_windows")
    )
    return (
        events.join(quality.select("event_id", "quality_reason"), "event_id", "left")
        .join(counts, "event_id", "left")
        .join(chosen, "event_id", "left")
        .select(
            "event_id",
            "event_rank",
            "direction",
            stage.alias("processing_stage"),
            F.coalesce("_chosen", F.lit(False)).alias("selected"),
            reason.alias("exclusion_reason"),
            F.when(F.col("_chosen"), F.col("_controls")).otherwise(F.lit(0)).alias("normal_selection_count"),
        )
    )


def status_counts(status: DataFrame) -> DataFrame:
    """Events by direction and by (stage, reason), in one pass."""
    level = F.when(F.grouping("direction") == 0, F.lit("direction")).otherwise(F.lit("stage_reason"))
    return (
        status.groupingSets(
            [["direction"], ["processing_stage", "exclusion_reason"]],
            "direction",
            "processing_stage",
            "exclusion_reason",
        )
        .agg(level.alias("summary_level"), F.count(F.lit(1)).alias("event_count"))
        .select("summary_level", "direction", "processing_stage", "exclusion_reason", "event_count")
    )


def count_reconcile(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose expected and observed counts differ; an absent side counts as -1.

    ``expected`` has ``expected_count`` and ``observed`` has ``observed_count`` beside the keys.
    """
    joined = expected.join(observed, list(keys), "full_outer").fillna(-1, ["expected_count", "observed_count"])
    return joined.filter(F.col("expected_count") != F.col("observed_count"))


def top_diff_reconcile(comparison: DataFrame, top_diffs: DataFrame, n: int, rank_types: int = 3) -> DataFrame:
    """Metric groups whose number of ranked rows is not rank_types x min(n, rows)."""
    expected = comparison.groupBy(*GROUP).agg(
        (F.least(F.count(F.lit(1)), F.lit(n)) * F.lit(rank_types)).alias("expected_count")
    )
    observed = top_diffs.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("observed_count"))
    return count_reconcile(expected, observed, GROUP)


def sign_distribution(comparison: DataFrame, column: str, keys: Sequence[str] = ("report_group",)) -> DataFrame:
    value = F.col(column)
    return comparison.groupBy(*keys).agg(
        F.count_if(value > 0).alias("positive_count"),
        F.count_if(value < 0).alias("negative_count"),
        F.count_if(value == 0).alias("zero_count"),
        F.count_if(value.isNull()).alias("null_count"),
    )
