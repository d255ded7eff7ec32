"""What a catalog and its ticks could support: coverage, candidates, events and a recommended scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators.clusters import cluster_chained
from tidemark.operators.coverage import (
    coverage_diagnostics,
    direction_distribution,
    event_quality,
    scope_recommendation,
)
from tidemark.operators.quality import candidate_rollup
from tidemark.plans.event_map import Detector
from tidemark.sources.catalog import requested_dates, select_partitions
from tidemark.sources.stages import Stage, write_stage


def probe_coverage(
    catalog: DataFrame,
    candidates: DataFrame,
    *,
    exchanges: Sequence[str],
    symbol_family: str,
    detector: Detector,
    lookback: int,
    first_date: str = "auto",
    last_date: str = "auto",
    stage: Stage = write_stage,
) -> dict[str, DataFrame]:
    """Seven tables; ``candidates`` come from ``scan_moves`` with ambiguous ones kept.

    Diagnostics, events and their quality are used by several tables and written once.
    """
    streams = ("trade", "bbo")
    family = select_partitions(catalog, exchanges=exchanges, streams=streams, symbol_family=symbol_family)
    dates = requested_dates(family, first_date, last_date)
    wanted = family.join(dates, "date", "left_semi")
    diagnostics = stage(coverage_diagnostics(dates, catalog, wanted, exchanges), "coverage_diagnostics")
    width = detector.bucket_seconds
    events = stage(cluster_chained(candidates, detector.horizon, bucket_seconds=width, scope="date"), "probe_events")
    quality = stage(event_quality(events, diagnostics, lookback=lookback, bucket_seconds=width), "probe_quality")
    return {
        "coverage_by_date": diagnostics,
        "missing_dates": diagnostics.filter("missing_reasons <> ''").select(
            "date", "is_present_in_catalog", "is_present_in_family", "missing_reasons"
        ),
        "raw_candidate_summary": candidate_rollup(candidates, bucket_seconds=width),
        "grouped_events": events,
        "event_quality": quality,
        "direction_distribution": direction_distribution(
            candidates.filter("not is_ambiguous"), events, quality, bucket_seconds=width
        ),
        "recommended_scope": scope_recommendation(diagnostics, events, quality),
    }
