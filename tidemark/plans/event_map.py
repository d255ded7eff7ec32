"""From ticks to the event map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import clean_ticks, ohlcv_bars
from tidemark.operators.clusters import cluster_anchored, cluster_chained
from tidemark.operators.moves import label_candidates, scan_moves
from tidemark.sources.stages import Stage, write_stage


@dataclass(frozen=True)
class Detector:
    """Bars of ``bucket_seconds``; a move reaches ``threshold_pct`` within ``horizon`` buckets."""

    threshold_pct: float = 1.0
    horizon: int = 60
    bucket_seconds: float = 1
    version: str = "trade_1s_60s_1pct_v1"


def detect(ticks: DataFrame, detector: Detector, stage: Stage = write_stage) -> dict[str, DataFrame]:
    """Bars, labelled candidates (ambiguous ones flagged) of one batch of raw ticks.

    The scan reads bars three times, so they are written once: raw ticks are read and shuffled once.
    """
    width = detector.bucket_seconds
    bars = stage(ohlcv_bars(clean_ticks(ticks), width), "bars")
    candidates = scan_moves(bars, detector.threshold_pct, detector.horizon, bucket_seconds=width)
    labelled = label_candidates(
        candidates,
        bucket_seconds=width,
        detection_version=detector.version,
        threshold_pct=detector.threshold_pct,
        horizon_buckets=detector.horizon,
        aggregation_seconds=width,
    )
    return {"bars": bars, "candidates": stage(labelled, "candidates")}


def event_map(
    ticks: DataFrame,
    detector: Detector,
    *,
    clustering: str = "chained",
    scope: str = "range",
    stage: Stage = write_stage,
) -> DataFrame:
    """Events out of raw ticks, ambiguous candidates left out."""
    cluster = {"chained": cluster_chained, "anchored": cluster_anchored}[clustering]
    clear = detect(ticks, detector, stage)["candidates"].filter(~F.col("is_ambiguous"))
    return cluster(clear, detector.horizon, bucket_seconds=detector.bucket_seconds, scope=scope)
