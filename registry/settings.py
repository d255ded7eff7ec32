"""Parameters of the registered queries."""

from __future__ import annotations

from registry.adapters import VENUES
from tidemark.operators.profiles import scaled_windows
from tidemark.plans.event_map import Detector
from tidemark.plans.study import StudyParams

# The study: 5-minute buckets, look-back of 30 buckets, profile windows scaled to it.
LOOKBACK = 30
FINE = StudyParams(
    exchanges=VENUES,
    threshold_pct=4.0,
    bucket_seconds=300,
    horizon=6,
    lookback=LOOKBACK,
    proximity=6,
    anchor_step=6,
    spacing=12,
    controls_per_event=4,
    max_events=12,
    windows=scaled_windows(10),
    top_n=5,
    top_k=5,
)
# Detection and coverage: hourly bars, so that ambiguous candidates occur too.
HOURLY = Detector(threshold_pct=2.0, horizon=6, bucket_seconds=3600, version="trade_1h_6h_2pct_v1")
RAW_LOOKBACK = 12
