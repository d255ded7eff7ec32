"""The multi-event study: every event against its own matched controls, in one batch.

Events and controls run through the same operators, keyed by window. Tables that are used more than
once, or are results themselves, are written as stage tables; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timeaxis import buckets_per_day, floor_div
from tidemark.operators import bars as bar_ops
from tidemark.operators import contracts
from tidemark.operators.clusters import balanced_members, cluster_chained, event_order
from tidemark.operators.compare import compare_profiles, union_reports
from tidemark.operators.controls import (
    activity_sums,
    anchor_activity,
    anchor_exclusion,
    enumerate_anchors,
    match_controls,
    window_activity,
    window_quality,
)
from tidemark.operators.coverage import PASS, event_quality
from tidemark.operators.moves import scan_moves
from tidemark.operators.panel import build_panel, window_buckets
from tidemark.operators.profiles import (
    PROFILE_WINDOWS,
    ProfileWindow,
    bucket_change,
    entity_profile,
    pair_profile,
)
from tidemark.operators.ranking import rank_top_diffs, top_by_abs_z, top_by_extreme
from tidemark.operators.review import review
from tidemark.operators.summaries import (
    metric_group_summary,
    processing_status,
    selection_quality,
    status_counts,
    status_join,
)
from tidemark.operators.windows import control_windows, event_windows
from tidemark.sources.stages import Stage, stage_by


@dataclass(frozen=True)
class StudyParams:
    """Lengths are in buckets of ``bucket_seconds``; ``unit`` is that of numeric epochs (see ``normalize_ts``)."""

    exchanges: tuple[str, ...]
    threshold_pct: float = 1.0
    bucket_seconds: float = 1
    unit: str = "auto"
    horizon: int = 60
    lookback: int = 300
    proximity: int = 1800
    anchor_step: int = 60
    spacing: int = 1800
    controls_per_event: int = 10
    max_events: int = 10
    windows: tuple[ProfileWindow, ...] = PROFILE_WINDOWS
    activity_window: str = "last_300s"
    top_n: int = 20
    top_k: int = 20

    @property
    def span(self) -> int:
        return buckets_per_day(self.bucket_seconds)


def market_stage(ticks: DataFrame, quotes: DataFrame, params: StudyParams, stage: Stage) -> dict[str, DataFrame]:
    """One pass over raw ticks and one over raw quotes; everything later reads buckets, laid out by span (a day)."""
    trades = bar_ops.tick_buckets(bar_ops.clean_ticks(ticks, unit=params.unit), params.bucket_seconds)
    updates = bar_ops.quote_buckets(bar_ops.clean_quotes(quotes, unit=params.unit), params.bucket_seconds)
    buckets = bar_ops.market_buckets(trades, updates)
    placed = buckets.withColumn("span", floor_div(F.col("bucket"), params.span))
    market = stage_by(stage, placed, "market_buckets", "span")
    return {"market": market, "bars": bar_ops.bars_from_buckets(market)}


def detection_stage(
    bars: DataFrame, params: StudyParams, stage: Stage, diagnostics: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Candidates and events; with coverage ``diagnostics``, only events whose dates are covered go on."""
    width = params.bucket_seconds
    candidates = stage(scan_moves(bars, params.threshold_pct, params.horizon, bucket_seconds=width), "candidates")
    clear = candidates.filter(~F.col("is_ambiguous"))
    events = stage(cluster_chained(clear, params.horizon, bucket_seconds=width), "events")
    found = {"candidates": candidates, "events": events}
    if diagnostics is not None:
        quality = stage(
            event_quality(events, diagnostics, lookback=params.lookback, bucket_seconds=width), "event_quality"
        )
        passed = quality.filter(F.col("quality_reason") == PASS)
        found |= {"all_events": events, "quality": quality}
        found["events"] = events.join(passed.select("event_id"), "event_id", "left_semi")
    return found


def profile_stage(
    market: DataFrame, windows: DataFrame, params: StudyParams, stage: Stage, name: str
) -> dict[str, DataFrame]:
    """Panel and profiles of any windows, events and controls alike; a ``Watched`` stage checks them as well."""
    expected = study_contracts(params).get(f"{name}_entity_profile", []) if isinstance(stage, contracts.Watched) else None
    dense = build_panel(market, windows, params.lookback, bucket_seconds=params.bucket_seconds, span_buckets=params.span)
    panel = stage(dense, f"{name}_panel")
    profiled = entity_profile(panel, params.windows)
    entity = stage(profiled, f"{name}_entity_profile", *([expected] if expected else []))
    return {
        "panel": panel,
        "entity": entity,
        "pair": stage(pair_profile(panel, params.exchanges, params.windows), f"{name}_pair_profile"),
        "change": stage(bucket_change(entity, params.windows), f"{name}_change_profile"),
    }


def anchor_stage(
    market: DataFrame,
    bars: DataFrame,
    candidates: DataFrame,
    params: StudyParams,
    stage: Stage,
    spans: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Anchors rated by exclusion and window quality, and the activity before each.

    Starts of all venues, ambiguous ones too, keep anchors away.
    """
    grid = {
        "lookback": params.lookback,
        "horizon": params.horizon,
        "step": params.anchor_step,
        "span_buckets": params.span,
    }
    activity = stage(
        anchor_activity(market, bars, exchanges=params.exchanges, spans=spans, **grid), "anchor_activity"
    )
    excluded = anchor_exclusion(
        enumerate_anchors(bars, spans=spans, **grid),
        candidates,
        lookback=params.lookback,
        horizon=params.horizon,
        proximity=params.proximity,
        span_buckets=params.span,
    )
    rated = window_quality(
        excluded, activity, expected_exchanges=len(params.exchanges), lookback=params.lookback
    )
    return {"anchors": stage(rated, "anchors"), "activity": activity}


def with_span(events: DataFrame, params: StudyParams) -> DataFrame:
    return events.withColumn("span", floor_div(F.col("event_start_bucket"), params.span))


def control_stage(
    events: DataFrame, own_activity: DataFrame, rated: dict[str, DataFrame], params: StudyParams, stage: Stage
) -> DataFrame:
    """Controls of every event at once; ``own_activity`` is that of the events' own windows."""
    controls = match_controls(
        with_span(events, params),
        own_activity,
        rated["anchors"],
        activity_sums(rated["activity"]),
        exchanges=len(params.exchanges),
        count=params.controls_per_event,
        spacing=params.spacing,
        bucket_seconds=params.bucket_seconds,
        stage=stage,
    )
    return stage(controls, "controls")


def activity_stage(market: DataFrame, windows: DataFrame, params: StudyParams, stage: Stage) -> DataFrame:
    """Activity of every event's own window; matching needs no more, so panels wait for the selection."""
    window = next(w for w in params.windows if w.label == params.activity_window)
    sparse = window_buckets(market, windows, params.lookback, span_buckets=params.span)
    return stage(window_activity(sparse, window), "event_activity")


def study_contracts(params: StudyParams) -> dict[str, list[contracts.Expectation]]:
    """What must hold of the tables of a study.

    Row counts are not fixed (a venue may be absent from a window); keys, differences, samples, labels and the
    density of panels are.
    """
    widest = max(params.windows, key=lambda w: w.last - w.first)
    dense = [contracts.expect_no_null("window_id"), contracts.expect_full_window("seconds_observed", widest.label, params.lookback)]
    return {
        "selected_events": [
            contracts.Expectation("rows", F.count(F.lit(1)), -1),
            contracts.expect_no_null("event_id"),
            contracts.expect_rank_within("selection_order", params.max_events),
        ],
        "selected_controls": [
            contracts.Expectation("rows", F.count(F.lit(1)), -1),
            contracts.expect_no_null("sample_id"),
            contracts.expect_no_null("activity_distance"),
            contracts.expect_rank_within("sample_rank", params.controls_per_event),
        ],
        "event_entity_profile": dense,
        "control_entity_profile": dense,
        "comparison": [
            contracts.expect_no_null("event_id"),
            contracts.expect_no_null("metric_group"),
            contracts.expect_sample_count("normal_sample_count", params.controls_per_event),
            contracts.expect_abs_diff("signed_diff_vs_mean", "absolute_diff_vs_mean"),
        ],
    }


def contract_report(watched: contracts.Watched, events: DataFrame, params: StudyParams) -> DataFrame:
    """``table, check, passed, observed, expected``, from what was observed while the tables were written."""
    selected, controls = (watched.observed(name, "rows") for name in ("selected_events", "selected_controls"))
    watched.seen = [row for row in watched.seen if row[1].check != "rows"]
    # Ranks lie within 1..n and a control has one rank: n rows for each event then means n controls for each.
    more = [("selected_controls", "controls_per_event", controls, params.controls_per_event * selected)]
    return watched.report(events, more)


def select_events(events: DataFrame, controls: DataFrame, max_events: int) -> DataFrame:
    """The first ``max_events`` events that have controls: direction-balanced ones first, then by time."""
    matched = events.join(controls.select("event_id").distinct(), "event_id", "left_semi")
    preferred = balanced_members(events, max_events).withColumn("_preferred", F.lit(0))
    ordered = matched.join(preferred, "event_id", "left").withColumn("_preferred", F.coalesce("_preferred", F.lit(1)))
    chosen = ordered.orderBy("_preferred", *event_order()).limit(max_events)
    turn = Window.orderBy("_preferred", *event_order())
    return chosen.withColumn("selection_order", F.row_number().over(turn)).drop("_preferred")


def run_study(
    ticks: DataFrame,
    quotes: DataFrame,
    params: StudyParams,
    stage: Stage,
    diagnostics: DataFrame | None = None,
    min_events: int = 0,
) -> dict:
    """Detection, control selection, then panels and profiles of the selected events and their controls, and comparison.

    Fails if fewer than ``min_events`` events could be selected; the status of all events says why.
    """
    width = params.bucket_seconds
    watched, expected = contracts.Watched(stage), study_contracts(params)
    market = market_stage(ticks, quotes, params, stage)
    found = detection_stage(market["bars"], params, stage, diagnostics)
    events = found["events"]
    windows = event_windows(events, params.lookback, bucket_seconds=width)
    own_activity = activity_stage(market["market"], windows, params, stage)
    rated = anchor_stage(
        market["market"], market["bars"], found["candidates"], params, stage, spans=with_span(events, params)
    )
    controls = control_stage(events, own_activity, rated, params, stage)
    selected = watched(select_events(events, controls, params.max_events), "selected_events", expected["selected_events"])
    taken = controls.join(selected.select("event_id"), "event_id", "left_semi")
    kept = watched(taken, "selected_controls", expected["selected_controls"])
    if diagnostics is None:
        judged = events.select("event_id", F.lit(PASS).alias("quality_reason"))
    else:
        judged = found["quality"]
    status = stage(processing_status(found.get("all_events", events), judged, controls, selected), "processing_status")
    if min_events and (ready := selected.count()) < min_events:
        raise RuntimeError(f"{ready} events could be selected, {min_events} are needed: see the table processing_status")
    chosen = event_windows(selected, params.lookback, bucket_seconds=width)
    own = profile_stage(market["market"], chosen, params, watched, "event")
    other = profile_stage(
        market["market"], control_windows(kept, params.lookback, bucket_seconds=width), params, watched, "control"
    )
    compared = union_reports(list(compare_profiles(own, other).values()))
    comparison = watched(compared, "comparison", expected["comparison"])
    study = {
        **market,
        **found,
        **rated,
        "event_activity": own_activity,
        "processing_status": status,
        "controls": controls,
        "event_profiles": own,
        "control_profiles": other,
        "selected_events": selected,
        "selected_controls": kept,
        "comparison": comparison,
    }
    return study | {"contracts": contract_report(watched, events, params)}


def finalize(
    events: DataFrame, controls: DataFrame, comparison: DataFrame, *, top_n: int, stage: Stage
) -> dict[str, DataFrame]:
    """Top differences and the summary tables of a persisted comparison."""
    status = status_join(events, controls)
    return {
        "top_diffs": stage(rank_top_diffs(comparison, top_n), "top_diffs"),
        "status": status,
        "status_counts": status_counts(status),
        "selection_quality": selection_quality(controls),
        "metric_group_summary": metric_group_summary(comparison),
        "top_by_abs_z": top_by_abs_z(comparison, top_n),
        "top_by_extreme": top_by_extreme(comparison, top_n),
    }


def review_study(study: dict, final: dict[str, DataFrame], params: StudyParams) -> dict[str, DataFrame]:
    """The five review reports of a finished study."""
    return review(
        study["selected_events"],
        final["top_diffs"],
        study["comparison"],
        final["status"],
        top_k=params.top_k,
        controls_per_event=params.controls_per_event,
    )
