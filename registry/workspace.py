"""Stage tables shared by the registered queries of one session, as the steps of a study share them.

Each table is written on first use under the shared stage folder and read back from then on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from registry import adapters
from registry.settings import FINE, HOURLY
from tidemark.operators.bars import clean_ticks, ohlcv_bars
from tidemark.operators.compare import compare_profiles, union_reports
from tidemark.operators.coverage import coverage_diagnostics
from tidemark.operators.moves import scan_moves
from tidemark.operators.windows import control_windows, event_windows
from tidemark.plans import study
from tidemark.sources.catalog import requested_dates, select_partitions
from tidemark.sources.stages import write_stage

class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str, stage: Callable[[DataFrame, str], DataFrame] = write_stage):
        self.spark, self.sf_dir, self.stage = spark, sf_dir, stage

    @cached_property
    def ticks(self) -> DataFrame:
        return adapters.event_ticks(self.spark, self.sf_dir)

    @cached_property
    def quotes(self) -> DataFrame:
        return adapters.event_quotes(self.spark, self.sf_dir)

    @cached_property
    def catalog(self) -> DataFrame:
        return adapters.event_catalog(self.spark, self.sf_dir)

    @cached_property
    def market(self) -> dict[str, DataFrame]:
        return study.market_stage(self.ticks, self.quotes, FINE, self.stage)

    @cached_property
    def found(self) -> dict[str, DataFrame]:
        return study.detection_stage(self.market["bars"], FINE, self.stage)

    @cached_property
    def hourly_bars(self) -> DataFrame:
        return self.stage(ohlcv_bars(clean_ticks(self.ticks), HOURLY.bucket_seconds), "hourly_bars")

    @cached_property
    def hourly_candidates(self) -> DataFrame:
        found = scan_moves(
            self.hourly_bars, HOURLY.threshold_pct, HOURLY.horizon, bucket_seconds=HOURLY.bucket_seconds
        )
        return self.stage(found, "hourly_candidates")

    @cached_property
    def own_windows(self) -> DataFrame:
        return event_windows(self.found["events"], FINE.lookback, bucket_seconds=FINE.bucket_seconds)

    @cached_property
    def own(self) -> dict[str, DataFrame]:
        return study.profile_stage(self.market["market"], self.own_windows, FINE, self.stage, "event")

    @cached_property
    def own_activity(self) -> DataFrame:
        return study.activity_stage(self.market["market"], self.own_windows, FINE, self.stage)

    @cached_property
    def selected_own(self) -> dict[str, DataFrame]:
        """As in a study, profiles of the selected events only; ``own`` holds those of all events."""
        windows = event_windows(self.selected, FINE.lookback, bucket_seconds=FINE.bucket_seconds)
        return study.profile_stage(self.market["market"], windows, FINE, self.stage, "selected")

    @cached_property
    def rated(self) -> dict[str, DataFrame]:
        return study.anchor_stage(
            self.market["market"], self.market["bars"], self.found["candidates"], FINE, self.stage
        )

    @cached_property
    def controls(self) -> DataFrame:
        return study.control_stage(self.found["events"], self.own_activity, self.rated, FINE, self.stage)

    @cached_property
    def selected(self) -> DataFrame:
        return self.stage(study.select_events(self.found["events"], self.controls, FINE.max_events), "selected")

    @cached_property
    def kept_controls(self) -> DataFrame:
        kept = self.controls.join(self.selected.select("event_id"), "event_id", "left_semi")
        return self.stage(kept, "selected_controls")

    @cached_property
    def other(self) -> dict[str, DataFrame]:
        windows = control_windows(self.kept_controls, FINE.lookback, bucket_seconds=FINE.bucket_seconds)
        return study.profile_stage(self.market["market"], windows, FINE, self.stage, "control")

    @cached_property
    def comparison(self) -> DataFrame:
        union = union_reports(list(compare_profiles(self.selected_own, self.other).values()))
        return self.stage(union, "comparison")

    @cached_property
    def final(self) -> dict[str, DataFrame]:
        return study.finalize(self.selected, self.kept_controls, self.comparison, top_n=FINE.top_n, stage=self.stage)

    @cached_property
    def reviewed(self) -> dict[str, DataFrame]:
        return study.review_study(
            {"selected_events": self.selected, "comparison": self.comparison}, self.final, FINE
        )

    @cached_property
    def family(self) -> DataFrame:
        return select_partitions(
            self.catalog, exchanges=FINE.exchanges, streams=("trade", "bbo"), symbol_family="idx"
        )

    @cached_property
    def diagnostics(self) -> DataFrame:
        return coverage_diagnostics(requested_dates(self.family), self.catalog, self.family, FINE.exchanges)


_workspaces: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, sf_dir)
    return _workspaces[key]


def forget() -> None:
    """Drop the shared tables' handles, so that the next query starts from the sources."""
    _workspaces.clear()
