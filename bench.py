"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Two groups. ``study_*`` are the steps of one multi-event study in order, each reading the stage tables
of the steps before it, so that together they are one run from the source tables to the reports.
``q_*`` are single queries, each from the source tables (stage tables are forgotten before each).
An untimed query warms the JVM first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from registry.queries import QUERIES, runnable
from registry.workspace import Workspace, forget, workspace


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def consume_all(tables: dict[str, DataFrame]) -> None:
    for table in tables.values():
        consume(table)


# A step is done when its stage tables are written or its reports are consumed.
STUDY_STEPS: dict[str, Callable[[Workspace], object]] = {
    "study_01_bucket_build": lambda w: w.market,
    "study_02_candidate_scan_and_clustering": lambda w: w.found,
    "study_03_event_activity": lambda w: w.own_activity,
    "study_04_anchor_activity_and_quality": lambda w: w.rated,
    "study_05_control_selection": lambda w: (w.controls, w.selected, w.kept_controls),
    "study_06_event_and_control_panels_and_profiles": lambda w: (w.selected_own, w.other),
    "study_07_comparison_build": lambda w: w.comparison,
    "study_08_top_diffs_and_summaries": lambda w: consume_all(w.final),
    "study_09_review_reports": lambda w: consume_all(w.reviewed),
}
QUERIES_FROM_SOURCE = (
    "q_ohlcv_bars",
    "q_tick_buckets",
    "q_quote_buckets",
    "q_profile_ticks",
    "q_seq_order_check",
    "q_duplicate_profile",
    "q_event_map",
    "q_cluster_anchored",
    "q_probe_coverage",
    "q_extract_windows_ticks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Leave out the capture of call sites, which costs driver time per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, action: Callable[[], object]) -> None:
        started = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - started, 3)

    def from_source(name: str) -> Callable[[], object]:
        return lambda: consume(runnable(QUERIES[name])(spark, sf_dir))

    from_source("q_ohlcv_bars")()
    forget()
    for name, step in STUDY_STEPS.items():
        timed(name, lambda step=step: step(workspace(spark, sf_dir)))
    study = round(sum(seconds.values()), 3)
    for name in QUERIES_FROM_SOURCE:
        forget()
        timed(name, from_source(name))
    result = {
        "metric": "study_and_headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {"study_from_source_to_reports": study, **seconds},
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
