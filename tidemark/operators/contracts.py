"""Expectations on tables, evaluated in one aggregation or while the table is written, and the row-count formulas."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.taxonomy import CHANGE_FIELDS, CHANGE_METRICS, ENTITY_METRICS, PAIR_METRICS
from tidemark.sources.stages import Stage


@dataclass(frozen=True)
class Expectation:
    """``observed`` is an aggregate; the check passes when it equals ``expected``."""

    check: str
    observed: Column
    expected: int


def expect_count(rows: int) -> Expectation:
    return Expectation("count", F.count(F.lit(1)), rows)


def expect_no_null(column: str) -> Expectation:
    return Expectation(f"no_null:{column}", F.count_if(F.col(column).isNull()), 0)


def expect_abs_diff(signed: str, absolute: str, tolerance: float = 1e-9) -> Expectation:
    """Rows whose absolute difference is negative or does not match the signed one."""
    size = F.col(absolute)
    wrong = (size < 0) | (F.abs(F.abs(F.col(signed)) - size) > tolerance)
    return Expectation(f"abs_diff:{absolute}", F.count_if(wrong), 0)


def expect_sample_count(column: str, samples: int) -> Expectation:
    differs = ~F.col(column).eqNullSafe(F.lit(samples))
    return Expectation(f"sample_count:{column}", F.count_if(differs), 0)


def expect_single_row(columns: Sequence[str]) -> Expectation:
    """Exactly one distinct combination: the least equals the greatest, so no set is collected."""
    combination = F.struct(*columns)
    single = F.coalesce(F.min(combination) == F.max(combination), F.lit(False))
    return Expectation(f"single:{','.join(columns)}", single.cast("long"), 1)


def expect_domain(column: str, domain: Iterable[str]) -> Expectation:
    """Values outside the domain plus domain values never seen."""
    values = list(domain)
    outside = F.count_if(~F.col(column).isin(*values))
    unseen = sum((F.when(F.coalesce(F.bool_or(F.col(column) == v), F.lit(False)), 0).otherwise(1) for v in values), F.lit(0))
    return Expectation(f"domain:{column}", outside + unseen, 0)


def check(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """``check, passed, observed, expected`` per expectation, from one pass over ``df``."""
    rows = [
        F.struct(
            F.lit(e.check).alias("check"),
            e.observed.cast("long").alias("observed"),
            F.lit(e.expected).cast("long").alias("expected"),
        )
        for e in expectations
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows")).select(
        "check", (F.col("observed") == F.col("expected")).alias("passed"), "observed", "expected"
    )


def expect_rank_within(column: str, most: int) -> Expectation:
    """Ranks outside 1..most, null ones included."""
    return Expectation(f"rank_within:{column}", F.count_if(~F.coalesce(F.col(column).between(1, most), F.lit(False))), 0)


def expect_full_window(column: str, label: str, rows: int) -> Expectation:
    """Profile rows of the widest window that do not stem from exactly ``rows`` panel rows: series that are not dense."""
    wrong = (F.col("window_label") == label) & ~F.col(column).eqNullSafe(F.lit(rows))
    return Expectation(f"full_window:{column}", F.count_if(wrong), 0)


class Watched:
    """A stage that evaluates expectations while it writes, so that they cost no pass of their own.

    The aggregates sit on top of the table, in the tasks that write it, and a task counts once however often it is
    repeated. A table that fails its expectations is written and reported like any other. Where a stage does not write
    at once (or nothing was observed) the table is aggregated instead.
    """

    def __init__(self, stage: Stage):
        self.stage = stage
        self.seen: list[tuple[str, Expectation, int]] = []

    def __call__(self, df: DataFrame, name: str, expectations: Sequence[Expectation] = ()) -> DataFrame:
        if not expectations:
            return self.stage(df, name)
        watcher = Observation(f"{name}-{uuid.uuid4().hex}")
        named = [e.observed.cast("long").alias(f"check_{i}") for i, e in enumerate(expectations)]
        kept = self.stage(df.observe(watcher, F.count(F.lit(1)).alias("rows"), *named), name)
        lazy = "CollectMetrics" in kept._jdf.queryExecution().analyzed().toString()
        found = {} if lazy else watcher.get
        if found:
            self.seen += [(name, e, found[f"check_{i}"]) for i, e in enumerate(expectations)]
        else:
            rows = check(kept, expectations).collect()
            self.seen += [(name, e, row["observed"]) for e, row in zip(expectations, rows, strict=True)]
        return kept

    def observed(self, table: str, name: str) -> int:
        return next(value for at, e, value in self.seen if (at, e.check) == (table, name))

    def report(self, df: DataFrame, more: Sequence[tuple[str, str, int, int]] = ()) -> DataFrame:
        """``table, check, passed, observed, expected``; ``more``: (table, check, observed, expected) found in other ways.

        ``df`` names the session.
        """
        rows = [(table, e.check, value, e.expected) for table, e, value in self.seen] + list(more)
        listed = [(table, name, value == expected, value, expected) for table, name, value, expected in rows]
        return df.sparkSession.createDataFrame(listed, "table string, check string, passed boolean, observed long, expected long")


def expect_curated(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Curated metric columns the table lacks; needs the schema only."""
    return [name for name in required if name not in df.columns]


def dense_violations(panel: DataFrame, lookback: int, keys: Sequence[str] = ("window_id", "exchange", "symbol")) -> DataFrame:
    """Panel series that do not hold exactly the offsets 1..lookback, once each."""
    offset = F.col("second_before_event")
    series = panel.groupBy(*keys).agg(
        F.min(offset).alias("min_offset"),
        F.max(offset).alias("max_offset"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(offset).alias("_sum"),
    )
    dense = (
        (F.col("min_offset") == 1)
        & (F.col("max_offset") == lookback)
        & (F.col("row_count") == lookback)
        & (F.col("_sum") == lookback * (lookback + 1) // 2)
    )
    return series.filter(~dense).drop("_sum")


def metadata_mismatches(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations of metadata present in only one of two tables."""
    sides = left.select(*columns, F.lit("left").alias("_side")).unionByName(
        right.select(*columns, F.lit("right").alias("_side"))
    )
    seen = sides.groupBy(*columns).agg(F.min("_side").alias("only_in"), F.max("_side").alias("_other"))
    return seen.filter(F.col("only_in") == F.col("_other")).drop("_other")


def raise_on_failure(report: DataFrame) -> None:
    failed = report.filter(~F.col("passed")).collect()
    if failed:
        details = "; ".join(f"{row['check']}: observed {row['observed']}, expected {row['expected']}" for row in failed)
        raise RuntimeError(f"contract violated: {details}")


def expected_panel_rows(windows: int, venues: int, lookback: int) -> int:
    return windows * venues * lookback


def expected_profile_rows(windows: int, venues: int, profile_windows: int = 10, transitions: int = 4) -> dict[str, int]:
    pairs = venues * (venues - 1) // 2
    return {
        "entity": windows * venues * profile_windows,
        "pair": windows * pairs * profile_windows,
        "change": windows * venues * transitions * len(CHANGE_METRICS),
    }


def expected_comparison_rows(events: int, venues: int, profile_windows: int = 10, transitions: int = 4) -> dict[str, int]:
    rows = expected_profile_rows(events, venues, profile_windows, transitions)
    return {
        "entity": rows["entity"] * len(ENTITY_METRICS),
        "pair": rows["pair"] * len(PAIR_METRICS),
        "change": rows["change"] * len(CHANGE_FIELDS),
    }


def expected_top_diff_rows(group_counts: Iterable[int], n: int, rank_types: int = 3) -> int:
    return sum(rank_types * min(n, rows) for rows in group_counts)
