"""Ranked differences per event and metric group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.measures import tail_extremity

GROUP = ("event_id", "report_group", "metric_group")
# Fixed value: the order of tie-breakers within a ranking.
TIE_BREAKERS = (
    "report_group",
    "metric_name",
    "exchange",
    "symbol_key",
    "exchange_pair",
    "window_mode",
    "window_label",
    "from_bucket",
    "to_bucket",
)


def _top(df: DataFrame, order: Sequence[Column], n: int, keys: Sequence[str]) -> DataFrame:
    """First ``n`` per group. A lone ``rank <= n`` lets Spark cut groups before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", place).filter(F.col("rank") <= n)


def rank_top_diffs(
    comparison: DataFrame,
    n: int,
    *,
    keys: Sequence[str] = GROUP,
    absolute: str = "absolute_diff_vs_mean",
    signed: str = "signed_diff_vs_mean",
) -> DataFrame:
    """Largest absolute, most positive and most negative differences, one ranking each."""
    rankings = (
        ("top_absolute_diff", F.col(absolute).desc_nulls_last()),
        ("top_signed_positive", F.col(signed).desc_nulls_last()),
        ("top_signed_negative", F.col(signed).asc_nulls_last()),
    )
    ties = [F.col(name).asc_nulls_last() for name in TIE_BREAKERS]
    ranked = None
    for rank_type, primary in rankings:
        part = _top(comparison, [primary, *ties], n, keys).withColumn("rank_type", F.lit(rank_type))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked


def _trusted(comparison: DataFrame) -> DataFrame:
    return comparison.filter(~F.col("small_denominator_flag"))


def top_by_abs_z(comparison: DataFrame, n: int) -> DataFrame:
    """Highest |z| per group among rows with sound denominators."""
    ties = [F.col(name).asc_nulls_last() for name in TIE_BREAKERS[1:]]
    return _top(_trusted(comparison), [F.abs("z_score_vs_normal").desc_nulls_last(), *ties], n, GROUP)


def top_by_extreme(comparison: DataFrame, n: int) -> DataFrame:
    """Most extreme percentile rank, either tail, per group among rows with sound denominators."""
    ties = [F.col(name).asc_nulls_last() for name in TIE_BREAKERS[1:]]
    scored = _trusted(comparison).withColumn(
        "percentile_extremity", tail_extremity(F.col("normal_percentile_rank"))
    )
    return _top(scored, [F.col("percentile_extremity").desc_nulls_last(), *ties], n, GROUP)


def ordered_sample(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order, as a top-k rather than a sort."""
    return df.orderBy(*order).limit(n)
