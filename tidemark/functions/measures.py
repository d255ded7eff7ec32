"""Quote, trade and comparison arithmetic as null-safe column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000.0
WEAK_DENOMINATOR = 1e-9


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null where either is null or the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator)


def return_bps(first: Column, last: Column) -> Column:
    return F.when(first != 0, (last / first - F.lit(1.0)) * F.lit(BPS))


def diff_bps(a: Column, b: Column) -> Column:
    return F.when(b != 0, (a - b) / b * F.lit(BPS))


def relative_change(before: Column, after: Column) -> Column:
    return F.when(before != 0, (after - before) / F.abs(before))


def z_score(value: Column, mean: Column, stddev: Column) -> Column:
    return F.when(stddev != 0, (value - mean) / stddev)


def weak(value: Column) -> Column:
    """True where a denominator is null or technically zero."""
    return value.isNull() | (F.abs(value) <= F.lit(WEAK_DENOMINATOR))


def tail_extremity(percentile: Column) -> Column:
    return F.greatest(percentile, F.lit(1.0) - percentile)


def side_of(side: Column) -> Column:
    """buy / sell / null from the spellings venues use."""
    word = F.lower(F.trim(side))
    return F.when(word.isin("buy", "b"), F.lit("buy")).when(word.isin("sell", "s"), F.lit("sell"))


def quote_metrics(bid_price: Column, bid_qty: Column, ask_price: Column, ask_qty: Column) -> dict[str, Column]:
    mid = (bid_price + ask_price) / F.lit(2.0)
    spread = ask_price - bid_price
    return {
        "mid_price": mid,
        "spread": spread,
        "spread_bps": ratio(spread, mid) * F.lit(BPS),
        "book_imbalance": ratio(bid_qty - ask_qty, bid_qty + ask_qty),
    }
