"""Identifiers for events, control samples and venue pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(
    exchange: Column, symbol: Column, date: Column, direction: Column, number: Column, ambiguous: Column | None = None
) -> Column:
    """``venue_symbol_yyyymmdd_direction[_ambiguous]_nnn``, lower-cased."""
    tag = F.lit("") if ambiguous is None else F.when(ambiguous, F.lit("_ambiguous")).otherwise(F.lit(""))
    return F.format_string(
        "%s_%s_%s_%s%s_%03d",
        F.lower(exchange),
        F.lower(symbol),
        date,
        F.lower(direction),
        tag,
        number,
    )


def sample_id(owner: Column, rank: Column) -> Column:
    return F.format_string("%s__normal_%03d", owner, rank)


def sample_owner(sample: Column) -> Column:
    """The event id inside a control sample id."""
    return F.regexp_extract(sample, r"^(.*)__normal_[0-9]{3,}$", 1)


def pair_name(a: Column, b: Column) -> Column:
    return F.concat_ws("__", F.lower(a), F.lower(b))
