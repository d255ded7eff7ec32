"""Matched control windows: where nothing happened, yet activity was alike."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import naming
from tidemark.functions.exact import exact_sum
from tidemark.functions.timeaxis import bucket_date, bucket_start, floor_div
from tidemark.operators.ordered import with_nearest_known
from tidemark.operators.profiles import ProfileWindow
from tidemark.sources.stages import Stage, write_stage

ACTIVITY = ("trade_count", "trade_volume", "trade_notional")


def _total(name: str, values: Column) -> Column:
    """Counts are whole numbers; quantities and notionals are doubles, whose sum must not depend on their order."""
    return F.sum(values) if name == "trade_count" else exact_sum(values)


def common_range(bars: DataFrame) -> DataFrame:
    """One row: the bucket range in which every venue has bars."""
    per_venue = bars.groupBy("exchange").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    return per_venue.agg(F.max("lo").alias("common_start"), F.min("hi").alias("common_end"))


def _span_bounds(
    span: Column, common_start: Column, common_end: Column, span_buckets: int, lookback: int, horizon: int
) -> tuple[Column, Column]:
    """First and last admissible anchor of a span (a day): its window and horizon stay inside span and range."""
    opening = span * F.lit(span_buckets)
    first = F.greatest(common_start, opening) + F.lit(lookback)
    last = F.least(common_end, opening + F.lit(span_buckets)) - F.lit(horizon)
    return first, last


def enumerate_anchors(
    bars: DataFrame, *, lookback: int, horizon: int, step: int, span_buckets: int, spans: DataFrame | None = None
) -> DataFrame:
    """Candidate anchors every ``step`` buckets within each span of ``span_buckets`` (a day, usually).

    ``spans`` (column ``span``) restricts the result to the spans that are needed.
    """
    ends = common_range(bars)
    all_spans = F.sequence(
        floor_div(F.col("common_start"), span_buckets), floor_div(F.col("common_end"), span_buckets)
    )
    listed = ends.filter(F.col("common_start") <= F.col("common_end")).withColumn("span", F.explode(all_spans))
    if spans is not None:
        listed = listed.join(spans.select("span").distinct(), "span", "left_semi")
    first, last = _span_bounds(
        F.col("span"), F.col("common_start"), F.col("common_end"), span_buckets, lookback, horizon
    )
    return (
        listed.withColumns({"first_anchor": first, "last_anchor": last})
        .filter(F.col("first_anchor") <= F.col("last_anchor"))
        .repartition("span")
        .select(
            "span",
            "first_anchor",
            F.posexplode(F.sequence("first_anchor", "last_anchor", F.lit(step).cast("long"))).alias(
                "anchor_index", "anchor_bucket"
            ),
        )
    )


def nearest_event_distance(anchors: DataFrame, starts: DataFrame, span_buckets: int) -> DataFrame:
    """Add the nearest candidate start at or before, and at or after, each anchor, and the distance.

    A two-sided as-of over the union of both, sorted span by span. ``starts`` has ``start_bucket``.
    """
    marks = starts.select(F.col("start_bucket").alias("_position")).distinct().withColumn("_start", F.col("_position"))
    targets = anchors.withColumns({"_position": F.col("anchor_bucket"), "_start": F.lit(None).cast("long")})
    merged = targets.unionByName(marks, allowMissingColumns=True)
    known = with_nearest_known(
        merged,
        chunk=floor_div(F.col("_position"), span_buckets),
        position="_position",
        value="_start",
        before="previous_start",
        after="next_start",
    ).filter(F.col("_start").isNull())
    gaps = F.least(F.col("anchor_bucket") - F.col("previous_start"), F.col("next_start") - F.col("anchor_bucket"))
    return known.select(
        *anchors.columns, "previous_start", "next_start", gaps.alias("nearest_candidate_distance")
    )


def anchor_exclusion(
    anchors: DataFrame, starts: DataFrame, *, lookback: int, horizon: int, proximity: int, span_buckets: int
) -> DataFrame:
    """Why an anchor may not serve as a control, or null. The first reason that applies counts.

    A start on the anchor itself has distance 0, so past the proximity rule "at or after" is "after".
    """
    near = nearest_event_distance(anchors, starts, span_buckets)
    anchor = F.col("anchor_bucket")
    reason = (
        F.when(F.col("nearest_candidate_distance") <= proximity, F.lit("candidate_within_anchor_proximity"))
        .when(F.col("next_start") - anchor <= horizon, F.lit("candidate_inside_post_anchor_horizon"))
        .when(anchor - F.col("previous_start") <= lookback, F.lit("candidate_inside_normal_window"))
    )
    return near.withColumn("exclusion_reason", reason)


def exclusion_counts(anchors: DataFrame) -> DataFrame:
    reason = F.coalesce("exclusion_reason", F.lit("eligible"))
    return anchors.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("anchor_count"))


def anchor_activity(
    market: DataFrame,
    bars: DataFrame,
    *,
    exchanges: Sequence[str],
    lookback: int,
    horizon: int,
    step: int,
    span_buckets: int,
    spans: DataFrame | None = None,
) -> DataFrame:
    """Trade and quote activity in the window before every anchor, per venue and symbol.

    Anchors are regular, so buckets are summed once into slots of gcd(lookback, step) whose edges
    are also window edges; a slot then counts towards lookback / step anchors. Nothing is compared
    by range, and raw rows never meet anchors.
    """
    ends = common_range(bars)
    first, last = _span_bounds(
        F.col("span"),
        ends.select("common_start").scalar(),
        ends.select("common_end").scalar(),
        span_buckets,
        lookback,
        horizon,
    )
    grain = gcd(lookback, step)
    slots_per_step, slots_per_window = step // grain, lookback // grain
    placed = market.filter(F.col("exchange").isin(*[name.lower() for name in exchanges]))
    if "span" not in market.columns:  # else the table is laid out by it, and only the spans asked for are read
        placed = placed.withColumn("span", floor_div(F.col("bucket"), span_buckets))
    if spans is not None:
        days = spans.select("span").distinct()  # one number for each day on the axis at most
        placed = placed.join(F.broadcast(days.filter("span IS NOT NULL")), "span", "left_semi")
    slotted = (
        placed.withColumns({"_first": first, "_last": last})
        .filter(F.col("bucket") >= F.col("_first") - lookback)
        .withColumn("_slot", floor_div(F.col("bucket") - F.col("_first"), grain))
        .groupBy("_slot", "span", "exchange", "symbol", "_first", "_last")
        .agg(
            *[_total(name, F.col(name)).alias(name) for name in ACTIVITY],
            F.sum("bbo_update_count").alias("quote_count"),
        )
    )
    nearest = F.greatest(floor_div(F.col("_slot"), slots_per_step) + 1, F.lit(0).cast("long"))
    farthest = F.least(
        floor_div(F.col("_slot") + slots_per_window, slots_per_step), floor_div(F.col("_last") - F.col("_first"), step)
    )
    return (
        slotted.withColumns({"_near": nearest, "_far": farthest})
        .filter(F.col("_near") <= F.col("_far"))
        .withColumn("_index", F.explode(F.sequence("_near", "_far")))
        .withColumn("anchor_bucket", F.col("_first") + F.col("_index") * F.lit(step))
        .groupBy("anchor_bucket", "span", "exchange", "symbol")
        .agg(
            *[F.coalesce(_total(name, F.col(name)), F.lit(0)).alias(f"{name}_sum") for name in ACTIVITY],
            F.sum("quote_count").alias("quote_count_sum"),
        )
    )


def activity_sums(activity: DataFrame) -> DataFrame:
    """Trade count, quantity and notional per anchor and venue, venues that traded only."""
    return (
        activity.filter(F.col("trade_count_sum") > 0)
        .groupBy("span", "anchor_bucket", "exchange")
        .agg(*[_total(name, F.col(f"{name}_sum")).alias(f"{name}_sum") for name in ACTIVITY])
    )


def window_quality(anchors: DataFrame, activity: DataFrame, *, expected_exchanges: int, lookback: int) -> DataFrame:
    """Coverage of each anchor's window and the first quality rule it fails, or null."""
    traded, quoted = F.col("trade_count_sum") > 0, F.col("quote_count_sum") > 0
    per_venue = activity.groupBy("anchor_bucket", "exchange").agg(
        F.sum("trade_count_sum").alias("trades"),
        F.sum("quote_count_sum").alias("quotes"),
        F.count_if(traded | quoted).alias("symbols"),
    )
    seen = (F.col("trades") > 0) | (F.col("quotes") > 0)
    per_anchor = per_venue.groupBy("anchor_bucket").agg(
        F.sum("trades").alias("trade_count"),
        F.sum("quotes").alias("bbo_count"),
        F.count_if(F.col("trades") > 0).alias("trade_exchange_count"),
        F.count_if(F.col("quotes") > 0).alias("bbo_exchange_count"),
        F.sum("symbols").alias("snapshot_exchange_symbol_count"),
        F.count_if(seen).alias("snapshot_exchange_count"),
    )
    counted = [name for name in per_anchor.columns if name != "anchor_bucket"]
    rated = anchors.join(per_anchor, "anchor_bucket", "left").fillna(0, subset=counted)
    rows = F.col("snapshot_exchange_symbol_count") * F.lit(lookback)
    failure = (
        F.when(F.col("trade_count") == 0, F.lit("trade_count_zero"))
        .when(F.col("bbo_count") == 0, F.lit("bbo_count_zero"))
        .when(F.col("trade_exchange_count") < expected_exchanges, F.lit("trade_exchange_coverage"))
        .when(F.col("bbo_exchange_count") < expected_exchanges, F.lit("bbo_exchange_coverage"))
        .when(F.col("snapshot_row_count") != expected_exchanges * lookback, F.lit("snapshot_row_count"))
        .when(F.col("snapshot_exchange_count") < expected_exchanges, F.lit("snapshot_exchange_coverage"))
    )
    return rated.withColumn("snapshot_row_count", rows).withColumn("quality_failure", failure)


def first_quality_window(rated: DataFrame) -> DataFrame:
    """The earliest eligible anchor of each span that passes the quality rules."""
    usable = rated.filter(F.col("exclusion_reason").isNull() & F.col("quality_failure").isNull())
    return usable.groupBy("span").agg(F.min("anchor_bucket").alias("anchor_bucket"))


def _packed_activity(rows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Activity of all venues in one array ordered by venue (as many entries as venues)."""
    logs = [F.log(F.col(f"{name}_sum") + F.lit(1.0)).alias(name) for name in ACTIVITY]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("exchange", *logs))).alias(out))


def event_activity(entity_profile: DataFrame, window_label: str) -> DataFrame:
    """Activity of each event's own window, per venue."""
    return (
        entity_profile.filter(F.col("window_label") == window_label)
        .groupBy("event_id", F.lower("exchange").alias("exchange"))
        .agg(*[_total(name, F.col(f"{name}_sum")).alias(f"{name}_sum") for name in ACTIVITY])
    )


def window_activity(sparse: DataFrame, window: ProfileWindow) -> DataFrame:
    """The same sums straight from the market buckets inside each window (``window_buckets``), before any panel is built."""
    offset = F.col("window_end_bucket") - F.col("bucket")
    inside = offset.between(window.first, window.last)
    return sparse.groupBy("event_id", F.lower("exchange").alias("exchange")).agg(
        *[F.coalesce(_total(name, F.when(inside, F.col(name))), F.lit(0)).alias(f"{name}_sum") for name in ACTIVITY]
    )


def _gaps(event: Column, anchor: Column) -> Column:
    """The sum of |log1p| differences over venues and measures, both packed in the same order of venues."""

    def gap(one: Column, other: Column) -> Column:
        return sum((F.abs(other[name] - one[name]) for name in ACTIVITY[1:]), F.abs(other[ACTIVITY[0]] - one[ACTIVITY[0]]))

    return F.aggregate(F.zip_with(event, anchor, gap), F.lit(0.0), lambda acc, one: acc + one)


# Events of a span that share one copy of its anchors; a span with more of them gets more copies.
EVENTS_PER_COPY = 50_000


def _spread(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the copy of their span they are dealt to, and (span, _copies): as many as its events ask for."""
    copies = F.ceil(F.count(F.lit(1)) / F.lit(EVENTS_PER_COPY)).cast("int").alias("_copies")
    per_span = events.groupBy("span").agg(copies)
    dealt = events.join(per_span, "span").withColumn("_copy", F.pmod(F.xxhash64("event_id"), F.col("_copies")).cast("int"))
    return dealt.drop("_copies"), per_span


def _copied(rows: DataFrame, per_span: DataFrame) -> DataFrame:
    copy = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy")
    return rows.join(per_span, "span").select(*rows.columns, copy)


def activity_distance(events: DataFrame, own: DataFrame, anchors: DataFrame, sums: DataFrame, exchanges: int) -> DataFrame:
    """Mean |log1p| distance over venues x measures between each event and each anchor of its span.

    The whole table, for reports; ``match_controls`` forms only the pairs it needs. Venues are packed into one row
    per anchor and per event first, so the only pairs formed are (event, anchor of its span). Rows lacking a
    venue are dropped: the mean needs the full grid. A span may hold a large share of all events but never more
    anchors than fit into it, so its anchors are copied as its events ask for, and these split among the copies.
    """
    by_event = _packed_activity(own, ["event_id"], "_event").filter(F.size("_event") == exchanges)
    by_anchor = _packed_activity(sums, ["span", "anchor_bucket"], "_anchor").filter(F.size("_anchor") == exchanges)
    dealt, per_span = _spread(events.select("event_id", "span"))
    eligible = _copied(anchors.join(by_anchor, ["span", "anchor_bucket"]), per_span)
    pairs = dealt.join(by_event, "event_id").join(eligible, ["span", "_copy"])
    distance = _gaps(F.col("_event"), F.col("_anchor")) / F.lit(float(exchanges * len(ACTIVITY)))
    return pairs.withColumn("activity_distance", distance).drop("_event", "_anchor", "_copy")


def _spaced(ordered: Column, count: int, spacing: int) -> Column:
    """Walk candidates in order, keep one if it is ``spacing`` away from all kept, stop at ``count``."""
    kept_type = "array<struct<distance:double,nearest:bigint,anchor:bigint>>"
    return F.aggregate(
        ordered,
        F.array().cast(kept_type),
        lambda kept, row: F.when(
            (F.size(kept) < count) & ~F.exists(kept, lambda k: F.abs(k["anchor"] - row["anchor"]) < spacing),
            F.concat(kept, F.array(row)),
        ).otherwise(kept),
    )


def spaced_select(candidates: DataFrame, *, count: int, spacing: int, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Up to ``count`` anchors per event: closest activity first, farthest from candidates, earliest,
    and no two nearer than ``spacing``.

    Each choice depends on those before it. The list folded per event is the anchors of one span, so
    its length is bounded by span / step whatever the size of the data.
    """
    # Ascending order: distance, then remoteness negated (absent remoteness last), then anchor.
    remoteness = F.coalesce(-F.col("nearest_candidate_distance"), F.lit(1)).cast("long")
    row = F.struct(
        F.col("activity_distance").alias("distance"),
        remoteness.alias("nearest"),
        F.col("anchor_bucket").cast("long").alias("anchor"),
    )
    chosen = candidates.groupBy(*keys).agg(_spaced(F.array_sort(F.collect_list(row)), count, spacing).alias("_kept"))
    return _picked(chosen, keys)


BLOCK = 64  # anchors next to each other along the coordinate
FIRST_BLOCKS = 4  # that an event looks at first; four times as many in each later round
SLACK = 1e-9  # far above what rounding can take from a bound


def _coordinate(packed: Column) -> Column:
    """The sum of all measures: two rows lie at least as far apart as their coordinates do."""
    return F.aggregate(packed, F.lit(0.0), lambda acc, one: acc + sum((one[name] for name in ACTIVITY[1:]), one[ACTIVITY[0]]))


def _anchor_blocks(anchors: DataFrame, by_anchor: DataFrame, block: int) -> DataFrame:
    """(span, block, low, high, members): the anchors of a span in order of their coordinate, ``block`` to a row."""
    placed = anchors.join(by_anchor, ["span", "anchor_bucket"]).withColumn("_at", _coordinate(F.col("_anchor")))
    along = Window.partitionBy("span").orderBy("_at", "anchor_bucket")
    ranked = placed.withColumn("block", F.floor((F.row_number().over(along) - 1) / F.lit(block)).cast("int"))
    member = F.struct(F.col("anchor_bucket").cast("long").alias("anchor"), "nearest_candidate_distance", "_anchor")
    return ranked.groupBy("span", "block").agg(F.min("_at").alias("low"), F.max("_at").alias("high"), F.collect_list(member).alias("members"))


def _search_orders(events: DataFrame, by_event: DataFrame, blocks: DataFrame) -> DataFrame:
    """Events with their activity and the blocks of their span, nearest bound first."""
    dealt, per_span = _spread(events.select("event_id", "span"))
    edges = blocks.groupBy("span").agg(F.collect_list(F.struct("block", "low", "high")).alias("_edges"))
    met = dealt.join(by_event, "event_id").join(_copied(edges, per_span), ["span", "_copy"])
    at = _coordinate(F.col("_event"))

    def bound(edge: Column) -> Column:
        apart = F.greatest(edge["low"] - F.col("_at"), F.col("_at") - edge["high"], F.lit(0.0))
        return F.struct(apart.alias("bound"), edge["block"].alias("block"))

    return met.withColumn("_at", at).select("event_id", "span", "_copy", "_event", F.array_sort(F.transform("_edges", bound)).alias("_order"))


def nearest_controls(
    events: DataFrame,
    own: DataFrame,
    anchors: DataFrame,
    sums: DataFrame,
    *,
    exchanges: int,
    count: int,
    spacing: int,
    block: int = BLOCK,
    first_blocks: int = FIRST_BLOCKS,
    stage: Stage = write_stage,
) -> DataFrame:
    """What ``spaced_select`` picks from ``activity_distance``, without forming all pairs.

    Best-first search. The anchors of a span are sorted by one coordinate and cut into blocks; the gap between an event
    and a block along it is a lower bound of their distances. An event looks at its nearest blocks; candidates
    closer than the bound of the first block left out are final, and if ``count`` of them can be kept, nothing further
    away could change the choice. Events that come short look at four times as many blocks, until their
    span is exhausted. ``pairs`` says how many anchors an event looked at in its last round.
    """
    by_event = _packed_activity(own, ["event_id"], "_event").filter(F.size("_event") == exchanges)
    by_anchor = _packed_activity(sums, ["span", "anchor_bucket"], "_anchor").filter(F.size("_anchor") == exchanges)
    blocks = stage(_anchor_blocks(anchors, by_anchor, block), "anchor_blocks")
    waiting = stage(_search_orders(events, by_event, blocks), "search_orders")
    width = float(exchanges * len(ACTIVITY))
    done, taken = None, first_blocks
    while True:
        following = F.get(F.col("_order"), F.lit(taken))["bound"]  # null: no block is left out
        asked = waiting.select("event_id", "span", "_event", following.alias("_bound"), F.explode(F.slice("_order", 1, taken)).alias("_block"))

        def measured(member: Column) -> Column:
            # Ascending order: distance, then remoteness negated (absent remoteness last), then anchor.
            remoteness = F.coalesce(-member["nearest_candidate_distance"], F.lit(1)).cast("long")
            distance = _gaps(F.col("_event"), member["_anchor"]) / F.lit(width)
            return F.struct(distance.alias("distance"), remoteness.alias("nearest"), member["anchor"].alias("anchor"))

        met = asked.withColumn("block", F.col("_block.block")).join(blocks.select("span", "block", "members"), ["span", "block"])
        near = F.filter(
            F.transform("members", measured),
            lambda row: F.col("_bound").isNull() | (row["distance"] * F.lit(width) < F.col("_bound") - F.lit(SLACK)),
        )
        found = met.groupBy("event_id").agg(
            F.flatten(F.collect_list(near)).alias("_near"), F.sum(F.size("members")).alias("pairs"), F.first("_bound").alias("_bound")
        )
        kept = _spaced(F.array_sort("_near"), count, spacing)
        searched = found.select("event_id", "pairs", "_bound", kept.alias("_kept"))
        round_ = stage(searched.withColumn("_final", F.col("_bound").isNull() | (F.size("_kept") == count)), "search_round")
        final = round_.filter("_final").select("event_id", "pairs", "_kept")
        done = final if done is None else done.unionByName(final)
        short = round_.filter("not _final").select("event_id")
        if short.isEmpty():
            return _picked(done, ["event_id", "pairs"])
        waiting, taken = waiting.join(short, "event_id", "left_semi"), taken * 4


def _picked(chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return chosen.select(*keys, F.posexplode("_kept").alias("_place", "_row")).select(
        *keys,
        (F.col("_place") + 1).alias("sample_rank"),
        F.col("_row.anchor").alias("anchor_bucket"),
        F.col("_row.distance").alias("activity_distance"),
        F.when(F.col("_row.nearest") <= 0, -F.col("_row.nearest")).alias("nearest_candidate_distance"),
    )


def match_controls(
    events: DataFrame,
    own_activity: DataFrame,
    anchors: DataFrame,
    sums: DataFrame,
    *,
    exchanges: int,
    count: int,
    spacing: int,
    bucket_seconds: float = 1,
    stage: Stage = write_stage,
) -> DataFrame:
    """Control samples of all events at once; an event short of ``count`` controls gets none.

    ``anchors`` are rated by ``anchor_exclusion`` and ``window_quality``; ``events`` carry ``span``.
    """
    usable = anchors.filter(F.col("exclusion_reason").isNull() & F.col("quality_failure").isNull()).select(
        "span", "anchor_bucket", "nearest_candidate_distance"
    )
    chosen = nearest_controls(
        events, own_activity, usable, sums, exchanges=exchanges, count=count, spacing=spacing, stage=stage
    )
    complete = chosen.groupBy("event_id").agg(F.count(F.lit(1)).alias("_found")).filter(F.col("_found") == count)
    return chosen.join(complete.select("event_id"), "event_id", "left_semi").select(
        "event_id",
        naming.sample_id(F.col("event_id"), F.col("sample_rank")).alias("sample_id"),
        "sample_rank",
        "anchor_bucket",
        bucket_start(F.col("anchor_bucket"), bucket_seconds).alias("anchor_ts"),
        bucket_date(F.col("anchor_bucket"), bucket_seconds).alias("selected_date"),
        "activity_distance",
        "nearest_candidate_distance",
    )
