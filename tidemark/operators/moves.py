"""Threshold moves: which bars reach +/- threshold within a look-ahead horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeaxis import bucket_date, bucket_start, floor_div
from tidemark.operators.ordered import with_previous

ENTITY = ("exchange", "symbol")
DIRECTIONS = ("UP", "DOWN")


def _with_block(bars: DataFrame, horizon: int) -> DataFrame:
    return bars.withColumn("block", floor_div(F.col("bucket"), horizon))


def block_extremes(bars: DataFrame, horizon: int) -> DataFrame:
    """Highest high and lowest low over each horizon-wide block and the block after it.

    The look-ahead of a bar in block b ends inside block b + 1, so a bar whose threshold lies
    beyond these extremes cannot have a hit.
    """
    owners = F.explode(F.array(F.col("block"), F.col("block") - 1))
    return (
        _with_block(bars, horizon)
        .select(*ENTITY, "high_price", "low_price", owners.alias("block"))
        .groupBy("block", *ENTITY)
        .agg(F.max("high_price").alias("peak"), F.min("low_price").alias("trough"))
    )


def lookahead_join(bars: DataFrame, horizon: int, base: DataFrame | None = None, hit: Column | None = None) -> DataFrame:
    """Each base bar with the bars of its next ``horizon`` buckets that satisfy ``hit``.

    An interval join on horizon-wide blocks: a base bar is copied to two blocks, not to
    ``horizon`` seconds, and a block of one entity has at most ``horizon`` bars.
    """
    base = _with_block(bars if base is None else base, horizon).select(
        *ENTITY,
        F.col("bucket").alias("start_bucket"),
        F.col("close_price").alias("base_price"),
        F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"),
    )
    future = _with_block(bars, horizon).select(
        *ENTITY, "block", F.col("bucket").alias("touch_bucket"), "high_price", "low_price"
    )
    ahead = F.col("touch_bucket") - F.col("start_bucket")
    reached = (ahead >= 1) & (ahead <= horizon)
    joined = base.join(future, [*ENTITY, "block"]).filter(reached if hit is None else reached & hit)
    return joined.drop("block")


def levels(threshold_pct: float) -> tuple[Column, Column]:
    """The prices that a rise and a fall must reach."""
    base = F.col("base_price")
    return base * F.lit(1.0 + threshold_pct / 100.0), base * F.lit(1.0 - threshold_pct / 100.0)


def touch_aggregates(up: Column, down: Column) -> list[Column]:
    """First touches out of the hits of a base bar; ``up`` and ``down`` say which way a hit reaches."""
    up_at, down_at = F.when(up, F.col("touch_bucket")), F.when(down, F.col("touch_bucket"))
    return [
        F.first("base_price").alias("base_price"),
        F.min(up_at).alias("up_bucket"),
        F.min_by("high_price", up_at).alias("up_price"),
        F.min(down_at).alias("down_bucket"),
        F.min_by("low_price", down_at).alias("down_price"),
    ]


def first_touch(bars: DataFrame, threshold_pct: float, horizon: int, *, prefilter: bool = True) -> DataFrame:
    """Per base bar, the first later bar whose high, and whose low, reaches the threshold."""
    up_level, down_level = levels(threshold_pct)
    base = bars
    if prefilter:
        reachable = (F.col("peak") >= up_level) | (F.col("trough") <= down_level)
        base = (
            _with_block(bars, horizon)
            .withColumn("base_price", F.col("close_price"))
            .join(block_extremes(bars, horizon), ["block", *ENTITY])
            .filter(reachable)
            .select(*ENTITY, "bucket", "close_price")
        )
    up, down = F.col("high_price") >= up_level, F.col("low_price") <= down_level
    hits = lookahead_join(bars, horizon, base=base, hit=up | down)
    return hits.groupBy("start_bucket", *ENTITY).agg(*touch_aggregates(up, down))


def resolve_direction(up_bucket: Column, down_bucket: Column) -> Column:
    """The earlier touch wins; the same bucket touching both ways is ambiguous."""
    return (
        F.when(up_bucket.isNull() & down_bucket.isNull(), F.lit(None).cast("string"))
        .when(down_bucket.isNull() | (up_bucket < down_bucket), F.lit("UP"))
        .when(up_bucket.isNull() | (down_bucket < up_bucket), F.lit("DOWN"))
        .otherwise(F.lit("AMBIGUOUS"))
    )


def scan_moves(
    bars: DataFrame, threshold_pct: float, horizon: int, *, bucket_seconds: float = 1, prefilter: bool = True
) -> DataFrame:
    """Move candidates, ambiguous ones included and flagged (null touch price and move)."""
    touched = first_touch(bars, threshold_pct, horizon, prefilter=prefilter)
    direction = resolve_direction(F.col("up_bucket"), F.col("down_bucket"))
    rising = F.col("direction") == "UP"
    falling = F.col("direction") == "DOWN"
    end_bucket = F.when(falling, F.col("down_bucket")).otherwise(F.col("up_bucket"))
    touch_price = F.when(rising, F.col("up_price")).when(falling, F.col("down_price"))
    return (
        touched.withColumn("direction", direction)
        .withColumns({"end_bucket": end_bucket, "touch_price": touch_price})
        .select(
            *ENTITY,
            "direction",
            (F.col("direction") == "AMBIGUOUS").alias("is_ambiguous"),
            "start_bucket",
            "end_bucket",
            bucket_start(F.col("start_bucket"), bucket_seconds).alias("start_ts"),
            bucket_start(F.col("end_bucket"), bucket_seconds).alias("end_ts"),
            ((F.col("end_bucket") - F.col("start_bucket")) * F.lit(bucket_seconds)).cast("long").alias(
                "duration_seconds"
            ),
            "base_price",
            "touch_price",
            ((F.col("touch_price") / F.col("base_price") - F.lit(1.0)) * F.lit(100.0)).alias("move_pct"),
        )
    )


def label_candidates(candidates: DataFrame, *, bucket_seconds: float = 1, **labels: object) -> DataFrame:
    """Stamp detector settings on candidates; ``selected_date`` defaults to the start's own date."""
    stamped = candidates.withColumns({name: F.lit(value) for name, value in labels.items()})
    if "selected_date" not in labels:
        stamped = stamped.withColumn("selected_date", bucket_date(F.col("start_bucket"), bucket_seconds))
    return stamped.withColumn("source_stream", F.lit("trade"))


def approx_groups(candidates: DataFrame, horizon: int, *, chunk_buckets: int = 86_400) -> DataFrame:
    """Candidates that start a new run: no earlier one of their venue, symbol and direction within horizon."""
    with_prev = with_previous(
        candidates,
        keys=[*ENTITY, "direction"],
        chunk=floor_div(F.col("start_bucket"), chunk_buckets),
        order=["start_bucket"],
        values={"start_bucket": "previous_start"},
    )
    gap = F.col("start_bucket") - F.col("previous_start")
    return with_prev.filter(F.col("previous_start").isNull() | (gap > horizon)).drop("previous_start")
