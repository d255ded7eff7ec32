"""Clustering candidates into events, and choosing among events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import naming
from tidemark.functions.timeaxis import bucket_date, bucket_start, floor_div
from tidemark.operators.ordered import with_row_number, with_run_number

# Symbols are compared lower-cased and kept as given.
CLUSTER_KEYS = ("exchange", "symbol_key", "direction", "is_ambiguous")


def with_keys(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({"exchange": F.lower("exchange"), "symbol_key": F.lower("symbol")})


def _runs(candidates: DataFrame, horizon: int, chunk_buckets: int) -> DataFrame:
    """Number the runs of candidates whose starts follow each other within ``horizon``.

    Intervals [start, start + horizon] of one length touch or overlap exactly when consecutive
    starts are at most ``horizon`` apart.
    """
    return with_run_number(
        candidates,
        keys=CLUSTER_KEYS,
        chunk=floor_div(F.col("start_bucket"), chunk_buckets),
        position="start_bucket",
        ties=["end_bucket"],
        gap=horizon,
        out="run",
    )


def _first(column: str) -> Column:
    return F.min_by(column, F.struct("start_bucket", "end_bucket"))


def _dated(clusters: DataFrame, bucket_seconds: float) -> DataFrame:
    return clusters.withColumn("selected_date", bucket_date(F.col("event_start_bucket"), bucket_seconds))


def _numbered(clusters: DataFrame, scope: str) -> DataFrame:
    """``group_number`` from ``run``, which counts per key over the whole range; restarted each date if asked."""
    if scope == "range":
        return clusters.withColumn("group_number", F.col("run"))
    if scope == "date":
        first = F.min("run").over(Window.partitionBy("selected_date", *CLUSTER_KEYS))
        return clusters.withColumn("group_number", F.col("run") - first + 1)
    raise ValueError(f"unknown numbering scope {scope!r}")


def rank_events(events: DataFrame) -> DataFrame:
    """``event_rank`` over all events in time order, counted date by date."""
    order = ["event_start_bucket", "exchange", "symbol_key", "direction", "is_ambiguous", "event_id"]
    return with_row_number(
        events, chunk=F.col("selected_date"), order=[F.col(name) for name in order], out="event_rank"
    )


def _as_events(dated: DataFrame, scope: str, bucket_seconds: float) -> DataFrame:
    identified = _numbered(dated, scope).withColumn(
        "event_id",
        naming.event_id(
            F.col("exchange"),
            F.col("symbol"),
            F.col("selected_date"),
            F.col("direction"),
            F.col("group_number"),
            F.col("is_ambiguous"),
        ),
    )
    return rank_events(identified).select(
        "event_id",
        "event_rank",
        "exchange",
        "symbol",
        "direction",
        "is_ambiguous",
        "event_start_bucket",
        "event_end_bucket",
        bucket_start(F.col("event_start_bucket"), bucket_seconds).alias("event_start_ts"),
        bucket_start(F.col("event_end_bucket"), bucket_seconds).alias("event_end_ts"),
        ((F.col("event_end_bucket") - F.col("event_start_bucket")) * F.lit(bucket_seconds))
        .cast("long")
        .alias("duration_seconds"),
        "base_price",
        "touch_price",
        "move_pct",
        "selected_date",
        "group_number",
        "raw_candidate_count",
        "candidate_group_start_bucket",
        "candidate_group_end_bucket",
    )


def chained_aggregates() -> list[Column]:
    """What a chain of candidates becomes: the strongest move, the latest end, the values of the first start."""
    # Strongest move, the earliest of equals; ambiguous candidates have no move and never win.
    strength = F.when(
        F.col("move_pct").isNotNull(), F.struct(F.abs("move_pct"), -F.col("start_bucket"), -F.col("end_bucket"))
    )
    return [
        _first("symbol").alias("symbol"),
        F.min("start_bucket").alias("event_start_bucket"),
        F.max("end_bucket").alias("event_end_bucket"),
        _first("base_price").alias("base_price"),
        F.max_by("touch_price", strength).alias("touch_price"),
        F.max_by("move_pct", strength).alias("move_pct"),
        F.count(F.lit(1)).alias("raw_candidate_count"),
        F.min("start_bucket").alias("candidate_group_start_bucket"),
        F.max("start_bucket").alias("candidate_group_end_bucket"),
    ]


def number_clusters(clusters: DataFrame, *, bucket_seconds: float = 1, scope: str = "range") -> DataFrame:
    """Events out of clusters that are not numbered yet: they count in time order per key."""
    dated = _dated(clusters, bucket_seconds)
    counted = with_row_number(
        dated, keys=CLUSTER_KEYS, chunk=F.col("selected_date"), order=[F.col("event_start_bucket")], out="run"
    )
    return _as_events(counted, scope, bucket_seconds)


def cluster_chained(
    candidates: DataFrame,
    horizon: int,
    *,
    bucket_seconds: float = 1,
    scope: str = "range",
    chunk_buckets: int = 86_400,
) -> DataFrame:
    """Merge candidates whose horizon intervals touch; keep the strongest move, the latest end.

    ``scope`` restarts the group numbers never ("range") or each date ("date").
    """
    runs = _runs(with_keys(candidates), horizon, chunk_buckets)
    clusters = runs.groupBy("run", *CLUSTER_KEYS).agg(*chained_aggregates())
    return _as_events(_dated(clusters, bucket_seconds), scope, bucket_seconds)


def _walk(starts: Column, first: Column, horizon: int) -> Column:
    """Cluster starts from ``first`` on: each is the first start more than ``horizon`` after the one before."""
    return F.aggregate(
        starts,
        F.array(first),
        lambda opened, start: F.when(
            start > F.element_at(opened, -1) + horizon, F.concat(opened, F.array(start))
        ).otherwise(opened),
    )


# Nodes of a block when transitions are composed; the number of levels is its logarithm of the number of chunks.
FAN = 128
BEFORE_ALL = -(2**62)


def _doors(starts: Column, reach: Column) -> Column:
    """The starts at which a chunk or block can be entered: those within reach of what lies before, and one more."""
    return F.slice(starts, F.lit(1), F.size(F.filter(starts, lambda start: start <= reach)) + 1)


def _door(ends: Column, last: Column, horizon: int) -> Column:
    """Where a walk whose last cluster starts at ``last`` enters; null if nothing is left outside that cluster."""
    return F.get(F.filter(ends, lambda end: end["entry"] > last + horizon), F.lit(0))


def _pass_through(nodes: Column, entry: Column, horizon: int) -> Column:
    """The last cluster start of a walk that enters the nodes at ``entry``."""
    return F.aggregate(
        nodes,
        entry - (horizon + 1),
        lambda last, node: F.coalesce(_door(node["ends"], last, horizon)["last"], last),
    )


def _entered(nodes: Column, last: Column, horizon: int) -> Column:
    """(node, entry) of the nodes that a walk coming from ``last`` enters."""
    nothing = F.struct(last.alias("last"), F.array().cast("array<struct<node:bigint,entry:bigint>>").alias("entered"))

    def enter(state: Column, node: Column) -> Column:
        door = _door(node["ends"], state["last"], horizon)
        seen = F.array(F.struct(node["node"].alias("node"), door["entry"].alias("entry")))
        after = F.struct(door["last"].alias("last"), F.concat(state["entered"], seen).alias("entered"))
        return F.when(door.isNotNull(), after).otherwise(state)

    return F.aggregate(nodes, nothing, enter)["entered"]


def _anchors(candidates: DataFrame, horizon: int, chunk_buckets: int, fan: int) -> DataFrame:
    """The starts that open a cluster, per key.

    Where a cluster starts depends on the one before. To keep that from being one long walk, the axis is cut into
    chunks wider than the horizon. The last cluster before a chunk reaches at most ``horizon`` into it, so a chunk can
    be entered at few starts only, and each chunk walks from all of them at once: a transition map. Maps of ``fan``
    neighbours compose into the map of a block, blocks into blocks of blocks, until one is left per key; then the entries
    are handed down again level by level. No row holds more than ``fan`` maps, however long the axis is.
    """
    width = max(chunk_buckets, horizon + 1)
    low, high = candidates.agg(F.min("start_bucket"), F.max("start_bucket")).first()
    if low is None:
        return candidates.select(*CLUSTER_KEYS, F.col("start_bucket").alias("anchor"))
    first, highest = low // width, high // width - low // width

    def reach(node: Column, size: int) -> Column:
        return (node * F.lit(size).cast("long") + F.lit(first)) * F.lit(width).cast("long") + F.lit(horizon)

    starts = candidates.groupBy((floor_div(F.col("start_bucket"), width) - F.lit(first)).alias("node"), *CLUSTER_KEYS).agg(
        F.array_sort(F.collect_set("start_bucket")).alias("starts")
    )
    walks = F.transform(_doors(F.col("starts"), reach(F.col("node"), 1)), lambda entry: _walk(F.col("starts"), entry, horizon))
    paths = starts.select("node", *CLUSTER_KEYS, walks.alias("paths"))
    ends = F.transform("paths", lambda path: F.struct(F.element_at(path, 1).alias("entry"), F.element_at(path, -1).alias("last")))
    nodes = paths.select("node", *CLUSTER_KEYS, ends.alias("ends"))
    levels, size = [], 1
    while True:
        blocks = nodes.groupBy(floor_div(F.col("node"), fan).alias("block"), *CLUSTER_KEYS).agg(
            F.array_sort(F.collect_list(F.struct("node", "ends"))).alias("nodes")
        )
        levels.append(blocks)
        size, highest = size * fan, highest // fan
        if not highest:
            break
        known = F.flatten(F.transform("nodes", lambda node: node["ends"]["entry"]))
        doors = _doors(known, reach(F.col("block"), size))
        through = F.transform(doors, lambda entry: F.struct(entry.alias("entry"), _pass_through(F.col("nodes"), entry, horizon).alias("last")))
        nodes = blocks.select(F.col("block").alias("node"), *CLUSTER_KEYS, through.alias("ends"))
    entered = None
    for blocks in reversed(levels):
        if entered is None:
            walked = blocks.withColumn("_last", F.lit(BEFORE_ALL))
        else:
            handed = entered.select(F.col("node").alias("block"), *CLUSTER_KEYS, (F.col("entry") - (horizon + 1)).alias("_last"))
            walked = blocks.join(handed, ["block", *CLUSTER_KEYS])
        entered = walked.select(*CLUSTER_KEYS, F.inline(_entered(F.col("nodes"), F.col("_last"), horizon)))
    taken = F.filter("paths", lambda path: F.element_at(path, 1) == F.col("entry"))
    return paths.join(entered, ["node", *CLUSTER_KEYS]).select(*CLUSTER_KEYS, F.explode(F.element_at(taken, 1)).alias("anchor"))


def cluster_anchored(
    candidates: DataFrame,
    horizon: int,
    *,
    bucket_seconds: float = 1,
    scope: str = "range",
    chunk_buckets: int = 4_096,
    fan: int = FAN,
) -> DataFrame:
    """A cluster spans ``horizon`` from its first candidate and keeps that candidate's values."""
    keyed = with_keys(candidates)
    # Anchors are more than one horizon apart: that of a start lies in its own horizon-wide block or
    # the one before.
    own_block = floor_div(F.col("anchor"), horizon + 1)
    placed = _anchors(keyed, horizon, chunk_buckets, fan).withColumn(
        "block", F.explode(F.array(own_block, own_block + 1))
    )
    ahead = F.col("start_bucket") - F.col("anchor")
    assigned = (
        keyed.withColumn("block", floor_div(F.col("start_bucket"), horizon + 1))
        .join(placed, ["block", *CLUSTER_KEYS])
        .filter((ahead >= 0) & (ahead <= horizon))
    )
    clusters = assigned.groupBy("anchor", *CLUSTER_KEYS).agg(
        _first("symbol").alias("symbol"),
        F.min("start_bucket").alias("event_start_bucket"),
        _first("end_bucket").alias("event_end_bucket"),
        _first("base_price").alias("base_price"),
        _first("touch_price").alias("touch_price"),
        _first("move_pct").alias("move_pct"),
        F.count(F.lit(1)).alias("raw_candidate_count"),
        F.min("start_bucket").alias("candidate_group_start_bucket"),
        F.max("start_bucket").alias("candidate_group_end_bucket"),
    )
    return number_clusters(clusters, bucket_seconds=bucket_seconds, scope=scope)


def event_order() -> list[Column]:
    return [F.col("event_start_bucket"), F.col("exchange"), F.lower("symbol"), F.col("event_id")]


def balanced_members(events: DataFrame, max_events: int) -> DataFrame:
    """Ids of at most ``max_events`` events, half UP and half DOWN in time order, filled up from the rest.

    Every step is a per-direction top-k or a top-k, so no task sees all events.
    """
    up = max_events - max_events // 2
    quota = F.when(F.col("direction") == "UP", up).when(F.col("direction") == "DOWN", max_events // 2).otherwise(0)
    ranked = events.withColumn(
        "_place", F.row_number().over(Window.partitionBy("direction").orderBy(*event_order()))
    ).filter(F.col("_place") <= up)
    first = ranked.filter(F.col("_place") <= quota).select("event_id", F.lit(0).alias("_turn"))
    fill = (
        events.join(first, "event_id", "left_anti")
        .orderBy(*event_order())
        .limit(max_events)
        .select("event_id", F.lit(1).alias("_turn"), "event_start_bucket", "exchange", "symbol")
    )
    both = first.select("event_id", "_turn", *_null_order(events)).unionByName(fill)
    return both.orderBy("_turn", *event_order()).limit(max_events).select("event_id")


def _null_order(events: DataFrame) -> list[Column]:
    return [
        F.lit(None).cast(events.schema[name].dataType).alias(name)
        for name in ("event_start_bucket", "exchange", "symbol")
    ]


def balanced_select(events: DataFrame, max_events: int) -> DataFrame:
    return events.join(balanced_members(events, max_events), "event_id", "left_semi")


def balance_note(available: DataFrame, selected: DataFrame) -> DataFrame:
    """One row saying whether UP and DOWN are balanced, and the counts if not."""
    counts = (
        available.select("direction", F.lit(1).alias("available"), F.lit(0).alias("selected"))
        .unionByName(selected.select("direction", F.lit(0).alias("available"), F.lit(1).alias("selected")))
        .agg(
            *[
                F.count_if((F.col("direction") == direction) & (F.col(role) == 1)).alias(
                    f"{role}_{direction.lower()}"
                )
                for role in ("available", "selected")
                for direction in ("UP", "DOWN")
            ]
        )
    )
    note = F.when(F.col("selected_up") == F.col("selected_down"), F.lit("balanced")).otherwise(
        F.format_string(
            "direction_balance_best_effort:available_up=%d,available_down=%d,selected_up=%d,selected_down=%d",
            "available_up",
            "available_down",
            "selected_up",
            "selected_down",
        )
    )
    return counts.select(note.alias("direction_balance_note"))
