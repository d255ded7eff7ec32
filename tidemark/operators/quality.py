"""Data-quality profiles of ticks and summaries of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timeaxis import bucket_date, bucket_index, floor_div
from tidemark.operators.ordered import Step, summarise_steps
from tidemark.sources.stages import Stage, write_stage

ENTITY = ("exchange", "symbol")
ACCURACY = 10_000


def _level(names: Sequence[str]) -> Column:
    """Name of a grouping set: the columns it groups by, or "all"."""
    kept = [F.when(F.grouping(name) == 0, F.lit(name)) for name in names]
    return F.coalesce(F.nullif(F.concat_ws("_", *kept), F.lit("")), F.lit("all"))


PERCENTS = {"p50": 50, "p95": 95, "p99": 99}
CELLS = 64  # equi-depth cells of a sequence; each is cut further by its width where it holds too many rows


def _with_cell(df: DataFrame, value: str, cells: int = CELLS) -> DataFrame:
    """``_cell`` of each row's value: a binary search of its ``edges``, the lower edges of ``cells`` cells."""
    placed = df.withColumn("_cell", F.lit(0))
    step = cells // 2
    while step:
        further = F.col(value) >= F.get("edges", F.col("_cell") + step)
        placed = placed.withColumn("_cell", F.col("_cell") + F.when(further, step).otherwise(0))
        step //= 2
    return placed


def exact_quantiles(counted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(_key, p50, p95, p99): the least value of each key that so many percent of its rows do not exceed.

    ``counted`` has one row per key and value, with how many ``rows`` have it; ``_key`` is ``key_of(keys)``. Values are
    cut into equi-depth cells by approximate edges and ranks are counted from cell to cell, so only the cells that hold a
    quantile are put in order. The edges cut the work; the results do not depend on them.
    """
    present = counted.filter(F.col(value).isNotNull()).select(key_of(keys), value, "rows")
    inner = F.percentile_approx(value, [i / CELLS for i in range(1, CELLS)], ACCURACY)
    edges = present.groupBy("_key").agg(F.concat(F.array(F.min(value)), inner).alias("edges"))
    placed = _with_cell(present.join(edges, "_key"), value).drop("edges")
    along = Window.partitionBy("_key").orderBy("_cell")
    cells = placed.groupBy("_key", "_cell").agg(F.sum("rows").alias("_in"))
    cells = cells.withColumns({"_upto": F.sum("_in").over(along), "_all": F.sum("_in").over(Window.partitionBy("_key"))})
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), F.expr(f"(_all * {n} + 99) div 100").alias("_rank")) for name, n in PERCENTS.items()])
    ranks = cells.select("*", F.inline(wanted)).filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_in")))
    ranks = ranks.select("_key", "_cell", "_name", (F.col("_rank") - F.col("_upto") + F.col("_in")).alias("_rank"))
    inside = Window.partitionBy("_key", "_cell", "_name").orderBy(value)
    reached = placed.join(ranks, ["_key", "_cell"]).withColumn("_upto", F.sum("rows").over(inside))
    found = reached.filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("rows")))
    return found.groupBy("_key").agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in PERCENTS])


def key_of(keys: Sequence[str]) -> Column:
    """Keys as one struct, which is never null and so joins by plain equality."""
    return (F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).alias("_key")


def _count_levels(base: DataFrame) -> DataFrame:
    return (
        base.groupingSets([["exchange"], ["exchange", "symbol"], []], *ENTITY)
        .agg(
            _level(ENTITY).alias("profile_level"),
            F.sum("rows").alias("row_count"),
            F.count_distinct("exchange").alias("distinct_exchange_count"),
            F.count_distinct("symbol").alias("distinct_symbol_count"),
        )
        .select("profile_level", *ENTITY, "row_count", "distinct_exchange_count", "distinct_symbol_count")
    )


def count_profile(ticks: DataFrame) -> DataFrame:
    """Rows per venue, per venue and symbol, and overall, with distinct counts.

    Everything follows from the counts per venue and symbol, so rows are aggregated once.
    """
    return _count_levels(ticks.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("rows")))


def latency_profile(ticks: DataFrame, stage: Stage = write_stage) -> DataFrame:
    """Time range and receive-minus-event latency in milliseconds, with exact quantiles.

    Rows are aggregated once, per latency (a table kept by ``stage``); everything else follows from these.
    """
    times = [ends(name).alias(f"{label}_{name}") for name in ("ts_event", "ts_recv") for label, ends in (("min", F.min), ("max", F.max))]
    latency = F.unix_micros("ts_recv") - F.unix_micros("ts_event")
    counted = stage(ticks.groupBy(latency.alias("latency")).agg(F.count(F.lit(1)).alias("rows"), *times), "latencies")
    ms = F.col("latency") / F.lit(1000.0)
    rows = F.when(F.col("latency").isNotNull(), F.col("rows"))
    profile = counted.agg(
        F.min("min_ts_event").alias("min_ts_event"),
        F.max("max_ts_event").alias("max_ts_event"),
        F.min("min_ts_recv").alias("min_ts_recv"),
        F.max("max_ts_recv").alias("max_ts_recv"),
        F.min(ms).alias("min_latency_ms"),
        F.max(ms).alias("max_latency_ms"),
        F.try_divide(F.sum(ms * rows), F.sum(rows)).alias("avg_latency_ms"),
    )
    quantiles = exact_quantiles(counted, [], "latency")
    joined = profile.withColumn("_key", key_of([])).join(quantiles, "_key", "left").drop("_key")
    return joined.withColumns({name: F.col(name) / F.lit(1000.0) for name in PERCENTS})


VALUES = ("price", "qty")


STATS = ("lo", "hi", "total", "present", "nulls", "non_positive")


def _stats(value: Column) -> dict[str, Column]:
    counts = (F.min(value), F.max(value), F.sum(value), F.count(value), F.count_if(value.isNull()), F.count_if(value <= 0))
    return dict(zip(STATS, counts, strict=True))


def _measured(name: str) -> Column:
    stats = _stats(F.col(name).cast("double"))
    return F.struct(F.lit(name).alias("column_name"), *[column.alias(stat) for stat, column in stats.items()])


def _value_levels(base: DataFrame) -> DataFrame:
    return (
        base.select("exchange", F.inline("measured"))
        .groupingSets([["column_name"], ["column_name", "exchange"]], "column_name", "exchange")
        .agg(
            F.min("lo").alias("min_value"),
            F.max("hi").alias("max_value"),
            F.try_divide(F.sum("total"), F.sum("present")).alias("avg_value"),
            F.sum("nulls").alias("null_count"),
            F.sum("non_positive").alias("non_positive_count"),
        )
        .select("column_name", "exchange", "min_value", "max_value", "avg_value", "null_count", "non_positive_count")
    )


def value_profile(ticks: DataFrame, columns: Sequence[str] = VALUES) -> DataFrame:
    """Range, mean, nulls and non-positive values per column, overall and per venue.

    Rows are aggregated once, per venue; the overall figures roll up from those few rows.
    """
    measured = F.array(*[_measured(name) for name in columns]).alias("measured")
    return _value_levels(ticks.groupBy("exchange").agg(measured))


def _null_counts(df: DataFrame, wanted: Sequence[str]) -> list[Column]:
    return [
        (F.count_if(F.col(name).isNull()) if name in df.columns else F.lit(-1).cast("long")).alias(name)
        for name in wanted
    ]


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count per column: one aggregate row, unfolded. Columns that do not exist report -1."""
    wanted = list(columns or df.columns)
    return df.agg(*_null_counts(df, wanted)).unpivot([], wanted, "column_name", "null_count")


def _category_levels(base: DataFrame, column: str) -> DataFrame:
    return (
        base.groupingSets([[column], ["exchange", column]], "exchange", column)
        .agg(_level(["exchange", column]).alias("profile_level"), F.sum("rows").alias("row_count"))
        .select("profile_level", "exchange", F.col(column).alias("category"), "row_count")
    )


def category_profile(ticks: DataFrame, column: str = "side") -> DataFrame:
    """Counts of a categorical column, overall and per venue."""
    return _category_levels(ticks.groupBy("exchange", column).agg(F.count(F.lit(1)).alias("rows")), column)


def _duplicates(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ticks.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


EXACT_KEYS = (*ENTITY, "trade_id")
APPROXIMATE_KEYS = (*ENTITY, "ts_event", "price", "qty", "side")


def duplicate_profile(
    ticks: DataFrame, exact: Sequence[str] = EXACT_KEYS, approximate: Sequence[str] = APPROXIMATE_KEYS
) -> DataFrame:
    """Groups of rows sharing an id, and sharing all observable fields: how many, with how many rows.

    One pass and one shuffle serve both: rows are grouped by either set of keys and combine before they move.
    """
    columns = list(dict.fromkeys((*exact, *approximate)))
    only_exact = [name for name in exact if name not in approximate]
    only_fields = [name for name in approximate if name not in exact]
    if not only_exact or not only_fields:
        raise ValueError("each set of keys needs a column of its own")
    by_fields = F.grouping(only_exact[-1]) == 1
    groups = (
        ticks.groupingSets([list(exact), list(approximate)], *columns)
        .agg(F.count(F.lit(1)).alias("row_count"), by_fields.alias("_by_fields"))
        .filter((F.col("row_count") > 1) & (F.col("_by_fields") | F.col(exact[-1]).isNotNull()))
    )
    found = groups.groupBy("_by_fields").agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("rows"))
    kinds = found.sparkSession.createDataFrame([("exact_id", False), ("same_fields", True)], "duplicate_kind string, _kind boolean")
    both = kinds.join(found, kinds["_kind"] == found["_by_fields"], "left")
    return both.select(
        "duplicate_kind",
        F.coalesce("n", F.lit(0)).alias("duplicate_group_count"),
        F.coalesce("rows", F.lit(0)).alias("duplicate_row_count"),
    )


def duplicate_examples(ticks: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The ``n`` largest groups of duplicates."""
    return _duplicates(ticks, keys).orderBy(F.col("row_count").desc(), *keys).limit(n)


MARK_SECONDS = 60


def sequence_marks(ticks: DataFrame, bucket_seconds: float = MARK_SECONDS) -> DataFrame:
    """(exchange, symbol, bucket, rows, mark): one of the sequence numbers of each bucket, and how many rows it stands for."""
    return _with_marks(ticks, bucket_seconds).filter(F.col("mark").isNotNull())


def _with_marks(ticks: DataFrame, bucket_seconds: float) -> DataFrame:
    numbered = F.col("seq").cast("long")
    return (
        ticks.withColumn("bucket", bucket_index(F.col("ts_event"), bucket_seconds))
        .groupBy("bucket", *ENTITY)
        .agg(F.count(numbered).alias("rows"), F.first(numbered, ignorenulls=True).alias("mark"), F.count(F.lit(1)).alias("trade_count"))
    )


def sequence_edges(marks: DataFrame, chunk_rows: int, cells: int = CELLS) -> DataFrame:
    """(exchange, symbol, edges, cuts): lower edges of ``cells`` equi-depth cells, and into how many chunks each is cut.

    Only venues and symbols of more than ``chunk_rows`` rows have a row, so there are at most rows / ``chunk_rows``. The edges
    are quantiles of the marks, a mark counted in proportion to the rows it stands for.
    """
    unit = max(1, chunk_rows // 16)
    turns = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("rows") / F.lit(unit)).cast("long"))
    weighted = marks.select(*ENTITY, "rows", "mark", F.explode(turns).alias("_turn"))
    quantiles = F.percentile_approx("mark", [i / cells for i in range(1, cells)], ACCURACY)
    per_key = weighted.groupBy(*ENTITY).agg(F.sum(F.when(F.col("_turn") == 1, F.col("rows"))).alias("_rows"), quantiles.alias("_inner"))
    lowest = F.array(F.lit(-(2**63)).cast("long"))
    large = per_key.filter(F.col("_rows") > chunk_rows)
    cuts = F.ceil(F.col("_rows") / F.lit(cells * chunk_rows)).cast("long")
    return large.select(*ENTITY, F.concat(lowest, "_inner").alias("edges"), cuts.alias("cuts"))


def _with_cells(numbered: DataFrame, edges: DataFrame, cells: int = CELLS) -> DataFrame:
    """``_cell`` and ``_part`` of each row's sequence number: a binary search of its key's edges, then equal widths."""
    placed = _with_cell(numbered.join(edges, list(ENTITY), "left"), "_seq", cells)
    low, high = F.get("edges", F.col("_cell")), F.get("edges", F.col("_cell") + 1)
    inner = F.col("cuts") * ((F.col("_seq").cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double")))
    part = F.when((F.col("cuts") > 1) & (F.col("_cell") > 0) & high.isNotNull() & (high > low), F.least(F.floor(inner), F.col("cuts") - 1))
    return placed.withColumn("_part", F.coalesce(part, F.lit(0)).cast("long")).drop("edges", "cuts")


def seq_order_check(
    ticks: DataFrame, *, chunk_rows: int = 1_000_000, edges: DataFrame | None = None, stage: Stage = write_stage
) -> DataFrame:
    """How often event or receive time runs backwards along the sequence number, per venue and symbol.

    One venue may hold most rows, so sequences are checked chunk by chunk and stitched at the edges. Chunks are cut where
    the rows are (``sequence_edges``, a small table kept by ``stage``), so a dense and a sparse venue, or a sequence that
    jumps, are both cut evenly. Rows without a sequence number are in no order and left out.
    """
    if edges is None:
        edges = stage(sequence_edges(sequence_marks(ticks), chunk_rows), "sequence_edges")
    numbered = ticks.filter(F.col("seq").isNotNull()).withColumn("_seq", F.col("seq").cast("long"))
    return summarise_steps(
        _with_cells(numbered, edges),
        keys=ENTITY,
        chunk=F.struct("_cell", "_part"),
        order=["seq", "ts_event", "ts_recv"],
        values=["ts_event", "ts_recv"],
        counts={
            "out_of_order_ts_event_count": lambda before, row: row["ts_event"] < before["ts_event"],
            "out_of_order_ts_recv_count": lambda before, row: row["ts_recv"] < before["ts_recv"],
        },
    )


def _active_buckets(ticks: DataFrame, bucket_seconds: float) -> DataFrame:
    return (
        ticks.withColumn("bucket", bucket_index(F.col("ts_event"), bucket_seconds))
        .groupBy("bucket", *ENTITY)
        .agg(F.count(F.lit(1)).alias("trade_count"))
    )


def _density(active: DataFrame, stage: Stage) -> DataFrame:
    """One row per venue, symbol and trade count is kept; the profile, with its exact quantiles, follows from these."""
    range_of = (F.min("bucket").alias("min_bucket"), F.max("bucket").alias("max_bucket"))
    counted = stage(active.groupBy(*ENTITY, "trade_count").agg(F.count(F.lit(1)).alias("rows"), *range_of), "densities")
    profile = counted.groupBy(*ENTITY).agg(
        F.min("trade_count").alias("min_trade_count"),
        F.max("trade_count").alias("max_trade_count"),
        (F.sum(F.col("trade_count") * F.col("rows")) / F.sum("rows")).alias("avg_trade_count"),
        F.min("min_bucket").alias("min_bucket"),
        F.max("max_bucket").alias("max_bucket"),
        F.sum("rows").alias("active_bucket_count"),
    )
    joined = profile.withColumn("_key", key_of(ENTITY)).join(exact_quantiles(counted, ENTITY, "trade_count"), "_key")
    return joined.select(
        *ENTITY, "min_trade_count", "max_trade_count", "avg_trade_count", "min_bucket", "max_bucket", "active_bucket_count", *PERCENTS
    )


def density_profile(ticks: DataFrame, bucket_seconds: float = 1, stage: Stage = write_stage) -> DataFrame:
    """Ticks per active bucket, per venue and symbol."""
    return _density(_active_buckets(ticks, bucket_seconds), stage)


def _gaps(active: DataFrame, thresholds: Sequence[int], chunk_buckets: int) -> DataFrame:
    def gap(before: Column, row: Column) -> Column:
        return row["bucket"] - before["bucket"]

    def exceeds(limit: int) -> Step:
        return lambda before, row: gap(before, row) > limit

    return summarise_steps(
        active,
        keys=ENTITY,
        chunk=floor_div(F.col("bucket"), chunk_buckets),
        order=["bucket"],
        values=["bucket"],
        counts={f"gaps_gt_{limit}": exceeds(limit) for limit in thresholds},
        maxima={"max_gap": gap},
    )


GAP_LIMITS = (1, 5, 10)


def gap_profile(
    ticks: DataFrame, bucket_seconds: float = 1, thresholds: Sequence[int] = GAP_LIMITS, chunk_buckets: int = 86_400
) -> DataFrame:
    """Longest distance between active buckets and how many exceed each threshold (in buckets)."""
    return _gaps(_active_buckets(ticks, bucket_seconds), thresholds, chunk_buckets)


def profile_ticks(
    ticks: DataFrame, *, bucket_seconds: float = 1, chunk_rows: int = 1_000_000, stage: Stage = write_stage
) -> dict[str, DataFrame]:
    """The data-quality report on ticks, in four passes over them.

    One aggregate per bucket, venue, symbol and side is kept as a stage table, and the few rows it rolls up to per venue,
    symbol and side: counts, categories, values, nulls, density, gaps and the edges of the sequence check come from these. Latencies, duplicates and the sequence check
    take a pass each.
    """
    numbered = F.col("seq").cast("long")
    counted = {f"nulls_{name}": column for name, column in zip(ticks.columns, _null_counts(ticks, ticks.columns), strict=True)}
    for name in VALUES:
        counted |= {f"{stat}_{name}": column for stat, column in _stats(F.col(name).cast("double")).items()}
    cells = stage(
        ticks.withColumn("bucket", bucket_index(F.col("ts_event"), bucket_seconds))
        .groupBy("bucket", *ENTITY, "side")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(numbered).alias("numbered"),
            F.first(numbered, ignorenulls=True).alias("mark"),
            *[column.alias(name) for name, column in counted.items()],
        ),
        "tick_cells",
    )
    merged = [(F.min if name.startswith("lo_") else F.max if name.startswith("hi_") else F.sum)(name).alias(name) for name in counted]
    base = stage(cells.groupBy(*ENTITY, "side").agg(F.sum("rows").alias("rows"), *merged), "tick_base")
    measured = F.array(*[F.struct(F.lit(name).alias("column_name"), *[F.col(f"{stat}_{name}").alias(stat) for stat in STATS]) for name in VALUES])
    active = cells.groupBy("bucket", *ENTITY).agg(F.sum("rows").alias("trade_count"))
    marks = cells.filter(F.col("mark").isNotNull()).select(*ENTITY, F.col("numbered").alias("rows"), "mark")
    edges = stage(sequence_edges(marks, chunk_rows), "sequence_edges")
    null_sums = base.agg(*[F.sum(f"nulls_{name}").alias(name) for name in ticks.columns])
    return {
        "counts": _count_levels(base),
        "latency": latency_profile(ticks, stage),
        "values": _value_levels(base.withColumn("measured", measured)),
        "nulls": null_sums.unpivot([], ticks.columns, "column_name", "null_count"),
        "categories": _category_levels(base, "side"),
        "duplicates": duplicate_profile(ticks),
        "sequence": seq_order_check(ticks, edges=edges),
        "density": _density(active, stage),
        "gaps": _gaps(active, GAP_LIMITS, 86_400),
    }


def candidate_profile(candidates: DataFrame) -> DataFrame:
    """Candidate counts, durations and moves by direction, venue, symbol, venue and direction, and overall."""
    names = ("exchange", "symbol", "direction")
    base = candidates.groupBy(*names).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("duration_seconds").alias("short"),
        F.max("duration_seconds").alias("long"),
        F.sum("duration_seconds").alias("lasted"),
        F.min("move_pct").alias("lo"),
        F.max("move_pct").alias("hi"),
        F.sum("move_pct").alias("moved"),
        F.count("move_pct").alias("moves"),
    )
    return (
        base.groupingSets([["direction"], ["exchange"], ["symbol"], ["exchange", "direction"], []], *names)
        .agg(
            _level(names).alias("profile_level"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("candidate_count"),
            F.min("short").alias("min_duration_seconds"),
            F.max("long").alias("max_duration_seconds"),
            F.try_divide(F.sum("lasted"), F.sum("rows")).alias("avg_duration_seconds"),
            F.min("lo").alias("min_move_pct"),
            F.max("hi").alias("max_move_pct"),
            F.try_divide(F.sum("moved"), F.sum("moves")).alias("avg_move_pct"),
        )
        .select(
            "profile_level",
            *names,
            "candidate_count",
            "min_duration_seconds",
            "max_duration_seconds",
            "avg_duration_seconds",
            "min_move_pct",
            "max_move_pct",
            "avg_move_pct",
        )
    )


def candidate_rollup(candidates: DataFrame, *, bucket_seconds: float = 1) -> DataFrame:
    """Candidates and ambiguous candidates per date, venue and direction, and in total."""
    names = ("selected_date", "exchange", "direction")
    level = F.when(F.grouping("direction") == 0, F.lit("date_exchange_direction")).otherwise(F.lit("total"))
    base = (
        candidates.withColumn("selected_date", bucket_date(F.col("start_bucket"), bucket_seconds))
        .groupBy(*names)
        .agg(F.count_if(~F.col("is_ambiguous")).alias("clear"), F.count_if("is_ambiguous").alias("ambiguous"))
    )
    return (
        base.groupingSets([list(names), []], *names)
        .agg(
            level.alias("summary_level"),
            F.coalesce(F.sum("clear"), F.lit(0)).alias("raw_candidate_count"),
            F.coalesce(F.sum("ambiguous"), F.lit(0)).alias("ambiguous_candidate_count"),
        )
        .select("summary_level", *names, "raw_candidate_count", "ambiguous_candidate_count")
    )
