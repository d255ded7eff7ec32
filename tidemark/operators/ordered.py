"""Ordered windows that never put a whole key into one task.

A key (a venue, say) may hold a third of all rows, so the ordering axis is cut into chunks. Each
chunk is sorted on its own; what crosses a chunk edge comes from a summary with one row per
(key, chunk), ordered per key and joined back.

The key columns travel as one struct. It is never null, whatever is in it, so the join back is a
plain equality on the very expressions the windows are partitioned by: it moves no rows again, and
both of its sides can read one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

CHUNK, KEY, CARRY = "_chunk", "_key", "_carry"
BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Chunk and key beside the rows. Text chunks (dates) and numbers both order as they should."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return df.withColumns({CHUNK: F.struct(chunk.alias("at")), KEY: key})


def _along(order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(CHUNK, KEY).orderBy(*order)


def _chunks(descending: bool = False) -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(F.col(CHUNK).desc() if descending else F.col(CHUNK).asc())


def _with_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows with what the chunks before (or after) theirs hand over; ``carry`` has one row per chunk and key."""
    named = carry.select(F.col(CHUNK).alias("_to_chunk"), F.col(KEY).alias("_to_key"), CARRY)
    same = (F.col(CHUNK) == F.col("_to_chunk")) & (F.col(KEY) == F.col("_to_key"))
    return df.join(named, same, "left").drop("_to_chunk", "_to_key")


def with_previous(
    df: DataFrame, *, keys: Sequence[str], chunk: Column, order: Sequence[str], values: Mapping[str, str]
) -> DataFrame:
    """Add ``out`` = the value of ``column`` on the previous row of the key, for each ``column: out``.

    The last row of a chunk comes out of the same sort as the previous rows within it.
    """
    along = _along([F.col(name) for name in order])
    row = F.struct(*[F.col(name) for name in values])
    inside = _chunked(df, keys, chunk).withColumns(
        {"_prev": F.lag(row).over(along), "_is_last": F.lead(F.lit(True)).over(along).isNull()}
    )
    lasts = inside.filter("_is_last").select(CHUNK, KEY, row.alias("_last"))
    joined = _with_carry(inside, lasts.select(CHUNK, KEY, F.lag("_last").over(_chunks()).alias(CARRY)))
    previous = F.coalesce("_prev", CARRY)
    return joined.select(*df.columns, *[previous[name].alias(out) for name, out in values.items()])


Step = Callable[[Column, Column], Column]


def summarise_steps(
    df: DataFrame,
    *,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    values: Sequence[str],
    counts: Mapping[str, Step] | None = None,
    maxima: Mapping[str, Step] | None = None,
) -> DataFrame:
    """Per key, count or maximise a function of each row and the one before it (structs of ``values``).

    Chunks are summarised with their first and last row, and the steps between chunks are taken on
    the summaries: rows are read and shuffled once, and nothing is joined back.
    """
    counts, maxima = counts or {}, maxima or {}
    along = _along([F.col(name) for name in order])
    row = F.struct(*[F.col(name) for name in values])
    inside = (
        _chunked(df, keys, chunk)
        .withColumn("_row", row)
        .withColumns({"_prev": F.lag("_row").over(along), "_is_last": F.lead(F.lit(True)).over(along).isNull()})
    )
    step = (F.col("_prev"), F.col("_row"))
    per_chunk = inside.groupBy(CHUNK, KEY).agg(
        F.max(F.when(F.col("_prev").isNull(), F.col("_row"))).alias("_first"),
        F.max(F.when(F.col("_is_last"), F.col("_row"))).alias("_last"),
        *[F.count_if(fn(*step)).alias(name) for name, fn in counts.items()],
        *[F.max(fn(*step)).alias(name) for name, fn in maxima.items()],
    )
    edge = (F.col("_from"), F.col("_first"))
    return (
        per_chunk.withColumn("_from", F.lag("_last").over(_chunks()))
        .groupBy(KEY)
        .agg(
            *[(F.sum(name) + F.count_if(fn(*edge))).alias(name) for name, fn in counts.items()],
            *[F.greatest(F.max(name), F.max(fn(*edge))).alias(name) for name, fn in maxima.items()],
        )
        .select(f"{KEY}.*", *counts, *maxima)
    )


def with_run_number(
    df: DataFrame, *, keys: Sequence[str], chunk: Column, position: str, ties: Sequence[str], gap: int, out: str
) -> DataFrame:
    """Number, per key from 1, the runs of rows whose positions are at most ``gap`` apart."""
    along = _along([F.col(name) for name in (position, *ties)])
    step = F.col(position) - F.lag(position).over(along)
    inside = _chunked(df, keys, chunk).withColumn("_opens", F.when(step <= gap, 0).otherwise(1))
    inside = inside.withColumn("_inside", F.sum("_opens").over(along.rowsBetween(*UP_TO)))
    summary = inside.groupBy(CHUNK, KEY).agg(
        F.min(position).alias("_first"), F.max(position).alias("_last"), F.sum("_opens").alias("_opened")
    )
    # A chunk that starts within ``gap`` of the end of the one before goes on with its run.
    goes_on = F.when(F.col("_first") - F.lag("_last").over(_chunks()) <= gap, 1).otherwise(0)
    earlier = F.sum(F.col("_opened") - F.col("_goes_on")).over(_chunks().rowsBetween(*BEFORE))
    carry = summary.withColumn("_goes_on", goes_on).select(
        CHUNK, KEY, (F.coalesce(earlier, F.lit(0)) - F.col("_goes_on")).alias(CARRY)
    )
    return _with_carry(inside, carry).select(*df.columns, (F.col("_inside") + F.col(CARRY)).alias(out))


def with_row_number(
    df: DataFrame, *, keys: Sequence[str] = (), chunk: Column, order: Sequence[Column], out: str
) -> DataFrame:
    """Number rows 1.. per key; ``chunk`` must be non-decreasing along ``order``."""
    inside = _chunked(df, keys, chunk).withColumn("_inside", F.row_number().over(_along(order)))
    totals = inside.groupBy(CHUNK, KEY).agg(F.count(F.lit(1)).alias("_total"))
    carry = totals.select(CHUNK, KEY, F.sum("_total").over(_chunks().rowsBetween(*BEFORE)).alias(CARRY))
    number = F.col("_inside") + F.coalesce(F.col(CARRY), F.lit(0))
    return _with_carry(inside, carry).select(*df.columns, number.cast("long").alias(out))


def with_nearest_known(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    chunk: Column,
    position: str,
    value: str,
    before: str,
    after: str,
) -> DataFrame:
    """Two-sided as-of: the last non-null ``value`` at or before, and the first at or after, each row.

    Rows carrying a value sort ahead of rows without one at the same position, in both directions.
    """
    chunked = _chunked(df, keys, chunk).withColumn("_empty", F.col(value).isNull().cast("int"))
    forward = _along([F.col(position).asc(), F.col("_empty").asc()]).rowsBetween(*UP_TO)
    backward = _along([F.col(position).desc(), F.col("_empty").asc()]).rowsBetween(*UP_TO)
    inside = chunked.withColumns(
        {
            "_before": F.last(value, ignorenulls=True).over(forward),
            "_after": F.last(value, ignorenulls=True).over(backward),
        }
    )
    holding = F.when(F.col(value).isNotNull(), F.col(position))
    edges = chunked.groupBy(CHUNK, KEY).agg(
        F.max_by(value, holding).alias("_latest"), F.min_by(value, holding).alias("_earliest")
    )
    carry = edges.select(
        CHUNK,
        KEY,
        F.struct(
            F.last("_latest", ignorenulls=True).over(_chunks().rowsBetween(*BEFORE)).alias("before"),
            F.last("_earliest", ignorenulls=True).over(_chunks(descending=True).rowsBetween(*BEFORE)).alias("after"),
        ).alias(CARRY),
    )
    return _with_carry(inside, carry).select(
        *df.columns,
        F.coalesce(F.col("_before"), F.col(CARRY)["before"]).alias(before),
        F.coalesce(F.col("_after"), F.col(CARRY)["after"]).alias(after),
    )
