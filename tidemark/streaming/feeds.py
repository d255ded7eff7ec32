"""File feeds: a folder that files are added to as the source of a stream, a verified table as its sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

FILES_MOST = 100  # of a delivery; fewer than a batch reads by default


def read_feed(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1_000) -> DataFrame:
    """A stream of the Parquet files of a folder, oldest first; the schema is given, since the folder may be empty."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Take everything the source has now to a table at ``path``, and return that table.

    Progress and state lie under ``checkpoint``: a later call goes on from there with what has come since, and a call
    after a failure repeats nothing, because the sink lists the files of each finished batch.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def publish(rows: DataFrame, path: str, position: Column, edges: Iterable[int], files: int = FILES_MOST) -> None:
    """Add ``rows`` to a feed in slices [edge, next edge) of ``position``, one delivery each, earliest first.

    A delivery is written by up to ``files`` tasks at once, and its files are in no order. Drain each before the next
    one comes, so that a delivery is read whole, in one batch, and none of its rows counts as late.
    """
    edges = list(edges)
    for low, high in zip(edges, edges[1:]):
        rows.filter((position >= low) & (position < high)).coalesce(files).write.mode("append").parquet(path)
