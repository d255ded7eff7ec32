"""Parquet scans: by path, with the partition date attached, and of persisted run tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.catalog import partition_fields


def require_columns(df: DataFrame, required: Iterable[str], label: str) -> None:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks required columns: {', '.join(missing)}")


def scan_paths(spark: SparkSession, paths: Sequence[str], root: str = "") -> DataFrame:
    """One scan over many files or folders; ``root`` is put before relative catalog keys."""
    if not paths:
        raise ValueError("no paths to scan")
    prefix = f"{root.rstrip('/')}/" if root else ""
    return spark.read.parquet(*[f"{prefix}{path.lstrip('/')}" if prefix else path for path in paths])


def scan_dated(spark: SparkSession, paths: Sequence[str], root: str = "") -> DataFrame:
    """Like ``scan_paths`` for files whose schemas drift: columns merge by name, absent ones are null,
    and ``source_partition_date`` comes from each file's own path."""
    if not paths:
        raise ValueError("no paths to scan")
    prefix = f"{root.rstrip('/')}/" if root else ""
    reader = spark.read.option("mergeSchema", "true")
    scanned = reader.parquet(*[f"{prefix}{path.lstrip('/')}" if prefix else path for path in paths])
    return scanned.withColumn("source_partition_date", partition_fields(F.col("_metadata.file_path"))["date"])


def union_drifted(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, absent columns null: for frames whose column types mergeSchema cannot reconcile."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def scan_run_table(
    spark: SparkSession,
    path: str,
    *,
    required: Iterable[str] = (),
    equals: dict[str, object] | None = None,
) -> DataFrame:
    """A persisted run table, optionally for one id; missing columns or no rows at all fail here."""
    table = spark.read.parquet(path)
    require_columns(table, required, path)
    for name, value in (equals or {}).items():
        table = table.filter(F.col(name) == F.lit(value))
    if table.isEmpty():
        raise ValueError(f"no rows in {path} for {equals or 'any id'}")
    return table
