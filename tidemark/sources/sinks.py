"""Verified Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_verified(df: DataFrame, path: str, *, mode: str = "strict", allow_empty: bool = False) -> DataFrame:
    """Write to a new folder and return the table read back.

    The row count is observed while writing, so the plan runs once. ``strict`` compares it with a
    count of the written files (footers only); ``light`` trusts the write.
    """
    if mode not in ("strict", "light"):
        raise ValueError(f"unknown validation mode {mode!r}")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    written = seen.get["rows"]
    if written == 0 and not allow_empty:
        raise RuntimeError(f"{path}: nothing was written")
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if mode == "strict":
        stored = table.count()
        if stored != written:
            raise RuntimeError(f"{path}: wrote {written} rows but found {stored}")
    return table
