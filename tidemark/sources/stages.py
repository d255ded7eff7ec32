"""Stage tables: intermediate results written once to shared storage and read back.

A written table cuts lineage, survives the loss of executors and gives the planner exact sizes. The folder is the one
the cluster names in ``spark.checkpoint.dir``; the session's settings are never changed. Only in local mode (tests, one
machine) may it be unset: then the stages of an application lie in a temporary folder that goes when the process ends.
"""

from __future__ import annotations

import atexit
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# How a plan keeps an intermediate table: it gets the table and a name, and returns the kept table. One that can lay the
# table out by columns also takes ``partition_by``.
Stage = Callable[..., DataFrame]


@lru_cache
def _local_root(application: str) -> str:
    root = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def stage_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_root(spark.sparkContext.applicationId)


def write_stage(df: DataFrame, name: str, root: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` under a fresh folder and return it read back with the same schema.

    Partitions are balanced before they are written: a small one is one file, a large one several.
    """
    spark = df.sparkSession
    path = f"{root or stage_root(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def stage_by(stage: Stage, df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Keep ``df`` laid out by ``columns`` if the stage can, else as it is."""
    if "partition_by" in inspect.signature(stage).parameters:
        return stage(df, name, partition_by=columns)
    return stage(df, name)


class StageFolder:
    """The stage tables of one run, in one folder of ``root`` (or ``stage_root``), removed together.

    Use as a ``Stage``; leave the ``with`` block, or call ``remove``, once results have been written elsewhere.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.path = f"{(root or stage_root(spark)).rstrip('/')}/tidemark-run-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        return write_stage(df, name, self.path, partition_by)

    def __enter__(self) -> StageFolder:
        return self

    def __exit__(self, *error: object) -> None:
        self.remove()

    def remove(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
