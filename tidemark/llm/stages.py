"""Removing stage tables that nothing reads any more."""

from __future__ import annotations

from pyspark.sql import DataFrame


def drop_stages(*tables: DataFrame) -> None:
    """Delete the files of tables from ``write_stage``, once what was made of them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 2)[0] for file in table.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("tidemark-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
