"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cellscore.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the file system removes it when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, jpath = _file_system(spark, path)
    files.deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: later steps neither recompute it nor lose it
    with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing reads any more."""
    for df in tables:
        files, jpath = _file_system(df.sparkSession, df._scratch)
        files.delete(jpath, True)
