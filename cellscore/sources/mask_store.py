"""Masks kept as run-length rows on disk, so that a question about some rows reads these rows' bands alone.

A mask lies in one folder for each band of ``band`` pixel rows, its runs in order of row and column. A filter on rows
becomes one on bands, which prunes folders before anything is opened; within a band the row groups' statistics do the rest. The
shape and band of each mask stand in a small table beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.operators import runs as rn
from cellscore.sources.masks import ROW_BAND

COLUMNS = ["mask_id", "r", "c0", "c1"]


def write_masks(rle: DataFrame, masks: DataFrame, path: str, band: int = ROW_BAND) -> None:
    """Store ``rle`` (mask_id, r, c0, c1) of ``masks`` (mask_id, h, w). Masks stored before under other ids stay; a mask that is
    stored again replaces its bands, also those that have no land any more."""
    writer = lambda d: d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    every = masks.select("mask_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / band).cast("int"))).alias("band"))
    d = rle.select(*COLUMNS, F.floor(F.col("r") / band).cast("int").alias("band"))
    d = every.join(d, ["mask_id", "band"], "left")  # a band without land is an empty marker, so that it replaces what was there
    dealt = d.repartition("mask_id", "band").sortWithinPartitions("mask_id", "band", "r", "c0")
    writer(dealt).partitionBy("mask_id", "band").parquet(f"{path}/runs")
    writer(masks.select("mask_id", "h", "w", F.lit(band).alias("band_rows"))).partitionBy("mask_id").parquet(f"{path}/masks")


def stored_masks(spark: SparkSession, path: str) -> DataFrame:
    """mask_id, h, w, band_rows."""
    return spark.read.schema("h int, w int, band_rows int, mask_id string").parquet(f"{path}/masks").select("mask_id", "h", "w", "band_rows")


def read_runs(spark: SparkSession, path: str, mask_id: str | None = None, rows: tuple[int, int] | None = None, band: int = ROW_BAND) -> DataFrame:
    """The stored runs of a mask (or of all), of the given rows (first and last) only."""
    d = spark.read.schema("r int, c0 int, c1 int, mask_id string, band int").parquet(f"{path}/runs")
    if mask_id is not None:
        d = d.where(F.col("mask_id") == mask_id)
    if rows is not None:
        d = d.where(F.col("band").between(rows[0] // band, rows[1] // band) & F.col("r").between(*rows))
    return d.where("r is not null").select(*COLUMNS)


def land_rows(spark: SparkSession, path: str, mask_id: str, rows: tuple[int, int], band: int = ROW_BAND) -> DataFrame:
    """Land pixels (mask_id, r, c) of some rows."""
    return rn.pixels(read_runs(spark, path, mask_id, rows, band)).select("mask_id", "r", "c")
