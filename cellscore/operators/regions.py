"""Accuracy by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscore.functions.common import safe_div
from cellscore.functions.geo import CONTINENTS, OCEANS, REGION_ORDER, with_region

N_HEAT = 12


def region_accuracy(flags: DataFrame) -> DataFrame:
    """Area-weighted accuracy per (run, region); positive weight only, fixed region order."""
    d = with_region(flags.where("known"))
    agg = d.groupBy("run_id", "region").agg(
        F.sum("w").alias("weight"),
        F.sum(F.when(F.col("correct"), F.col("w")).otherwise(0.0)).alias("_ok"),
        F.count("*").alias("n"),
    )
    pos = F.array_position(F.array(*[F.lit(x) for x in REGION_ORDER]), F.col("region")).cast("int")
    return agg.where(F.col("weight") > 0).select(
        "run_id", "region", pos.alias("position"), safe_div(F.col("_ok"), F.col("weight")).alias("acc"), "weight", "n"
    )


#: Column groups of the region table: land 0, ocean 1, polar 2, Antarctica 3.
GROUPS = {name: 0 for name in CONTINENTS} | {name: 1 for name in OCEANS} | {"Southern Ocean": 1, "Arctic": 2, "Antarctica": 3, "Inland waters": 0, "Mediterranean & Black Sea": 1}


def report_group(region: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair]), region)


def table_order() -> list[str]:
    """The columns of the region table: by group, then in the order of the regions."""
    return sorted(REGION_ORDER, key=lambda name: (GROUPS[name], REGION_ORDER.index(name)))


def region_heat(regions: DataFrame) -> DataFrame:
    """Regions with column group and heat bucket 0..12 over the range of all values."""
    ends = regions.agg(F.min("acc").alias("lo"), F.max("acc").alias("hi"))  # one row
    d = regions.crossJoin(F.broadcast(ends))
    t = F.when(F.col("hi") <= F.col("lo"), F.lit(0.0)).otherwise(
        (F.col("acc") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    )
    return d.withColumn("heat", F.rint(t * N_HEAT).cast("int")).withColumn("col_group", report_group(F.col("region")))


def region_table(regions: DataFrame) -> DataFrame:
    """Runs x regions; the column list is the fixed region list, so no extra pass is needed."""
    return regions.groupBy("run_id").pivot("region", table_order()).agg(F.first("acc"))
