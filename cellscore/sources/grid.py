"""The grid of evaluation cells as a generated source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions.common import bucketed_rank


def cell_columns(idx: Column, step: float, placement: str = geo.CELL_CENTER) -> dict[str, Column]:
    """r, c, lat, lon and weight of a row-major cell number."""
    _, n_cols = geo.grid_dims(step)
    r = F.floor(idx / n_cols).cast("int")
    c = (idx % n_cols).cast("int")
    lat = geo.row_lat(r, step, placement)
    return {
        "r": r,
        "c": c,
        "lat": lat,
        "lon": geo.col_lon(c, step, placement),
        "weight": geo.cos_weight(lat),
    }


def with_cell(df: DataFrame, step: float, placement: str = geo.CELL_CENTER) -> DataFrame:
    """Add the place of the cell ``idx`` to a table; nothing is joined."""
    return df.withColumns(cell_columns(F.col("idx"), step, placement))


def full_grid(spark: SparkSession, step: float, placement: str = geo.CELL_CENTER) -> DataFrame:
    n_r, n_c = geo.grid_dims(step)
    cells = spark.range(n_r * n_c).select(F.col("id").cast("int").alias("idx"))
    return with_cell(cells, step, placement)


def cells_of(runs: DataFrame, step: float) -> DataFrame:
    """Every cell of the grid for every row of ``runs`` (made by explode, not by a join)."""
    n_r, n_c = geo.grid_dims(step)
    return runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_r * n_c - 1))).alias("idx"))


def seeded_hash(seed: Column, idx: Column) -> Column:
    """Hex digest that orders cells at random, the same on every engine."""
    return F.md5(F.concat_ws(":", seed.cast("string"), idx.cast("string")))


def grid_subset(cells: DataFrame, frac: float, seed: int, n_cells: int) -> DataFrame:
    """Exactly max(1, round(frac * n)) cells, chosen by seeded hash; cell numbers are kept."""
    if not 0 < frac <= 1:
        raise ValueError(f"the share must lie in (0, 1], not {frac}")
    keep = max(1, round(frac * n_cells))
    d = cells.withColumn("_h", seeded_hash(F.lit(seed), F.col("idx")))
    ranked = bucketed_rank(d, [], F.substring("_h", 1, 2), [F.col("_h"), F.col("idx")], "_rank")
    return ranked.where(F.col("_rank") <= keep).drop("_h", "_rank")


def stratified_order(cells: DataFrame, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Coarse-to-fine visiting order: adds ``level`` and the 1-based ``visit``.

    Rows and columns are the ranks of the latitudes and longitudes that occur; both are shifted
    cyclically by a seeded offset. The ranks come from the two short lists of distinct values.
    """
    keys = list(keys or [])
    lats = cells.select(*keys, "lat").distinct()
    lons = cells.select(*keys, "lon").distinct()
    lat_w = Window.partitionBy(*keys)
    lats = lats.select(
        *keys,
        "lat",
        (F.row_number().over(lat_w.orderBy(F.col("lat").desc())) - 1).alias("_row"),
        F.count("*").over(lat_w).alias("_nr"),
    )
    lons = lons.select(
        *keys,
        "lon",
        (F.row_number().over(lat_w.orderBy("lon")) - 1).alias("_col"),
        F.count("*").over(lat_w).alias("_nc"),
    )

    def offset(tag: str, n: Column) -> Column:
        digits = F.substring(F.md5(F.lit(f"{seed}:{tag}")), 1, 8)
        return F.conv(digits, 16, 10).cast("bigint") % n

    d = cells.join(lats, [*keys, "lat"]).join(lons, [*keys, "lon"])
    k = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest("_nr", "_nc").cast("double"))).cast("int"))

    def low_bit(x: Column) -> Column:
        bit = x.bitwiseAND(-x)
        return F.when(x == 0, F.col("_k")).otherwise(F.rint(F.log2(bit.cast("double"))).cast("int"))

    d = d.withColumn("_k", k).withColumn("_row", (F.col("_row") + offset("row", F.col("_nr"))) % F.col("_nr"))
    d = d.withColumn("_col", (F.col("_col") + offset("col", F.col("_nc"))) % F.col("_nc"))
    zeros = F.least(low_bit(F.col("_row")), low_bit(F.col("_col")), F.col("_k"))
    d = d.withColumn("level", (F.col("_k") - zeros).cast("int"))
    d = d.withColumn("_h", seeded_hash(F.lit(seed), F.col("idx")))
    bucket = F.struct("level", F.substring("_h", 1, 2))
    out = bucketed_rank(d, keys, bucket, [F.col("_h"), F.col("idx")], "visit")
    return out.drop("_row", "_col", "_nr", "_nc", "_k", "_h")
