"""Truth of the cells of a grid from masks in run-length form; every result has one row per (mask, cell).

``masks`` (mask_id) lists the masks; without it those that have land count. Cells meet runs by mask, pixel row and band
of columns, so neither a long row nor a second mask widens the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscore.functions import geo


BAND = 64


def per_mask(places: DataFrame, rle: DataFrame, masks: DataFrame | None) -> DataFrame:
    """Each place once for each mask: as many rows as the result has."""
    if "mask_id" in places.columns:
        return places
    ids = (rle if masks is None else masks).agg(F.collect_set("mask_id").alias("_ids"))  # one row
    return places.join(F.broadcast(ids), F.lit(True)).withColumn("mask_id", F.explode("_ids")).drop("_ids")


def banded(runs: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each band of columns that [first, last] touches."""
    low, high = (F.floor(F.col(c) / BAND).cast("int") for c in (first, last))
    return runs.withColumn("_band", F.explode(F.sequence(low, high)))


def pixel_value(places: DataFrame, rle: DataFrame, shape: tuple[int, int], lat: str, lon: str, out: str, masks: DataFrame | None = None) -> DataFrame:
    """Mask value (1 land, 0 water) of the pixel under (lat, lon), for each mask; no pixel is expanded."""
    h, w = shape
    p = per_mask(places, rle, masks)
    kept = p.columns
    p = p.withColumn("_r", geo.pixel_row(F.col(lat), h)).withColumn("_c", geo.pixel_col(F.col(lon), w)).withColumn("_band", F.floor(F.col("_c") / BAND).cast("int"))
    runs = banded(rle.select("mask_id", F.col("r").alias("_r"), F.col("c0").alias("_c0"), F.col("c1").alias("_c1")), "_c0", "_c1")
    runs = runs.select(F.struct("mask_id", "_r", "_band").alias("_at"), "_c0", "_c1")
    inside = (F.struct("mask_id", "_r", "_band") == F.col("_at")) & F.col("_c").between(F.col("_c0"), F.col("_c1"))
    return p.join(runs, inside, "left").select(*kept, F.col("_c0").isNotNull().cast("int").alias(out))


def truth_cell_center(cells: DataFrame, rle: DataFrame, shape: tuple[int, int], masks: DataFrame | None = None) -> DataFrame:
    return pixel_value(cells, rle, shape, "lat", "lon", "truth", masks)


def truth_majority(
    cells: DataFrame, rle: DataFrame, shape: tuple[int, int], step: float, placement: str = geo.CELL_CENTER, masks: DataFrame | None = None
) -> DataFrame:
    """1 where more than half of the pixels centered in the cell are land; a tie is water.

    Edges are inclusive, so a pixel centered on an edge counts in both cells. The columns of a cell
    become one or two spans (seam), and land is the overlap of spans and runs.
    """
    h, w = shape
    dy, dx = 180.0 / h, 360.0 / w
    eps = 1e-9
    b = geo.cell_bounds(F.col("lat"), F.col("lon"), step, placement)
    d = cells.withColumns({f"_{k}": v for k, v in b.items()})
    d = d.withColumns(
        {
            "_r0": F.greatest(F.lit(0), F.ceil((90.0 - F.col("_north")) / dy - 0.5 - eps).cast("int")),
            "_r1": F.least(F.lit(h - 1), F.floor((90.0 - F.col("_south")) / dy - 0.5 + eps).cast("int")),
            "_c0": F.ceil((F.col("_west") + 180.0) / dx - 0.5 - eps).cast("int"),
            "_c1": F.floor((F.col("_east") + 180.0) / dx - 0.5 + eps).cast("int"),
        }
    )
    some = (F.col("_r0") <= F.col("_r1")) & (F.col("_c0") <= F.col("_c1"))
    width = F.least(F.col("_c1") - F.col("_c0") + 1, F.lit(w))
    start = F.pmod(F.col("_c0"), F.lit(w))
    end = start + width - 1
    spans = F.array_compact(
        F.array(
            F.struct(start.alias("a"), F.least(end, F.lit(w - 1)).alias("b")),
            F.when(end >= w, F.struct(F.lit(0).alias("a"), (end - w).alias("b"))),
        )
    )
    full = d.where(some).select("idx", "_r0", "_r1", width.alias("_width"), F.explode(spans).alias("_s"))
    size = (F.col("_r1") - F.col("_r0") + 1) * F.col("_width")
    rows = full.select("idx", size.alias("_n"), F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"), F.explode(F.sequence("_r0", "_r1")).alias("r"))
    low = F.greatest("c0", "_a", F.col("_band") * BAND)
    over = F.least("c1", "_b", F.col("_band") * BAND + (BAND - 1)) - low + 1
    land = (
        banded(rows, "_a", "_b")
        .join(banded(rle.select("mask_id", "r", "c0", "c1"), "c0", "c1"), ["r", "_band"])
        .where(over > 0)
        .groupBy("mask_id", "idx", "_n")
        .agg(F.sum(over).alias("_land"))
        .select("mask_id", "idx", (2 * F.col("_land") > F.col("_n")).cast("int").alias("_maj"))
    )
    mid = d.withColumn("_mlat", (F.col("_south") + F.col("_north")) / 2).withColumn("_mlon", (F.col("_west") + F.col("_east")) / 2)
    tiny = pixel_value(mid.where(~some).select("idx", "_mlat", "_mlon"), rle, shape, "_mlat", "_mlon", "_tiny", masks)
    key = ["mask_id", "idx"]
    out = per_mask(cells, rle, masks).join(land, key, "left").join(tiny.select(*key, "_tiny"), key, "left")
    return out.withColumn("truth", F.coalesce("_maj", "_tiny", F.lit(0))).drop("_maj", "_tiny")


def truth_refill(points: DataFrame, cell_truth: DataFrame, mask_changed: bool = False) -> DataFrame:
    """Fill missing truth from the mask, or replace all of it when the mask is another one.

    ``cell_truth`` has (mask_id, idx, truth). Points say by ``mask_id`` which mask is theirs; without that column there must be one mask only.
    """
    own = ["mask_id", "idx"] if "mask_id" in points.columns else ["idx"]
    t = cell_truth.select(*own, F.col("truth").alias("_t"))
    d = points.join(t, own, "left")
    new = F.col("_t") if mask_changed else F.coalesce("truth", "_t")
    return d.withColumn("truth", new).drop("_t")


def mask_fidelity(runs: DataFrame, specs: DataFrame, loaded_hash: DataFrame) -> DataFrame:
    """Runs planned with another mask than the one in use: warned in reports, refused on resume."""
    planned = runs.join(specs.select("spec_id", F.col("mask_hash").alias("planned_hash"), "mask_id"), "spec_id")
    d = planned.join(loaded_hash.select("mask_id", "mask_hash"), "mask_id")
    return d.where(F.col("planned_hash") != F.col("mask_hash"))
