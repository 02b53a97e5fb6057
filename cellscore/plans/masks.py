"""Masks, uploads, polygons and the truth of cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions.common import rounded
from cellscore.operators import truth as tr
from cellscore.session import checkpoint_dir
from cellscore.sources import mask_store as ms
from cellscore.sources import masks as mk
from cellscore.sources import testbed as tb
from cellscore.sources.grid import full_grid

SHAPE = (tb.MASK_H, tb.MASK_W)
POLY_SHAPE = (90, 180)
N_GRAY = tb.GRAY_SIZE
STORED_BAND = 32


def mask_rle(spark: SparkSession, sf: str) -> DataFrame:
    return mk.to_rle(tb.mask_pixels(spark, sf))


def mask_source_rle(spark, sf):
    """Pixel rows 20 to 119 of the stored mask; of its six bands four are read."""
    path = f"{checkpoint_dir(spark)}/masks-{uuid.uuid4().hex}"
    ms.write_masks(mask_rle(spark, sf), tb.masks(spark).withColumns({"h": F.lit(SHAPE[0]), "w": F.lit(SHAPE[1])}), path, STORED_BAND)
    return ms.land_rows(spark, path, "mask", (20, 119), STORED_BAND)


def mask_rle_rows(spark, sf):
    return mask_rle(spark, sf)


def mask_pixel_of(spark, sf):
    p = tb.points(spark, sf)
    return p.select(
        "run_id", "idx",
        geo.pixel_row(F.col("lat"), tb.MASK_H).alias("row"), geo.pixel_col(F.col("lon"), tb.MASK_W).alias("col"),
    )


def land_fraction(spark, sf):
    return rounded(mk.land_fraction(mask_rle(spark, sf), SHAPE, tb.masks(spark)))


def mask_fingerprint(spark, sf):
    return mk.mask_fingerprint(mask_rle(spark, sf), SHAPE, tb.masks(spark))


def mask_downsample_edges(spark, sf):
    """To 50 x 70: edges that do not divide the mask."""
    return mk.from_rle(mk.resample_mask(mask_rle(spark, sf), SHAPE, (50, 70)))


def mask_resample_mixed(spark, sf):
    """Rows grow to 250 by nearest sampling, columns shrink to 90 by majority."""
    return mk.from_rle(mk.resample_mask(mask_rle(spark, sf), SHAPE, (250, 90)))


def mask_downsample_work(spark, sf):
    return mk.from_rle(mk.downsample_for_work(mask_rle(spark, sf), SHAPE, (90, 90)))


def mask_downsample_nearest(spark, sf):
    return mk.from_rle(mk.downsample_for_work(mask_rle(spark, sf), SHAPE, (100, 200)))


def gray(spark: SparkSession, sf: str) -> DataFrame:
    g = mk.luminance(F.col("red"), F.col("green"), F.col("blue"), F.col("alpha"))
    return tb.rgba_pixels(spark, sf).select("image_id", "r", "c", g.alias("gray"))


def gray_luminance(spark, sf):
    return gray(spark, sf)


def mercator_reproject(spark, sf):
    return mk.mercator_to_equirect(gray(spark, sf), N_GRAY)


def otsu_threshold(spark, sf):
    return mk.otsu_threshold(gray(spark, sf))


def binarise(spark, sf):
    g = gray(spark, sf)
    return mk.binarise(g, mk.otsu_threshold(g))


def polygon_edges(spark, sf):
    return rounded(mk.polygon_edges(tb.rings(spark, sf)))


def rasterize_polygons(spark, sf):
    return mk.rasterize_polygons(mk.polygon_edges(tb.rings(spark, sf)), POLY_SHAPE)


def cells(spark: SparkSession) -> DataFrame:
    return full_grid(spark, tb.STEP)


def truth_cell_center(spark, sf):
    return tr.truth_cell_center(cells(spark), mask_rle(spark, sf), SHAPE).select("idx", "truth")


def truth_majority(spark, sf):
    return tr.truth_majority(cells(spark), mask_rle(spark, sf), SHAPE, tb.STEP).select("idx", "truth")


def truth_majority_corner(spark, sf):
    """Corner placement on the coarse mask: cells of 5 degrees with pixel centers on their edges."""
    small = mk.resample_mask(mask_rle(spark, sf), SHAPE, (90, 180))
    grid = full_grid(spark, 5.0, geo.CELL_CORNER)
    return tr.truth_majority(grid, small, (90, 180), 5.0, geo.CELL_CORNER).select("idx", "truth")


def truth_refill(spark, sf):
    t = tr.truth_cell_center(cells(spark), mask_rle(spark, sf), SHAPE)
    p = tb.points(spark, sf)
    kept = tr.truth_refill(p, t).select("run_id", "idx", F.col("truth").alias("truth_filled"))
    new = tr.truth_refill(p, t, mask_changed=True).select("run_id", "idx", F.col("truth").alias("truth_replaced"))
    return kept.join(new, ["run_id", "idx"])


def mask_fidelity_check(spark, sf):
    """Runs of the history whose spec was planned with another mask than the one in use."""
    fp = mk.mask_fingerprint(mask_rle(spark, sf), SHAPE, tb.masks(spark))
    specs = fp.select(
        "mask_id",
        F.explode(
            F.array(
                F.struct(F.lit("s0").alias("spec_id"), F.col("mask_hash")),
                F.struct(F.lit("s1").alias("spec_id"), F.lit("older mask").alias("mask_hash")),
                F.struct(F.lit("s2").alias("spec_id"), F.col("mask_hash")),
            )
        ).alias("s"),
    ).select("mask_id", "s.*")
    bad = tr.mask_fidelity(tb.run_log(spark, sf), specs, fp)
    stop = F.when(F.col("status") == "complete", F.lit("warn")).otherwise(F.lit("refuse resume"))
    return bad.select("run_id", "spec_id", stop.alias("action"))


QUERIES = {
    "mask_source_rle": mask_source_rle,
    "mask_rle_rows": mask_rle_rows,
    "mask_pixel_of": mask_pixel_of,
    "land_fraction": land_fraction,
    "mask_fingerprint": mask_fingerprint,
    "mask_downsample_edges": mask_downsample_edges,
    "mask_resample_mixed": mask_resample_mixed,
    "mask_downsample_work": mask_downsample_work,
    "mask_downsample_nearest": mask_downsample_nearest,
    "gray_luminance": gray_luminance,
    "mercator_reproject": mercator_reproject,
    "otsu_threshold": otsu_threshold,
    "binarise": binarise,
    "polygon_edges": polygon_edges,
    "rasterize_polygons": rasterize_polygons,
    "truth_cell_center": truth_cell_center,
    "truth_majority": truth_majority,
    "truth_majority_corner": truth_majority_corner,
    "truth_refill": truth_refill,
    "mask_fidelity_check": mask_fidelity_check,
}
