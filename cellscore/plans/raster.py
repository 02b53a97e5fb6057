"""Rendered images of the runs, scored against the mask, with the ceiling of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions.common import rounded
from cellscore.operators import components as cc
from cellscore.operators import raster as ra
from cellscore.operators import runs as rn
from cellscore.operators import score as sc
from cellscore.operators import truth as tr
from cellscore.operators import uncertainty as un
from cellscore.operators.regions import region_accuracy
from cellscore.plans.masks import SHAPE, mask_rle
from cellscore.plans.scoring import flags, kept_flags, kept_points
from cellscore.session import cut_lineage, stored
from cellscore.sources import masks as mk
from cellscore.sources import testbed as tb
from cellscore.sources.grid import cells_of, full_grid, with_cell

CEILING, MASK = "ceiling", "mask"
SPECK_KM2 = (tb.STEP * geo.KM_PER_DEG) ** 2
HIGHER = ("pixel_iou", "dice", "ssim", "boundary_f_2", "boundary_f_4")
LOWER = ("contour_mean_deg", "contour_p95_deg", "contour_mean_km", "contour_p95_km", "prob_rmse")


def run_list(spark: SparkSession) -> DataFrame:
    """(run_id, mask_id) of the images: the runs, and the mask itself reduced to the grid."""
    extra = spark.range(1).select(F.lit(CEILING).alias("run_id"))
    return tb.runs(spark).select("run_id").unionByName(extra).withColumn("mask_id", F.lit(MASK))


def grids(spark: SparkSession, sf: str, f: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Dense grids (run_id, r, c, p, b) of the flags; the mask reduced to the grid is one more run."""
    cells = with_cell(cells_of(tb.runs(spark).select("run_id"), tb.STEP), tb.STEP).select("run_id", "idx", "r", "c")
    f = (flags(spark, sf) if f is None else f).select("run_id", "idx", F.col("p_land").alias("p"), F.col("pred_land").alias("b"))
    d = cells.join(f, ["run_id", "idx"], "left")
    d = d.select("run_id", "r", "c", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("b", F.lit(False)).alias("b"))
    return d.unionByName(ceiling_grid(spark, sf, mask))


def ceiling_grid(spark: SparkSession, sf: str, mask: DataFrame | None = None) -> DataFrame:
    t = tr.truth_cell_center(full_grid(spark, tb.STEP), mask_rle(spark, sf) if mask is None else mask, SHAPE)
    return t.select(F.lit(CEILING).alias("run_id"), "r", "c", F.col("truth").cast("double").alias("p"), (F.col("truth") == 1).alias("b"))


def pred_runs(spark: SparkSession, sf: str, g: DataFrame | None = None) -> DataFrame:
    """Land runs of the binary images, rendered from the land runs of the grids."""
    land = (grids(spark, sf) if g is None else g).where("b").select("run_id", "r", "c", F.col("b").alias("land"))
    return rn.render_runs(rn.value_runs(land, ["run_id"], "land").drop("land"), ["run_id"], tb.STEP, SHAPE)


def render_nearest(spark, sf):
    """Pixels, land pixels and their columns' sum in each image row."""
    d = pred_runs(spark, sf).groupBy("run_id", "r").agg(
        F.sum(rn.length()).cast("bigint").alias("n_land"), F.sum(rn.length() * (F.col("c0") + F.col("c1")) / 2).cast("bigint").alias("sum_c")
    )
    rows = run_list(spark).select("run_id", F.explode(F.sequence(F.lit(0), F.lit(SHAPE[0] - 1))).alias("r"))
    return rows.join(d, ["run_id", "r"], "left").na.fill(0).withColumn("n", F.lit(SHAPE[1]).cast("bigint"))


def render_bilinear(spark, sf):
    d = ra.render_tiles(grids(spark, sf), ["run_id"], "p", tb.STEP, SHAPE)

    def mean(weight) -> F.Column:
        return F.aggregate(F.transform("values", lambda v, i: v * weight(i)), F.lit(0.0), lambda a, v: a + v) / SHAPE[1]

    return rounded(
        d.select(
            "run_id",
            "r",
            F.size("values").cast("bigint").alias("n"),
            mean(lambda i: F.sqrt(i + 2.0)).alias("mean_p_sqrt"),
            mean(lambda i: F.log(i + 2.0)).alias("mean_p_log"),
            (F.array_max("values") * F.sqrt(F.lit(2.0))).alias("max_p_sqrt2"),
        )
    )


def error_overlay(spark, sf):
    return ra.error_overlay(pred_runs(spark, sf), mask_rle(spark, sf), run_list(spark), SHAPE)


def boundary_cells(spark, sf):
    f = flags(spark, sf).where("valid").select("run_id", "r", "c", "pred_land")
    return ra.boundary_cells(f, ["run_id"], "pred_land", 90)


def distance_transform(spark, sf):
    """Distance of every evaluated cell to the predicted coast of its run."""
    f = kept_flags(spark, sf)
    b = ra.boundary_cells(f.where("valid"), ["run_id"], "pred_land", 90)
    d = ra.nearest_distance(f, b, ["run_id"], geo.grid_dims(tb.STEP), tb.STEP, tb.STEP)
    return rounded(d)


def coastline_error(spark, sf):
    return rounded(ra.coastline_error(kept_flags(spark, sf), tb.STEP))


def _boundary_scores(spark, sf, pred=None, runs=None, mask=None):
    """Boundary pixels of images and mask are written once, as several steps read them."""
    pred, mask = pred_runs(spark, sf) if pred is None else pred, mask_rle(spark, sf) if mask is None else mask
    own = cut_lineage(rn.pixels(rn.boundary_runs(pred, ["run_id"], SHAPE)).select("run_id", "r", "c"))
    true = cut_lineage(rn.pixels(rn.boundary_runs(mask, ["mask_id"], SHAPE)).select("mask_id", "r", "c"))
    return ra.boundary_scores(own.distinct(), true.distinct(), run_list(spark) if runs is None else runs, SHAPE)


def boundary_f(spark, sf):
    d = _boundary_scores(spark, sf)
    return rounded(d.select("run_id", *[c for c in d.columns if c.startswith("boundary")]))


def contour_distance(spark, sf):
    d = _boundary_scores(spark, sf)
    return rounded(d.select("run_id", *[c for c in d.columns if c.startswith("contour")]))


def pixel_iou_dice(spark, sf):
    return rounded(ra.pixel_overlap(pred_runs(spark, sf), mask_rle(spark, sf), run_list(spark), SHAPE))


def _tile_scores(spark, sf, g=None, runs=None, mask=None, points=None):
    """ssim and prob_rmse; the latter only for runs with real probabilities (the ceiling has them)."""
    g, mask = grids(spark, sf) if g is None else g, mask_rle(spark, sf) if mask is None else mask
    d = ra.tile_scores(g, mask, run_list(spark) if runs is None else runs, "p", tb.STEP, SHAPE)
    points = tb.points(spark, sf, "n_samples") if points is None else points
    prob = sc.is_probabilistic(points, tb.runs(spark)).select("run_id", "probabilistic")
    keep = F.coalesce("probabilistic", F.lit(True))
    return d.join(prob, "run_id", "left").select("run_id", "ssim", F.when(keep, F.col("prob_rmse")).alias("prob_rmse"))


def ssim(spark, sf):
    return rounded(_tile_scores(spark, sf).select("run_id", "ssim"))


def prob_rmse(spark, sf):
    return rounded(_tile_scores(spark, sf).select("run_id", "prob_rmse"))


def true_components(spark: SparkSession, sf: str, mask: DataFrame | None = None) -> DataFrame:
    return cc.label_components((mask_rle(spark, sf) if mask is None else mask).drop("mask_id"), [], SHAPE[1])


def pred_components(spark: SparkSession, sf: str, pred: DataFrame | None = None) -> DataFrame:
    return cc.label_components(pred_runs(spark, sf) if pred is None else pred, ["run_id"], SHAPE[1])


def connected_components(spark, sf):
    d = true_components(spark, sf)
    return d.groupBy("label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n_pixels"), F.count("*").alias("n_runs"))


def predicted_runs(spark: SparkSession) -> DataFrame:
    """The runs whose land is predicted, the ceiling among them; some may have none."""
    return tb.runs(spark).select("run_id").unionByName(spark.createDataFrame([("ceiling",)], "run_id string"))


def component_stats(spark, sf):
    return rounded(_component_stats(spark, sf, pred_components(spark, sf), true_components(spark, sf)), 4)


def _component_stats(spark, sf, pred, true):
    d = cc.component_stats(pred, true, SHAPE, SPECK_KM2, predicted_runs(spark))
    return d.withColumns({c: F.array_join(F.transform(c, lambda x: F.format_string("%.1f", x)), ", ") for c in ("largest_pred_km2", "largest_true_km2")})


def top_components(spark, sf):
    areas = cc.component_areas(pred_components(spark, sf), ["run_id"], SHAPE)
    return rounded(cc.top_components(areas, ["run_id"]).select("run_id", "rank", "area_km2"), 3)


def _landmasses(spark, sf):
    return cc.landmasses(true_components(spark, sf), SHAPE)


def landmass_names(spark, sf):
    d = _landmasses(spark, sf)
    return rounded(d.select("label", "rank", "name", "area_km2", "centroid_lat", "centroid_lon"), 4)


def _landmass_iou(spark, sf):
    true = true_components(spark, sf)
    return cc.landmass_iou(pred_components(spark, sf), true, cc.landmasses(true, SHAPE), run_list(spark).select("run_id"), SHAPE)


def landmass_iou(spark, sf):
    return rounded(_landmass_iou(spark, sf))


def image_coverage(spark, sf):
    n = flags(spark, sf).groupBy("run_id").agg((F.sum(F.col("valid").cast("int")) / tb.N_CELLS).alias("coverage"))
    return rounded(n)


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Land runs of the mask, points and grids, written once: for all its steps a job reads the log once for the mask and once
    for the points."""
    mask, points = stored(mask_rle(spark, sf)), kept_points(spark, sf, "n_samples")
    return mask, points, stored(grids(spark, sf, sc.point_flags(points), mask))


def _joined(first: DataFrame, *parts: DataFrame) -> DataFrame:
    """``first`` with the columns of parts of one row a run, each made in a job of its own."""
    for part in parts:
        first = first.join(stored(part), "run_id", "left")
    return first


def _image_scores(spark, sf, mask, points, g, pred=None, runs=None):
    """All scores of the images of ``runs``; grids and land runs are made once and are far smaller than the images."""
    runs = run_list(spark) if runs is None else runs
    pred = stored(pred_runs(spark, sf, g)) if pred is None else pred
    return _joined(
        runs.select("run_id"),
        ra.pixel_overlap(pred, mask, runs, SHAPE),
        _tile_scores(spark, sf, g, runs, mask, points),
        _boundary_scores(spark, sf, pred, runs, mask),
    )


def resolution_ceiling(spark, sf):
    """Only the grid made from the mask is rendered and scored."""
    only, mask = run_list(spark).where(F.col("run_id") == CEILING), stored(mask_rle(spark, sf))
    g = stored(ceiling_grid(spark, sf, mask))
    return rounded(_image_scores(spark, sf, mask, tb.points(spark, sf, "n_samples"), g, None, only).drop("run_id"))


def share_of_ceiling_columns() -> list:
    """Model over ceiling where higher is better, ceiling over model where lower is."""
    out = []
    for n in HIGHER:
        m, c = F.col(n), F.col(f"ceil_{n}")
        out.append(F.when(c > 0, m / c).alias(f"share_{n}"))
    for n in LOWER:
        m, c = F.col(n), F.col(f"ceil_{n}")
        both = m.isNotNull() & c.isNotNull()
        out.append(F.when(both & (m <= 0), F.lit(1.0)).when(both, c / m).alias(f"share_{n}"))
    return out


def with_ceiling(scores: DataFrame) -> DataFrame:
    top = scores.where(F.col("run_id") == CEILING).select(*[F.col(n).alias(f"ceil_{n}") for n in HIGHER + LOWER])
    return scores.where(F.col("run_id") != CEILING).crossJoin(F.broadcast(top))  # one row


def share_of_ceiling(spark, sf):
    return rounded(with_ceiling(_image_scores(spark, sf, *_tables(spark, sf))).select("run_id", *share_of_ceiling_columns()))


BOUNDARY = ("boundary_p_2", "boundary_r_2", "boundary_p_4", "boundary_r_4")


def image_metrics(spark, sf):
    """All scores of a run's image, of the grid's ceiling and their shares, components, landmasses and the work shape."""
    mask, points, g = _tables(spark, sf)
    pred = stored(pred_runs(spark, sf, g))
    true, areas = stored(true_components(spark, sf, mask)), stored(pred_components(spark, sf, pred))
    cover = sc.point_flags(points).groupBy("run_id").agg((F.sum(F.col("valid").cast("int")) / tb.N_CELLS).alias("coverage"))
    per = cc.landmass_iou(areas, true, cc.landmasses(true, SHAPE), run_list(spark).select("run_id"), SHAPE)
    per = per.groupBy("run_id").agg(F.sort_array(F.collect_list(F.concat("name", F.lit(" "), F.format_string("%.4f", "iou")))).alias("a"))  # MAX_LANDMASSES at most
    d = with_ceiling(_image_scores(spark, sf, mask, points, g, pred))
    d = d.select("run_id", *HIGHER, *LOWER, *BOUNDARY, *[f"ceil_{n}" for n in HIGHER + LOWER], *share_of_ceiling_columns())
    d = _joined(d, _component_stats(spark, sf, areas, true).drop("largest_km2"), cover, per.select("run_id", F.array_join("a", "; ").alias("landmass_iou")))
    return rounded(d.withColumns({"work_rows": F.lit(SHAPE[0]), "work_columns": F.lit(SHAPE[1])}))


def score_all(spark, sf):
    """Stored record per run at two thresholds: context, cell scores, interval, regions, coast, image, and whether it is partial (by its
    points or its status). A run is held against the mask of its spec."""
    p, mask = kept_points(spark, sf, "n_samples", "latency_s", "input_tokens", "output_tokens", "thinking_tokens"), stored(mask_rle(spark, sf))
    marks = stored(mk.mask_fingerprint(mask, SHAPE, tb.masks(spark)))
    runs = run_list(spark).where(F.col("run_id") != CEILING)
    context = tb.runs(spark).select("run_id", "variant", "thinking", "forced_thinking").join(tb.run_state(spark).select("run_id", "status"), "run_id").join(tb.run_costs(spark, sf), "run_id", "left")
    context = stored(context)
    tiles = stored(_tile_scores(spark, sf, stored(grids(spark, sf, sc.point_flags(p), mask)), runs, mask, p))  # probabilities do not depend on the threshold
    out = None
    for t in (0.5, 0.7):
        f = sc.point_flags(p, t)
        regions = region_accuracy(f).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("position", "region", "acc"))).alias("a"))  # at most one a region
        named = F.transform("a", lambda x: F.concat(x["region"], F.lit(" "), F.format_string("%.4f", x["acc"])))
        ci = un.block_bootstrap_ci(f).select("run_id", F.col("lo").alias("acc_lo"), F.col("hi").alias("acc_hi"))
        pred = stored(pred_runs(spark, sf, grids(spark, sf, f, mask).where(F.col("run_id") != CEILING)))
        d = _joined(
            stored(sc.cell_metrics(p, tb.runs(spark), t).drop("calibration_bins")),
            regions.select("run_id", F.array_join(named, "; ").alias("regions")),
            ci,
            ra.coastline_error(f, tb.STEP),
            ra.pixel_overlap(pred, mask, runs, SHAPE),
        ).join(tiles, "run_id", "left")
        d = _joined(d, _boundary_scores(spark, sf, pred, runs, mask)).join(context, "run_id", "left").join(runs, "run_id", "left").join(marks, "mask_id", "left")
        unfinished = (F.col("n_points") < tb.N_CELLS) | (F.col("status") != "complete")
        d = d.withColumn("n_points_total", F.lit(tb.N_CELLS)).withColumn("partial", unfinished)
        out = d if out is None else out.unionByName(d)
    return rounded(out)


QUERIES = {
    "render_nearest": render_nearest,
    "render_bilinear": render_bilinear,
    "error_overlay": error_overlay,
    "boundary_cells": boundary_cells,
    "distance_transform": distance_transform,
    "coastline_error": coastline_error,
    "boundary_f": boundary_f,
    "contour_distance": contour_distance,
    "pixel_iou_dice": pixel_iou_dice,
    "ssim": ssim,
    "prob_rmse": prob_rmse,
    "connected_components": connected_components,
    "component_stats": component_stats,
    "top_components": top_components,
    "landmass_names": landmass_names,
    "landmass_iou": landmass_iou,
    "image_coverage": image_coverage,
    "resolution_ceiling": resolution_ceiling,
    "share_of_ceiling": share_of_ceiling,
    "image_metrics": image_metrics,
    "score_all": score_all,
}
