"""Raster work on pixel tables: rendering, boundaries, distances, similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions.common import exact_quantiles, num, safe_div
from cellscore.operators import runs as rn
from cellscore.operators.tiles import nearest_distance, render_tiles, tile_scores  # noqa: F401  (part of this module's surface)

TOLERANCES = (2.0, 4.0)


def _source(n_out: int, extent: float, step: float, off: float) -> Column:
    return (F.col("id") + 0.5) * (extent / n_out) / step - off


def render_nearest(grid: DataFrame, step: float, shape: tuple[int, int], placement: str = geo.CELL_CENTER) -> DataFrame:
    """Grid rows (.., r, c) on the pixels nearest to them: two index tables, two equi joins."""
    spark, (h, w) = grid.sparkSession, shape
    n_r, n_c = geo.grid_dims(step)
    off = geo.half_cell(placement)
    ri = geo.clip(F.floor(_source(h, 180.0, step, off) + 0.5), 0, n_r - 1).cast("int")
    ci = F.pmod(F.floor(_source(w, 360.0, step, off) + 0.5), F.lit(n_c)).cast("int")
    rows = spark.range(h).select(F.col("id").cast("int").alias("pr"), ri.alias("r"))
    cols = spark.range(w).select(F.col("id").cast("int").alias("pc"), ci.alias("c"))
    return grid.join(rows, "r").join(cols, "c").drop("r", "c").withColumnsRenamed({"pr": "r", "pc": "c"})


def overlay_class(pred: Column, truth: Column) -> Column:
    return (
        F.when(pred & truth, F.lit("land"))
        .when(pred, F.lit("false_land"))
        .when(truth, F.lit("false_water"))
        .otherwise(F.lit("water"))
    )


def boundary_cells(cells: DataFrame, keys: Sequence[str], value: str, w: int) -> DataFrame:
    """Cells (keys, r, c, value) that differ from a known 4-neighbour; longitude wraps, latitude does not.

    ``cells`` holds the known cells only. They become runs, which are compared with the runs below and beside them.
    """
    known = rn.value_runs(cells, keys, value)
    found = rn.boundary_runs(known.where(F.col(value)), keys, (None, w), known)
    return rn.pixels(found).select(*keys, "r", "c", F.col("value").alias(value))


def coastline_error(flags: DataFrame, step: float, placement: str = geo.CELL_CENTER) -> DataFrame:
    """Mean distance of predicted boundary cells to the true coastline, per run on the eval grid."""
    shape = geo.grid_dims(step)
    d = flags.withColumn("r", geo.cell_row(F.col("lat"), step, placement))
    d = d.withColumn("c", geo.cell_col(F.col("lon"), step, placement))
    pred = boundary_cells(d.where("valid"), ["run_id"], "pred_land", shape[1])
    true = boundary_cells(d.where("known"), ["run_id"], "t_land", shape[1])
    dist = nearest_distance(pred, true, ["run_id"], shape, step, step)
    mean = dist.groupBy("run_id").agg(F.avg("distance").alias("coastline_error_deg"))
    return flags.select("run_id").distinct().join(mean, "run_id", "left")  # NULL without either boundary


def boundary_scores(
    pred: DataFrame, true: DataFrame, runs: DataFrame, shape: tuple[int, int], tolerances: Sequence[float] = TOLERANCES
) -> DataFrame:
    """Precision, recall and F of boundary pixels, and contour distances, per run.

    ``pred`` has (run_id, r, c), ``true`` (mask_id, r, c), ``runs`` (run_id, mask_id). A mask's distances are made once for
    all runs that are held against it.
    """
    h, w = shape
    dy, dx = 180.0 / h, 360.0 / w
    own = pred.join(runs.select("run_id", "mask_id"), "run_id").select("run_id", "mask_id", "r", "c")
    to_true = nearest_distance(own.select("mask_id", "r", "c").distinct(), true, ["mask_id"], shape, dy, dx)
    dp = own.join(to_true, ["mask_id", "r", "c"])
    rows = own.select("run_id", "mask_id").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    asked = rows.join(true.select("mask_id", "r", "c"), ["mask_id", "r"])  # every run is asked at every true boundary pixel
    dt = nearest_distance(asked, pred, ["run_id"], shape, dy, dx)
    ps = dp.groupBy("run_id").agg(
        F.count("*").alias("n_pred"),
        F.avg("distance").alias("contour_mean_deg"),
        *[F.avg(num(F.col("distance") <= t)).alias(f"p_{t:g}") for t in tolerances],
    )
    rs = dt.groupBy("run_id").agg(
        F.count("*").alias("n_true"), *[F.avg(num(F.col("distance") <= t)).alias(f"r_{t:g}") for t in tolerances]
    )
    p95 = exact_quantiles(dp, ["run_id"], "distance", {"contour_p95_deg": 0.95})
    n_true = true.groupBy("mask_id").agg(F.count("*").alias("_nt"))
    d = runs.select("run_id", "mask_id").join(ps, "run_id", "left").join(rs, "run_id", "left").join(p95, "run_id", "left")
    d = d.join(n_true, "mask_id", "left").na.fill(0, ["_nt"])
    none, empty = F.col("n_pred").isNull() & (F.col("_nt") == 0), F.col("n_pred").isNull() | (F.col("_nt") == 0)
    out = []
    for tol in tolerances:
        p, r = F.col(f"p_{tol:g}"), F.col(f"r_{tol:g}")
        f = F.coalesce(safe_div(2 * p * r, p + r), F.lit(0.0))
        for name, v in (("f", f), ("p", p), ("r", r)):
            out.append(
                F.when(none, F.lit(1.0)).when(empty, F.lit(0.0)).otherwise(v).alias(f"boundary_{name}_{tol:g}")
            )
    return d.select(
        "run_id",
        *out,
        "contour_mean_deg",
        "contour_p95_deg",
        (F.col("contour_mean_deg") * geo.KM_PER_DEG).alias("contour_mean_km"),
        (F.col("contour_p95_deg") * geo.KM_PER_DEG).alias("contour_p95_km"),
    )


def row_weight(h: int) -> Column:
    return F.cos(F.radians(geo.pixel_lat(F.col("r"), h)))


def with_truth(pred: DataFrame, truth: DataFrame, runs: DataFrame, shape: tuple[int, int], whole: bool = False) -> DataFrame:
    """Stretches (run_id, r, c0, c1) with flags pred and truth, of land runs ``pred`` (run_id, r, c0, c1) and ``truth``
    (mask_id, r, c0, c1) for each of ``runs`` (run_id, mask_id); with ``whole`` also those that are water in both."""
    h, w = shape
    rows = runs.select("run_id", "mask_id", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("r"))
    own = rows.join(truth.select("mask_id", "r", "c0", "c1"), ["mask_id", "r"]).drop("mask_id")
    every = rows.select("run_id", "r", F.lit(0).alias("c0"), F.lit(w - 1).alias("c1")) if whole else None
    return rn.states({"pred": pred, "truth": own}, ["run_id", "r"], every)


def error_overlay(pred: DataFrame, truth: DataFrame, runs: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """run_id, r, pixel_class and n, the pixels of the class in the image row."""
    d = with_truth(pred, truth, runs, shape, whole=True).withColumn("pixel_class", overlay_class(F.col("pred"), F.col("truth")))
    return d.groupBy("run_id", "r", "pixel_class").agg(F.sum(rn.length()).cast("bigint").alias("n"))


def pixel_overlap(pred: DataFrame, truth: DataFrame, runs: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """cos-weighted IoU and Dice per run, from runs of land as in ``with_truth``; 1 where neither has land."""
    n = row_weight(shape[0]) * rn.length()
    p, t = num(F.col("pred")), num(F.col("truth"))
    s = with_truth(pred, truth, runs, shape).groupBy("run_id").agg(F.sum(n * p * t).alias("i"), F.sum(n * p).alias("p"), F.sum(n * t).alias("t"))
    union = F.col("p") + F.col("t") - F.col("i")
    return runs.select("run_id").join(s, "run_id", "left").select(
        "run_id",
        F.coalesce(safe_div(F.col("i"), union), F.lit(1.0)).alias("pixel_iou"),
        F.coalesce(safe_div(2 * F.col("i"), F.col("p") + F.col("t")), F.lit(1.0)).alias("dice"),
    )
