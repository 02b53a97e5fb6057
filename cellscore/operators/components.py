"""Connected land areas of masks and prediction images, on run-length rows instead of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions.common import safe_div
from cellscore.operators import runs as rn
from cellscore.session import cut_lineage

BAND = 64

# Which true areas count as landmasses, and how many.
MIN_LANDMASS_KM2 = 5.0e5
MAX_LANDMASSES = 12
NAME_SHARE = 0.15
TEN = 10
NO_LONGITUDE = 1e-9


def _bands(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return df.withColumn("_band", F.explode(F.sequence(F.floor(lo / BAND), F.floor(hi / BAND))))


def _touching(segs: DataFrame, keys: list[str], w: int) -> DataFrame:
    """Pairs (u, v) of runs that touch, diagonals included, with the 180 degree seam closed.

    A run that ends in the last column is also put at column -1. Runs meet by row and by band of
    columns, so a row of many short runs is not compared run by run.
    """
    twin = segs.where(F.col("c1") == w - 1).withColumns({"c0": F.lit(-1), "c1": F.lit(-1)})
    parts = segs.unionByName(twin)
    a = parts.select(*keys, F.col("id").alias("u"), F.col("c0").alias("a0"), F.col("c1").alias("a1"),
                     F.explode(F.array("r", F.col("r") + 1)).alias("r"))
    b = parts.select(*keys, F.col("id").alias("v"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), "r")
    a = _bands(a, F.col("a0") - 1, F.col("a1") + 1)
    b = _bands(b, F.col("b0"), F.col("b1"))
    near = (F.col("a0") <= F.col("b1") + 1) & (F.col("b0") <= F.col("a1") + 1)
    j = a.join(b, [*keys, "r", "_band"]).where(near & (F.col("u") != F.col("v")))
    return j.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def label_components(rle: DataFrame, keys: Sequence[str], w: int) -> DataFrame:
    """Adds ``label`` to land runs: the smallest run id (raster order) of the connected area.

    Alternating star contraction: every run points at the smallest run it knows, until nothing
    changes; the number of rounds grows with the logarithm of the longest chain. Each round is
    written to the checkpoint folder.
    """
    keys = list(keys)
    segs = rle.withColumn("id", F.col("r").cast("bigint") * w + F.col("c0"))
    segs = cut_lineage(segs)
    edges = cut_lineage(_touching(segs, keys, w))
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, [*keys, "u"])
        large = large.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(*keys, "u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut_lineage(small)
        several = edges.groupBy(*keys, "u").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "u")
        chained = edges.select(*keys, F.col("v").alias("u")).distinct().join(edges.select(*keys, "u"), [*keys, "u"], "left_semi")
        if several.unionByName(chained).isEmpty():  # every run points at one that points nowhere
            break
    labels = edges.groupBy(*keys, F.col("u").alias("id")).agg(F.min("v").alias("_m"))
    d = segs.join(labels, [*keys, "id"], "left")
    return d.withColumn("label", F.coalesce("_m", "id")).drop("_m", "id")


def row_area(h: int, w: int) -> Column:
    """Area of one pixel in km2 by its row."""
    k = geo.EARTH_RADIUS_KM**2 * (3.141592653589793 / h) * (2 * 3.141592653589793 / w)
    return F.cos(F.radians(geo.pixel_lat(F.col("r"), h))) * k


def component_areas(labelled: DataFrame, keys: Sequence[str], shape: tuple[int, int]) -> DataFrame:
    h, w = shape
    n = F.col("c1") - F.col("c0") + 1
    weight = F.cos(F.radians(geo.pixel_lat(F.col("r"), h)))
    return labelled.groupBy(*keys, "label").agg(
        F.sum(n).alias("n_pixels"), F.sum(n * weight).alias("weight"), F.sum(n * row_area(h, w)).alias("area_km2")
    )


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], shape: tuple[int, int]) -> DataFrame:
    """Common pixels of areas of A (keys, label_a) and of B (label_b; shared by all keys)."""
    h, _ = shape
    left = a.select(*keys, F.col("label").alias("label_a"), "r", F.col("c0").alias("a0"), F.col("c1").alias("a1"))
    right = b.select(F.col("label").alias("label_b"), "r", F.col("c0").alias("b0"), F.col("c1").alias("b1"))
    left, right = _bands(left, F.col("a0"), F.col("a1")), _bands(right, F.col("b0"), F.col("b1"))
    lo = F.greatest("a0", "b0", F.col("_band") * BAND)
    hi = F.least("a1", "b1", F.col("_band") * BAND + BAND - 1)
    n = hi - lo + 1
    j = left.join(right, ["r", "_band"]).where(n > 0)
    weight = F.cos(F.radians(geo.pixel_lat(F.col("r"), h)))
    return j.groupBy(*keys, "label_a", "label_b").agg(F.sum(n).alias("n"), F.sum(n * weight).alias("w"))


def component_stats(
    pred: DataFrame, true: DataFrame, shape: tuple[int, int], min_km2: float, runs: DataFrame | None = None
) -> DataFrame:
    """Per run: number of predicted areas, large ones, specks (touch no true land), the largest; the same of the true areas, and
    the ten largest areas of both in order, in km2.

    ``runs`` (run_id) lists the runs; those that predict no land have zeros."""
    areas = component_areas(pred, ["run_id"], shape)
    true_areas = component_areas(true, [], shape)
    big = top_components(areas, ["run_id"], TEN).groupBy("run_id").agg(ten_largest())
    truth = true_areas.agg(F.count("*").alias("n_components_true"), F.count(F.when(F.col("area_km2") >= min_km2, 1)).alias("n_components_true_large"))
    truth = truth.crossJoin(top_components(true_areas, [], TEN).agg(ten_largest()).withColumnRenamed("largest", "largest_true_km2"))  # one row
    touched = overlaps(pred, true, ["run_id"], shape).select("run_id", F.col("label_a").alias("label")).distinct()
    specks = areas.join(touched, ["run_id", "label"], "left_anti").groupBy("run_id").agg(F.count("*").alias("_sp"))
    agg = areas.groupBy("run_id").agg(
        F.count("*").alias("n_components"),
        F.count(F.when(F.col("area_km2") >= min_km2, 1)).alias("n_components_large"),
        F.max("area_km2").alias("largest_km2"),
    )
    d = agg.join(specks, "run_id", "left")
    d = d.join(big.withColumnRenamed("largest", "largest_pred_km2"), "run_id", "left")
    d = d if runs is None else runs.select("run_id").distinct().join(d, "run_id", "left").na.fill(0).na.fill(0.0)
    d = d.withColumn("largest_pred_km2", F.coalesce("largest_pred_km2", F.array().cast("array<double>")))
    return d.withColumn("spurious_specks", F.coalesce("_sp", F.lit(0))).drop("_sp").crossJoin(F.broadcast(truth))


def ten_largest() -> Column:
    """The areas of the ranked rows in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct("rank", "area_km2"))), lambda x: x["area_km2"]).alias("largest")


def top_components(areas: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("area_km2").desc(), "label")
    return areas.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def landmasses(labelled: DataFrame, shape: tuple[int, int], min_km2: float = MIN_LANDMASS_KM2) -> DataFrame:
    """Large true areas with name (continents holding 15 % of the pixels) and centroid."""
    _, w = shape
    areas = component_areas(labelled, [], shape).where(F.col("area_km2") >= min_km2)
    big = top_components(areas, [], MAX_LANDMASSES)
    px = rn.region_pieces(labelled.join(big.select("label"), "label", "left_semi"), shape)
    sines, cosines = rn.lon_sums(w)
    per = px.groupBy("label", "continent").agg(
        F.sum(rn.length()).alias("n"), F.sum(F.col("lat") * rn.length()).alias("lat"), F.sum(sines).alias("s"), F.sum(cosines).alias("k")
    )
    tot = F.sum("n").over(Window.partitionBy("label"))
    per = per.withColumn("share", F.col("n") / tot)
    top = F.max(F.struct("n", "continent"))["continent"]
    named = per.groupBy("label").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("share") >= NAME_SHARE, F.struct(-F.col("n"), "continent")))),
                lambda x: x["continent"],
            ),
            " + ",
        ).alias("name"),
        top.alias("_top"),
        (F.sum("lat") / F.sum("n")).alias("centroid_lat"),
        # land all around the globe has no mean longitude
        F.when(F.hypot(F.sum("s"), F.sum("k")) / F.sum("n") > NO_LONGITUDE, F.degrees(F.atan2(F.sum("s") / F.sum("n"), F.sum("k") / F.sum("n")))).alias("centroid_lon"),
    )
    named = named.withColumn("name", F.when(F.col("name") == "", F.col("_top")).otherwise(F.col("name"))).drop("_top")
    d = big.join(named, "label")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("rank"))
    d = d.withColumn("_nth", nth)
    name = F.when(F.col("_nth") > 1, F.concat("name", F.lit(" #"), F.col("_nth").cast("string"))).otherwise(F.col("name"))
    return d.withColumn("name", name).drop("_nth")


def landmass_iou(
    pred: DataFrame, true: DataFrame, masses: DataFrame, runs: DataFrame, shape: tuple[int, int]
) -> DataFrame:
    """Per run and landmass: IoU with the predicted area that overlaps it most, 0 if none does."""
    ov = overlaps(pred, true.join(masses.select("label"), "label", "left_semi"), ["run_id"], shape)
    best = ov.groupBy("run_id", F.col("label_b").alias("label")).agg(
        F.max_by(F.struct("label_a", "w"), F.struct("n", -F.col("label_a"))).alias("b")
    )
    size = component_areas(pred, ["run_id"], shape).select("run_id", F.col("label").alias("label_a"), F.col("weight").alias("wp"))
    hit = best.select("run_id", "label", F.col("b.label_a").alias("label_a"), F.col("b.w").alias("wi")).join(
        size, ["run_id", "label_a"]
    )
    few = F.broadcast(masses.select("label", "name", F.col("weight").alias("wt")))  # MAX_LANDMASSES rows at most
    every = runs.select("run_id").crossJoin(few)
    d = every.join(hit, ["run_id", "label"], "left")
    iou = safe_div(F.col("wi"), F.col("wt") + F.col("wp") - F.col("wi"))
    return d.select("run_id", "name", F.coalesce(iou, F.lit(0.0)).alias("iou"))
