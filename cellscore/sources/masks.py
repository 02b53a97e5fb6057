"""Truth masks: run-length rows, resampling, uploads, polygons and fingerprints.

The stored form is one row per run of land pixels (mask_id, r, c0, c1); resampling and truth work on
the runs themselves, so a mask of 8e8 pixels is handled as some ten million rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.operators import runs as rn

ROW_BAND = 256


def to_rle(pixels: DataFrame, keys: tuple[str, ...] = ("mask_id",)) -> DataFrame:
    """Pixel table (keys, r, c, land) to runs of land. A window holds one pixel row at most."""
    w = Window.partitionBy(*keys, "r").orderBy("c")
    d = pixels.where("land").select(*keys, "r", "c", (F.col("c") - F.row_number().over(w)).alias("_g"))
    return d.groupBy(*keys, "r", "_g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("_g")


def from_rle(rle: DataFrame, rows: tuple[int, int] | None = None) -> DataFrame:
    """Land pixels of the runs, of the wanted rows only (first and last row)."""
    d = rle if rows is None else rle.where(F.col("r").between(*rows))
    keep = [c for c in d.columns if c not in ("c0", "c1")]
    return d.select(*keep, F.explode(F.sequence("c0", "c1")).alias("c"))


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def _nearest_first(i: Column, n_in: int, n_out: int) -> Column:
    """First output index whose nearest-sampled input index is at least i."""
    return _ceil_div(2 * i.cast("bigint") * n_out - n_in, 2 * n_in)


def _nearest_axis(rle: DataFrame, n_in: int, n_out: int, axis: str) -> DataFrame:
    if axis == "r":
        lo, hi = _nearest_first(F.col("r"), n_in, n_out), _nearest_first(F.col("r") + 1, n_in, n_out) - 1
        d = rle.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
        return d.withColumn("r", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    lo, hi = _nearest_first(F.col("c0"), n_in, n_out), _nearest_first(F.col("c1") + 1, n_in, n_out) - 1
    return rle.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").drop("c0", "c1").withColumnsRenamed(
        {"_lo": "c0", "_hi": "c1"}
    )


def _bin_of(i: Column, n_in: int, n_out: int) -> Column:
    """Output bin of an input index when bin edges are rounded down to whole inputs."""
    return F.floor(((i.cast("bigint") + 1) * n_out - 1) / n_in).cast("int")


def _edge(j: Column, n_in: int, n_out: int) -> Column:
    return F.floor(j.cast("bigint") * n_in / n_out).cast("int")


def _majority(rle: DataFrame, shape: tuple[int, int], out: tuple[int, int], tie_is_land: bool) -> DataFrame:
    (h_in, w_in), (h, w) = shape, out
    j0, j1 = _bin_of(F.col("c0"), w_in, w), _bin_of(F.col("c1"), w_in, w)
    d = rle.select("mask_id", "r", "c0", "c1", F.explode(F.sequence(j0, j1)).alias("j"))
    left, right = _edge(F.col("j"), w_in, w), _edge(F.col("j") + 1, w_in, w)
    inside = F.least(F.col("c1"), right - 1) - F.greatest(F.col("c0"), left) + 1
    i = _bin_of(F.col("r"), h_in, h)
    agg = d.groupBy("mask_id", i.alias("i"), "j").agg(F.sum(inside).alias("n"))
    rows = _edge(F.col("i") + 1, h_in, h) - _edge(F.col("i"), h_in, h)
    size = rows * (right - left)
    land = 2 * F.col("n") >= size if tie_is_land else 2 * F.col("n") > size
    return agg.where(land).select("mask_id", F.col("i").alias("r"), F.col("j").alias("c"), F.lit(True).alias("land"))


def resample_mask(rle: DataFrame, shape: tuple[int, int], out: tuple[int, int]) -> DataFrame:
    """Runs at another size: nearest on growing axes, then area majority (a tie is water)."""
    (h_in, w_in), (h, w) = shape, out
    if h > h_in:
        rle, h_in = _nearest_axis(rle, h_in, h, "r"), h
    if w > w_in:
        rle, w_in = _nearest_axis(rle, w_in, w, "c"), w
    if (h_in, w_in) == (h, w):
        return rle
    return to_rle(_majority(rle, (h_in, w_in), out, tie_is_land=False))


def downsample_for_work(rle: DataFrame, shape: tuple[int, int], limit: tuple[int, int]) -> DataFrame:
    """Runs at the working size: block majority (a tie is land) if it divides, else nearest."""
    (h_in, w_in), (h, w) = shape, (min(limit[0], shape[0]), min(limit[1], shape[1]))
    if (h, w) == (h_in, w_in):
        return rle
    if h_in % h == 0 and w_in % w == 0:
        return to_rle(_majority(rle, shape, (h, w), tie_is_land=True))
    return _nearest_axis(_nearest_axis(rle, h_in, h, "r"), w_in, w, "c")


def every_mask(found: DataFrame, masks: DataFrame | None) -> DataFrame:
    """One row for each of ``masks`` (mask_id), where it is given; masks without land have none of their own."""
    return found if masks is None else masks.select("mask_id").distinct().join(found, "mask_id", "left")


def land_fraction(rle: DataFrame, shape: tuple[int, int], masks: DataFrame | None = None) -> DataFrame:
    """Land share per mask, weighted by cos(lat) and not; 0 for a mask without land."""
    h, w = shape
    rows = rle.groupBy("mask_id", "r").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    total = sum(math.cos(math.radians(90.0 - (i + 0.5) * 180.0 / h)) for i in range(h))
    weight = F.cos(F.radians(geo.pixel_lat(F.col("r"), h)))
    found = rows.groupBy("mask_id").agg(
        (F.sum(F.col("n") * weight) / (w * total)).alias("land_fraction"),
        (F.sum("n") / (w * h)).alias("land_fraction_unweighted"),
    )
    return every_mask(found, masks).na.fill(0.0, ["land_fraction", "land_fraction_unweighted"])


def mask_fingerprint(rle: DataFrame, shape: tuple[int, int], masks: DataFrame | None = None) -> DataFrame:
    """Content hash: rows, then bands of rows, then the mask, so that no step holds a whole mask."""
    h, w = shape
    run = F.concat_ws("-", F.col("c0").cast("string"), F.col("c1").cast("string"))
    rows = rle.groupBy("mask_id", "r").agg(F.sort_array(F.collect_list(F.struct("c0", run.alias("t")))).alias("a"))
    row_text = F.concat(F.col("r").cast("string"), F.lit(":"), F.array_join(F.transform("a", lambda x: x["t"]), ","))
    rows = rows.select("mask_id", "r", F.sha2(row_text, 256).alias("h"))
    bands = rows.groupBy("mask_id", F.floor(F.col("r") / ROW_BAND).alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("r", "h"))).alias("a")
    )
    bands = bands.select("mask_id", "band", F.sha2(F.array_join(F.transform("a", lambda x: x["h"]), ""), 256).alias("h"))
    whole = every_mask(bands.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.struct("band", "h"))).alias("a")), masks)
    text = F.concat(F.lit(f"{h}x{w}:"), F.coalesce(F.array_join(F.transform("a", lambda x: x["h"]), ""), F.lit("")))
    return whole.select("mask_id", F.sha2(text, 256).alias("mask_hash"))


# ---- uploads: gray tables (image_id, r, c, gray)

# Luminance weights and the latitude limit of the square Mercator map.
LUMA = (0.299, 0.587, 0.114)
MERCATOR_MAX_LAT = 85.0511


def luminance(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """8-bit gray, transparency over black, rounded half to even."""
    g = (LUMA[0] * red + LUMA[1] * green + LUMA[2] * blue) * (alpha / 255.0)
    return geo.clip(F.rint(g), 0.0, 255.0).cast("int")


def gray_from_16bit(v: Column) -> Column:
    return F.shiftright(v, 8)


def otsu_threshold(gray: DataFrame) -> DataFrame:
    """Gray level with the largest between-class variance per image; the first of equal ones.

    Only the histogram (256 rows an image) goes into the windows. Images of one level give NULL.
    """
    hist = gray.groupBy("image_id", "gray").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id")
    up = w.orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    d = hist.select(
        "image_id",
        "gray",
        F.sum("n").over(up).alias("n0"),
        F.sum(F.col("n") * F.col("gray")).over(up).alias("s0"),
        F.sum("n").over(w).alias("n"),
        F.sum(F.col("n") * F.col("gray")).over(w).alias("s"),
    )
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - F.when(n1 > 0, (F.col("s") - F.col("s0")) / n1)
    var = F.when(n1 > 0, F.col("n0").cast("double") * n1 * gap * gap)
    return d.groupBy("image_id").agg(
        F.max_by("gray", F.when(var.isNotNull(), F.struct(var.alias("v"), -F.col("gray")))).alias("threshold"),
        F.count("*").alias("n_levels"),
    )


def binarise(gray: DataFrame, thresholds: DataFrame, invert: bool = False) -> DataFrame:
    """Land where the gray level is above the image's threshold."""
    d = gray.join(thresholds.select("image_id", "threshold"), "image_id")
    land = F.col("gray") > F.col("threshold")
    return d.select("image_id", "r", "c", (~land if invert else land).alias("land"))


def mercator_to_equirect(gray: DataFrame, n_in: int) -> DataFrame:
    """Square Mercator image to 2:1 plate carree: two small index tables, two equi joins."""
    spark = gray.sparkSession
    w = n_in + n_in % 2
    h = w // 2
    lat = geo.clip(geo.pixel_lat(F.col("id"), h), -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    src_r = geo.clip(F.floor((F.lit(math.pi) - y) / (2 * math.pi) * n_in), 0, n_in - 1).cast("int")
    src_c = F.floor((F.col("id") + 0.5) * n_in / w).cast("int")
    rows = spark.range(h).select(F.col("id").cast("int").alias("out_r"), src_r.alias("r"))
    cols = spark.range(w).select(F.col("id").cast("int").alias("out_c"), src_c.alias("c"))
    d = gray.join(rows, "r").join(cols, "c")
    return d.select("image_id", F.col("out_r").alias("r"), F.col("out_c").alias("c"), "gray")


# ---- polygons: rings (layer_pos, burn, shape_id, ring_no, ring array<struct<x, y>>)


def polygon_edges(rings: DataFrame) -> DataFrame:
    """Edges of closed rings; rings of fewer than three points are dropped."""
    closed = rings.where(F.size("ring") >= 3)
    n = F.size("ring")
    nxt = F.concat(F.slice("ring", F.lit(2), n - 1), F.slice("ring", 1, 1))
    d = closed.select("layer_pos", "burn", "shape_id", "ring_no", F.explode(F.arrays_zip("ring", nxt.alias("nxt"))).alias("e"))
    return d.select(
        "layer_pos", "burn", "shape_id", "ring_no",
        F.col("e.ring.x").alias("x1"), F.col("e.ring.y").alias("y1"),
        F.col("e.nxt.x").alias("x2"), F.col("e.nxt.y").alias("y2"),
    )


def rasterize_polygons(edges: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Runs of land after burning all layers in order (burn 0 carves water).

    Each edge meets the pixel rows whose center it crosses; the crossings of a shape in a row, taken
    in order, bound the covered columns in pairs (even-odd over its rings). A layer is the union of its
    shapes, and the last layer counts.
    """
    h, w = shape
    dy, dx = 180.0 / h, 360.0 / w
    top, low = F.greatest("y1", "y2"), F.least("y1", "y2")
    # rows with low <= center < top
    r0 = F.greatest(F.lit(0), F.floor((90.0 - top) / dy - 0.5 + 1e-12).cast("int") + 1)
    r1 = F.least(F.lit(h - 1), F.floor((90.0 - low) / dy - 0.5 + 1e-12).cast("int"))
    d = edges.where(F.col("y1") != F.col("y2")).withColumn("r0", r0).withColumn("r1", r1).where("r0 <= r1")
    d = d.withColumn("r", F.explode(F.sequence("r0", "r1")))
    lat = geo.pixel_lat(F.col("r"), h)
    x = F.col("x1") + (lat - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    d = d.select("layer_pos", "shape_id", "burn", "r", x.alias("x"))
    wnd = Window.partitionBy("layer_pos", "shape_id", "r").orderBy("x")
    d = d.withColumn("k", F.row_number().over(wnd)).withColumn("x_end", F.lead("x").over(wnd))
    spans = d.where((F.col("k") % 2 == 1) & F.col("x_end").isNotNull())
    c0 = F.greatest(F.lit(0), F.ceil((F.col("x") + 180.0) / dx - 0.5).cast("int"))
    c1 = F.least(F.lit(w - 1), F.ceil((F.col("x_end") + 180.0) / dx - 0.5).cast("int") - 1)
    spans = spans.withColumn("c0", c0).withColumn("c1", c1).where("c0 <= c1")
    return burnt(spans.select("layer_pos", "burn", "r", "c0", "c1"), w).select(F.lit("polygons").alias("mask_id"), "r", "c0", "c1")


def burnt(spans: DataFrame, width: int = 1 << 30) -> DataFrame:
    """Land runs (r, c0, c1) of overlapping spans (layer_pos, burn, r, c0, c1) in ``width`` columns, of which the last layer
    counts (land, if a layer says both).

    A span is cut into nodes of a binary tree over the columns (node 1 is the whole row, node n has the halves 2n and
    2n + 1), at most two a level. Only the last layer of each node of a row is kept, which leaves fewer rows than an image has
    pixels however many layers there are; a stretch between the nodes' ends then has the last layer of the nodes above its first column.
    """
    last = F.col("layer_pos").cast("bigint") * 2 + F.coalesce((F.col("burn") > 0).cast("int"), F.lit(0))
    d = spans.select("r", F.col("c0").cast("bigint").alias("c0"), F.col("c1").cast("bigint").alias("c1"), last.alias("last")).where("last is not null")
    d = d.groupBy("r", "c0", "c1").agg(F.max("last").alias("last"))  # equal spans once
    levels = max(width - 1, 1).bit_length()
    n = 1 << levels
    nodes = []
    for k in range(levels + 1):
        a, b = F.shiftright(F.col("c0") + ((1 << k) - 1), k), F.shiftright(F.col("c1") + 1, k)
        nodes += [F.when((a < b) & (a % 2 == 1), a + (n >> k)), F.when((a < b) & (b % 2 == 1), b - 1 + (n >> k))]
    d = d.select("r", F.explode(F.array(*nodes)).alias("node"), "last").where("node is not null")
    d = d.groupBy("r", "node").agg(F.max("last").alias("last"))
    size = F.expr(f"shiftleft(1L, {levels + 1} - length(bin(node)))")
    first = F.col("node") * size - n
    ends = F.array(F.struct(first.alias("c0"), F.col("last").alias("_own")), F.struct((first + size).alias("c0"), F.lit(None).cast("bigint").alias("_own")))
    cuts = d.select("r", F.explode(ends).alias("e")).groupBy("r", "e.c0").agg(F.max("e._own").alias("_own"))
    cuts = cuts.withColumn("c1", F.lead("c0").over(Window.partitionBy("r").orderBy("c0")) - 1).where("c1 is not null")
    above = F.array(*[F.shiftright(F.col("c0") + n, k) for k in range(levels + 1)])
    top = F.greatest(F.max("last"), F.max("_own"))  # both: the nodes are then made once for both sides of the join
    d = cuts.select("*", F.explode(above).alias("node")).join(d, ["r", "node"]).groupBy("r", "c0", "c1").agg(top.alias("last"))
    return rn.merged(d.where("last % 2 <> 0"), ["r"])
