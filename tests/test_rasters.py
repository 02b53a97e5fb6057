"""Rasters as runs and tiles against plain loops over pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.operators import components as cc
from cellscore.operators import raster as ra
from cellscore.operators import runs as rn
from cellscore.operators import tiles as ti
from cellscore.sources import masks as mk

RUNS = "run_id string, mask_id string"


def pixels(spark, m, name="m"):
    rows = [(name, int(r), int(c), bool(m[r, c])) for r in range(m.shape[0]) for c in range(m.shape[1])]
    return spark.createDataFrame(rows, "mask_id string, r int, c int, land boolean")


def as_array(runs, shape):
    out = np.zeros(shape, bool)
    for x in runs.collect():
        assert not out[x.r, x.c0 : x.c1 + 1].any()
        out[x.r, x.c0 : x.c1 + 1] = True
    return out


def coast(m, known):
    h, w = m.shape
    out = set()
    for r in range(h):
        for c in range(w):
            for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                y, x = r + dr, (c + dc) % w
                if 0 <= y < h and known[r, c] and known[y, x] and m[r, c] != m[y, x]:
                    out.add((r, c, bool(m[r, c])))
    return out


@pytest.mark.parametrize("shape, share", [((12, 24), 0.4), ((5, 1), 0.5), ((6, 2), 0.5), ((7, 30), 0.9), ((3, 9), 0.0), ((4, 9), 1.0)])
def test_boundaries_of_runs(spark, shape, share):
    rng = np.random.default_rng(2)
    m, known = rng.random(shape) < share, rng.random(shape) < 0.8
    got = rn.pixels(rn.boundary_runs(mk.to_rle(pixels(spark, m)), ["mask_id"], shape)).collect()
    assert {(x.r, x.c, x.value) for x in got} == coast(m, np.ones(shape, bool)) and len(got) == len({(x.r, x.c) for x in got})
    cells = pixels(spark, m).join(pixels(spark, known, "k").select("r", "c", F.col("land").alias("k")), ["r", "c"]).where("k")
    assert {(x.r, x.c, x.land) for x in ra.boundary_cells(cells, ["mask_id"], "land", shape[1]).collect()} == coast(m, known)


@pytest.mark.parametrize("step, shape, place", [(30.0, (33, 77), geo.CELL_CORNER), (30.0, (180, 360), geo.CELL_CENTER), (5.0, (20, 31), geo.CELL_CENTER), (5.0, (50, 70), geo.CELL_CORNER)])
def test_rendering(spark, step, shape, place):
    (h, w), n, off = shape, geo.grid_dims(step), geo.half_cell(place)
    rng = np.random.default_rng(4)
    m, p = rng.random(n) < 0.5, rng.random(n)
    y, x = (np.arange(h) + 0.5) * 180 / h / step - off, (np.arange(w) + 0.5) * 360 / w / step - off
    want = m[np.clip(np.floor(y + 0.5).astype(int), 0, n[0] - 1)][:, np.floor(x + 0.5).astype(int) % n[1]]
    runs = rn.render_runs(mk.to_rle(pixels(spark, m)), ["mask_id"], step, shape, place)
    assert (as_array(runs, shape) == want).all()
    ends = sorted((x.r, x.c0, x.c1) for x in runs.collect())
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(ends, ends[1:]))  # runs that touch are one
    a, b = np.floor(y).astype(int), np.floor(x).astype(int)
    rows = [p[np.clip(a + k, 0, n[0] - 1)] * abs(1 - k - (y - a))[:, None] for k in (0, 1)]
    tall = rows[0] + rows[1]
    image = tall[:, b % n[1]] * (1 - (x - b)) + tall[:, (b + 1) % n[1]] * (x - b)
    grid = spark.createDataFrame([("a", r, c, float(p[r, c])) for r in range(n[0]) for c in range(n[1])], "run_id string, r int, c int, p double")
    got = {x.r: x["values"] for x in ra.render_tiles(grid, ["run_id"], "p", step, shape, place).collect()}
    assert len(got) == h and np.abs(np.array([got[r] for r in range(h)]) - image).max() < 1e-12


def test_similarity_does_not_depend_on_tiles(spark, monkeypatch):
    shape, step = (60, 90), 30.0
    n, rng = geo.grid_dims(step), np.random.default_rng(5)
    p, m = rng.random(n), rng.random(shape) < 0.4
    cells = [(k, r, c, float(p[r, c]) if k == "a" else 0.25) for k in "ab" for r in range(n[0]) for c in range(n[1]) if (r + c) % 5]
    grid = spark.createDataFrame(cells, "run_id string, r int, c int, p double")
    truth = mk.to_rle(pixels(spark, m)).unionByName(mk.to_rle(pixels(spark, ~m, "other")))
    runs = spark.createDataFrame([("a", "m"), ("b", "other")], RUNS)
    image = {k: np.zeros(shape) for k in "ab"}
    for x in ra.render_tiles(grid, ["run_id"], "p", step, shape).collect():
        image[x.run_id][x.r] = x["values"]
    weight = np.cos(np.radians(90 - (np.arange(60) + 0.5) * 3))
    for pixels_of_tile in (1 << 18, 700, 1):
        monkeypatch.setattr(ti, "TILE_PIXELS", pixels_of_tile)
        for x in ti.tile_scores(grid, truth, runs, "p", step, shape).collect():
            y = (m if x.run_id == "a" else ~m).astype(float)
            assert abs(x.ssim - ti.ssim_map(image[x.run_id], y).mean()) < 1e-9
            assert abs(x.prob_rmse - np.sqrt((((image[x.run_id] - y) ** 2).mean(1) * weight).sum() / weight.sum())) < 1e-9
    flat = np.full((9, 9), 0.5)
    assert np.allclose(ti.ssim_map(flat, flat), 1.0) and ti.ssim_map(flat[:3], flat[:3]).size == 0


@pytest.mark.parametrize("h, w, n", [(9, 14, 6), (5, 9, 1), (7, 40, 60), (3, 4000, 500), (1, 1, 1), (6, 3, 2)])
def test_row_pass(h, w, n):
    rng = np.random.default_rng(h)
    t = np.zeros((h, w), bool)
    t[rng.integers(0, h, n), rng.integers(0, w, n)] = True
    g = np.stack([ti.column_distances(np.flatnonzero(t[:, c]), h) if t[:, c].any() else np.full(h, -1) for c in range(w)], axis=1)
    r, c = np.nonzero(rng.random((h, w)) < 0.7)
    tr, tc = np.nonzero(t)
    dc = np.abs(tc[None] - c[:, None])
    want = np.sqrt(((tr[None] - r[:, None]) * 0.7) ** 2 + (np.minimum(dc, w - dc) * 0.3) ** 2).min(1, initial=np.inf)
    assert np.abs(ti.row_distances(g, r, c, 0.7, 0.3) - want).max(initial=0) < 1e-9


def test_row_pass_takes_time_in_proportion():
    import time

    def took(w):
        g = np.random.default_rng(1).integers(0, 500, (16, w))
        r, c = np.nonzero(g >= 0)
        best = 9.0
        for _ in range(3):
            t = time.process_time()
            ti.row_distances(g, r, c, 0.1, 0.1)
            best = min(best, time.process_time() - t)
        return best

    assert took(8000) < 8 * took(2000) + 0.05


def test_overlay_and_overlap(spark):
    shape, rng = (6, 15), np.random.default_rng(7)
    p, m = rng.random(shape) < 0.5, rng.random(shape) < 0.5
    pred = mk.to_rle(pixels(spark, p, "a")).withColumnRenamed("mask_id", "run_id")
    truth = mk.to_rle(pixels(spark, m)).unionByName(mk.to_rle(pixels(spark, ~m, "other")))
    runs = spark.createDataFrame([("a", "m"), ("none", "other"), ("neither", "sea")], RUNS)
    got = {(x.run_id, x.r, x.pixel_class): x.n for x in ra.error_overlay(pred, truth, runs, shape).collect()}
    want = {}
    for name, x, y in (("a", p, m), ("none", p & False, ~m), ("neither", p & False, p & False)):
        for r in range(6):
            for c in range(15):
                k = (name, r, ("water", "false_water", "false_land", "land")[2 * x[r, c] + y[r, c]])
                want[k] = want.get(k, 0) + 1
    assert got == want
    k = np.cos(np.radians(90 - (np.arange(6) + 0.5) * 30))[:, None]
    s = {x.run_id: (x.pixel_iou, x.dice) for x in ra.pixel_overlap(pred, truth, runs, shape).collect()}
    assert s["neither"] == (1.0, 1.0) and s["none"] == (0.0, 0.0)
    assert abs(s["a"][0] - (k * (p & m)).sum() / (k * (p | m)).sum()) < 1e-12 and abs(s["a"][1] - 2 * (k * (p & m)).sum() / ((k * p).sum() + (k * m).sum())) < 1e-12


def test_regions_of_runs(spark):
    for h, w in ((90, 180), (181, 363)):
        land = spark.range(h).select(F.col("id").cast("int").alias("r"), F.lit(0).alias("c0"), F.lit(w - 1).alias("c1"))
        pieces = rn.region_pieces(land, (h, w))
        got = rn.pixels(pieces).select("r", "c", "continent")
        every = land.select("r", F.explode(F.sequence("c0", "c1")).alias("c")).withColumn("lat", geo.pixel_lat(F.col("r"), h)).withColumn("lon", geo.pixel_lon(F.col("c"), w))
        want = geo.with_continent(every).select("r", "c", "continent")
        assert got.count() == h * w and got.exceptAll(want).isEmpty()
    few = rn.region_pieces(land.withColumns({"c0": F.lit(100), "c1": F.lit(140)}), (181, 363))
    assert few.count() < 181 * 30


def test_sums_of_longitudes(spark):
    d = spark.createDataFrame([(0, 9), (5, 5), (0, 359), (350, 359)], "c0 int, c1 int")
    s, k = rn.lon_sums(360)
    for x in d.select("c0", "c1", s.alias("s"), k.alias("k")).collect():
        a = np.radians(-180 + np.arange(x.c0, x.c1 + 1) + 0.5)
        assert abs(x.s - np.sin(a).sum()) < 1e-9 and abs(x.k - np.cos(a).sum()) < 1e-9


def test_burning_many_layers(spark):
    """Overlapping spans of 130 layers, of which the last one counts; carving and land layers mixed."""
    rng = np.random.default_rng(9)
    want, rows = np.zeros((3, 50), bool), []
    for layer in range(130):
        burn = int(rng.integers(0, 2))
        for _ in range(2):
            r, a = int(rng.integers(0, 3)), int(rng.integers(0, 45))
            b = a + int(rng.integers(0, 5))
            rows.append((layer * 3, burn, r, a, b))
            want[r, a : b + 1] = burn > 0
    spans = spark.createDataFrame(rows, "layer_pos int, burn int, r int, c0 int, c1 int")
    assert (as_array(mk.burnt(spans), (3, 50)) == want).all()
    assert mk.burnt(spans.limit(0)).collect() == []


def test_each_run_is_held_against_its_mask(spark):
    shape, rng = (8, 20), np.random.default_rng(3)
    m = rng.random(shape) < 0.5
    pred = mk.to_rle(pixels(spark, m, "a")).withColumnRenamed("mask_id", "run_id")
    pred = pred.unionByName(pred.withColumn("run_id", F.lit("b")))
    truth = mk.to_rle(pixels(spark, m)).unionByName(mk.to_rle(pixels(spark, np.roll(m, 3, 1), "other")))
    runs = spark.createDataFrame([("a", "m"), ("b", "other"), ("c", "sea")], RUNS)
    own = rn.pixels(rn.boundary_runs(pred, ["run_id"], shape)).select("run_id", "r", "c")
    true = rn.pixels(rn.boundary_runs(truth, ["mask_id"], shape)).select("mask_id", "r", "c")
    got = {x.run_id: x for x in ra.boundary_scores(own, true, runs, shape).collect()}
    assert got["a"].boundary_f_2 == 1.0 and got["a"].contour_mean_deg == 0.0
    assert got["b"].contour_mean_deg > 0 and (got["c"].boundary_f_2, got["c"].contour_mean_deg) == (1.0, None)


def test_names_of_landmasses(spark):
    m = np.zeros((90, 180), bool)
    m[20:40, 95:130] = m[50:60, 60:70] = True
    m[30:34, :2] = m[30:34, -2:] = True
    got = cc.landmasses(cc.label_components(mk.to_rle(pixels(spark, m)).drop("mask_id"), [], 180), (90, 180)).collect()
    assert len(got) == 3 and {x.name for x in got} >= {"South America"}
    seam = min(got, key=lambda x: x.area_km2)
    assert abs(abs(seam.centroid_lon) - 180) < 1e-6 and abs(seam.centroid_lat - 26.0) < 1e-9
