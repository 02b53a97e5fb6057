"""Small cases that the test tables do not have: several masks, masks and runs without land, overlapping shapes."""

import pytest
from pyspark.sql import functions as F

from cellscore.operators import components as cc
from cellscore.operators import truth as tr
from cellscore.sources import masks as mk

H, W = 4, 8


@pytest.fixture
def two_masks(spark):
    """``a`` has the left half as land, ``b`` a single pixel, ``sea`` none."""
    cells = [("a", r, c) for r in range(H) for c in range(4)] + [("b", 0, 7)]
    px = spark.createDataFrame([(m, r, c, True) for m, r, c in cells], "mask_id string, r int, c int, land boolean")
    return mk.to_rle(px), spark.createDataFrame([("a",), ("b",), ("sea",)], "mask_id string")


def test_truth_of_each_mask(spark, two_masks):
    rle, masks = two_masks
    cells = spark.createDataFrame([(0, 67.5, 157.5), (1, -67.5, -157.5)], "idx int, lat double, lon double")
    want = {("a", 0): 0, ("a", 1): 1, ("b", 0): 1, ("b", 1): 0, ("sea", 0): 0, ("sea", 1): 0}
    center = tr.truth_cell_center(cells, rle, (H, W), masks)
    assert {(r.mask_id, r.idx): r.truth for r in center.collect()} == want and center.count() == 6
    small = tr.truth_majority(cells, rle, (H, W), 45.0, masks=masks)
    assert {(r.mask_id, r.idx): r.truth for r in small.collect()} == want and small.count() == 6


def test_a_tie_in_one_mask_is_not_broken_by_another(spark, two_masks):
    rle, _ = two_masks
    cells = spark.createDataFrame([(0, 45.0, 0.0)], "idx int, lat double, lon double")
    got = tr.truth_majority(cells, rle.unionByName(rle.withColumn("mask_id", F.concat("mask_id", F.lit("2")))), (H, W), 90.0)
    assert {r.mask_id: r.truth for r in got.collect()} == {"a": 0, "b": 0, "a2": 0, "b2": 0}


def test_wide_rows_are_matched_across_bands(spark):
    px = spark.createDataFrame([("m", 0, c, True) for c in range(60, 200)], "mask_id string, r int, c int, land boolean")
    cells = spark.createDataFrame([(i, 0.0, -180 + (i + 0.5) * 360 / 256) for i in range(256)], "idx int, lat double, lon double")
    got = {r.idx for r in tr.truth_cell_center(cells, mk.to_rle(px), (1, 256)).where("truth = 1").collect()}
    assert got == set(range(60, 200))


def test_masks_without_land_have_a_share_and_a_hash(spark, two_masks):
    rle, masks = two_masks
    share = {r.mask_id: (round(r.land_fraction, 9), round(r.land_fraction_unweighted, 9)) for r in mk.land_fraction(rle, (H, W), masks).collect()}
    assert share["a"] == (0.5, 0.5) and share["sea"] == (0.0, 0.0) and share["b"][1] == round(1 / 32, 9)
    hashes = {r.mask_id: r.mask_hash for r in mk.mask_fingerprint(rle, (H, W), masks).collect()}
    assert len(set(hashes.values())) == 3 and None not in hashes.values()


def test_overlapping_shapes_of_a_layer_are_united(spark):
    def box(x0, x1):
        return [(x0, -90.0), (x1, -90.0), (x1, 90.0), (x0, 90.0)]

    rows = [(0, 1, 0, 0, box(-180.0, 0.0)), (0, 1, 1, 0, box(-90.0, 90.0)), (1, 0, 2, 0, box(45.0, 90.0)), (1, 0, 3, 0, box(45.0, 90.0))]
    d = spark.createDataFrame(rows, "layer_pos int, burn int, shape_id int, ring_no int, ring array<struct<x:double,y:double>>")
    got = {(x.r, x.c) for x in mk.from_rle(mk.rasterize_polygons(mk.polygon_edges(d), (H, W))).collect()}
    assert got == {(r, c) for r in range(H) for c in range(5)}


def test_runs_without_predicted_land_count_zero(spark):
    rle = spark.createDataFrame([("x", 0, 0, 2), ("x", 2, 5, 5)], "run_id string, r int, c0 int, c1 int")
    truth = cc.label_components(rle.drop("run_id").where("r = 0"), [], W)
    runs = spark.createDataFrame([("x",), ("none",)], "run_id string")
    stats = cc.component_stats(cc.label_components(rle, ["run_id"], W), truth, (H, W), 1.0, runs)
    assert {r.run_id: (r.n_components, r.n_components_large, r.spurious_specks, r.largest_km2 > 0) for r in stats.collect()} == {"x": (2, 2, 1, True), "none": (0, 0, 0, False)}


def test_every_run_of_a_large_comparison_is_paired(spark):
    from cellscore.operators import compare as cp

    ranked = spark.createDataFrame([("x", f"r{i}", i) for i in range(1, 21)], "comparison string, run_id string, pos int")
    pairs = {(r.run_a, r.run_b) for r in cp.report_pairs(ranked).collect()}
    assert pairs == {("r1", f"r{i}") for i in range(2, 21)} | {(f"r{i}", f"r{i + 1}") for i in range(1, 20)}
    assert cp.top_pairs(ranked).count() == 120


def test_retry_after_in_every_form(spark):
    from cellscore.operators import extract as ex

    rows = [
        ("12.5", None, 12.5), ("-3", None, 0.0), ("Tue, 03 Mar 2026 10:00:30 GMT", None, 30.0), ("Tue, 3 Mar 2026 12:00:10 +0200", None, 10.0), ("Tuesday, 03-Mar-26 10:01:00 GMT", None, 60.0),
        ("Tue Mar  3 10:00:05 2026", None, 5.0), ("Tue, 03 Mar 2026 09:00:00 GMT", None, 0.0), ("soon", "1500", 1.5), (None, None, None),
    ]
    d = spark.createDataFrame(rows, "h string, ms string, want double")
    got = d.select("h", "want", ex.retry_after_s(F.col("h"), F.col("ms"), F.lit("2026-03-03 10:00:00").cast("timestamp")).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []
