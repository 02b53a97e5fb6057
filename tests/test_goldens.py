"""Values worked out by hand from the rules: coordinates, answers, tokens, regions, prices, bursts, resampling, polygons."""

import math

import pytest
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions import text as tx
from cellscore.operators import compare as cp
from cellscore.operators import extract as ex
from cellscore.operators import points_log as pl
from cellscore.operators import worklist as wl
from cellscore.sources import grid as gr
from cellscore.sources import masks as mk


def said(spark, rows, f):
    """The rows (text, wanted value) for which ``f`` gives something else."""
    d = spark.createDataFrame(rows, "t string, want string").select("t", "want", f(F.col("t")).alias("got"))
    return [tuple(r) for r in d.collect() if r.got != r.want]


def test_regions(spark):
    places = [
        (52.5, 13.5, 1, "Europe"), (51.0, -110.5, 1, "North America"), (-33.5, -64.5, 1, "South America"), (9.5, 8.5, 1, "Africa"),
        (22.5, 79.5, 1, "Asia"), (-31.5, 121.5, 1, "Oceania"), (-77.5, 100.5, 1, "Antarctica"), (31.5, -55.5, 0, "Atlantic Ocean"),
        (-11.5, -120.5, 0, "Pacific Ocean"), (-28.5, 90.5, 0, "Indian Ocean"), (34.5, 25.5, 0, "Mediterranean & Black Sea"), (-62.5, 150.5, 0, "Southern Ocean"),
        (84.5, -150.5, 0, "Arctic"), (51.0, -110.5, None, "Unknown"),
    ]
    d = spark.createDataFrame(places, "lat double, lon double, truth int, want string")
    assert geo.with_region(d).where("region <> want").collect() == []


@pytest.mark.parametrize(("step", "rows", "cols"), [(6, 30, 60), (9, 20, 40), (12, 15, 30)])
def test_grid_dims(step, rows, cols):
    assert geo.grid_dims(step) == (rows, cols)


def test_grid_dims_must_divide():
    with pytest.raises(ValueError):
        geo.grid_dims(11)


def test_first_cell_and_its_bounds(spark):
    d = gr.full_grid(spark, 6.0).where("idx = 0")
    assert tuple(d.select("lat", "lon").first()) == (87.0, -177.0)
    assert tuple(d.select(*geo.cell_bounds(F.col("lat"), F.col("lon"), 6.0).values()).first()) == (-180.0, 84.0, -174.0, 90.0)


def test_block_ids(spark):
    d = spark.createDataFrame([(85.0, -171.0, 0), (75.0, -169.0, 37), (-85.0, 175.0, 647)], "lat double, lon double, want int")
    assert [r.want - r.got for r in d.select("want", geo.block_id(F.col("lat"), F.col("lon")).alias("got")).collect()] == [0, 0, 0]


def test_coordinates(spark):
    rows = [
        (33.25, -70.0, "hemisphere", "33.25° N, 70° W"), (-7.0001, 0.00004, "hemisphere", "7.0001° S, 0°"), (0.0, -180.0, "hemisphere", "0°, 180°"), (45.1, 359.0, "hemisphere", "45.1° N, 1° W"),
        (-0.00001, 7.0, "signed_decimal", "0.0, 7.0"), (-61.5, -181.25, "signed_decimal", "-61.5, 178.75"), (0.00015625, 3.14159265, "signed_decimal", "0.0002, 3.1416"),
        (-20.51, 0.0, "dms", "20°30'36\" S, 0°00'00\""), (59.99999, 179.99999, "dms", "60°00'00\" N, 180°00'00\""), (-90.5, 1.0, "hemisphere", None),
    ]
    d = spark.createDataFrame(rows, "lat double, lon double, f string, want string")
    got = d.select("lat", "want", tx.coordinate(F.col("lat"), F.col("lon"), F.col("f")).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


def test_formats_of_places(spark):
    rows = [
        ("{lat:.0f}/{lon:.0f}", 88.5, 2.5, "88/2"), ("{lat:.2f} {lon:.1f}", 0.125, -0.25, "0.12 -0.2"), ("{lat:+.2f},{lon:+.1f}", 7.0, -7.0, "+7.00,-7.0"), ("{lat:08.3f}|{lon:7.1f}", -1.5, 33.0, "-001.500|   33.0"),
        ("{lat} {lon} {other}", 1.5, 2.0, "1.5 2.0 {other}"), ("at {coord}, {coord}", 1.0, 2.0, "at 1.0, 2.0, 1.0, 2.0"), ("{lat:.1f} to {lon:.6f}", 9.96, 1.0, "10.0 to 1.000000"),
    ]
    d = spark.createDataFrame(rows, "t string, lat double, lon double, want string")
    got = d.select("t", "want", tx.valid_template(F.col("t")).alias("ok"), tx.render_prompt(F.col("t"), F.col("lat"), F.col("lon"), F.lit("signed_decimal")).alias("got")).collect()
    assert [r for r in got if r.got != r.want or not r.ok] == []
    bad = spark.createDataFrame([("{lat:e} {lon}",), ("{lat!r} {lon}",), ("{lat}",), ("nowhere",), ("{coord} {lon:%}",)], "t string")
    assert not any(r[0] for r in bad.select(tx.valid_template(F.col("t"))).collect())


def test_answers(spark):
    rows = [
        ("water", "water"), ("LAND!!", "land"), ("Land is near", "land"), (" Land", "land"), ("　Water", "water"), (" “land”", "land"), ("\x1cwater\x1fhere", "water"), ("(water) x", "water"),
        ("waterside", None), ("it is water", None), ("land or water", "land"), ("water·land", None), (" ", None), (".", None), (None, None),
        ("<think>first</think>water", "water"), ("<reasoning>land", None), ("</think>　land", "land"), ("<|channel|>final<|message|>water<|end|>", "water"),
    ]
    assert said(spark, rows, tx.parse_answer) == []


def test_tokens(spark):
    rows = [("wat", "water"), ("LAN", "land"), ("▁la", "land"), ("“WATER", "water"), ("land?!", "land"), ("water　", "water"), ("la\n", None), ("wa ", None), ("landing", None), ("w", None), ("", None), (None, None)]
    assert said(spark, rows, tx.token_class) == []


def test_masses_and_samples(spark):
    ln = math.log
    rows = [({"wat": ln(0.5), "LAND": ln(0.25), "?": ln(0.2)}, 1 / 3, 0.75), ({"lan": ln(0.125), "▁land": ln(0.125), "la": ln(0.25)}, 1.0, 0.5), ({"sea": ln(0.9)}, None, 0.0), (None, None, None)]
    a = ex.logprob_answer(F.col("m"))
    d = spark.createDataFrame([(m,) for m, _, _ in rows], "m map<string,double>").select(a["p_land"].alias("p"), a["validity_mass"].alias("mass"))
    for got, (_, p, mass) in zip(d.collect(), rows):
        assert got.p == (p if p is None else pytest.approx(p)) and got.mass == (mass if mass is None else pytest.approx(mass))
    s = ex.sample_answer(F.array(*[F.lit(t) for t in ("water", "perhaps", "land", "water", "water")]))
    assert tuple(spark.range(1).select(s["p_land"], s["n_valid"], s["n_samples"]).first()) == (0.25, 4, 5)


def test_pareto(spark):
    rows = [("x", "dear", 9.0, 0.9), ("x", "cheap", 1.0, 0.6), ("x", "middle", 5.0, 0.6), ("x", "good", 3.0, 0.88), ("y", "only", 2.0, 0.1)]
    d = spark.createDataFrame(rows, "comparison string, run_id string, cost_usd double, acc_area double")
    assert {r.run_id for r in cp.pareto_frontier(d).collect()} == {"cheap", "good", "dear", "only"}


def test_prices(spark):
    default = spark.createDataFrame([("alpha", 8.0, 24.0, 0.25), ("alpha-lite", 1.0, 3.0, 0.25)], "key string, input_per_m double, output_per_m double, batch_discount double")
    rows = [("long", "p", "k", "alpha-lite-v7", None, None), ("short", "p", "k", "maker/alpha-v2", None, None), ("free", "p", "ollama", "anything", None, None), ("unknown", "p", "k", "beta", None, None), ("own", "p", "k", "alpha", 2.5, 7.5)]
    m = spark.createDataFrame(rows, "model_id string, provider string, kind string, name string, own_input double, own_output double")
    got = {r.model_id: (r.input_per_m, r.output_per_m, r.source) for r in wl.price_lookup(m, wl.price_table(default.limit(0), default)).collect()}
    assert got == {"long": (1.0, 3.0, "default"), "short": (8.0, 24.0, "default"), "free": (0.0, 0.0, "local"), "unknown": (None, None, None), "own": (2.5, 7.5, "registry")}
    m = m.withColumn("own_discount", F.when(F.col("model_id") == "own", 0.75))
    assert {r.model_id: r.batch_discount for r in wl.price_lookup(m, wl.price_table(default.limit(0), default)).collect()}["own"] == 0.75
    d = spark.createDataFrame([(8.0, 24.0, 0.25)], "input_per_m double, output_per_m double, batch_discount double")
    assert tuple(d.select(wl.usage_cost(F.lit(5e5), F.lit(2.5e5), F.lit(False)), wl.usage_cost(F.lit(5e5), F.lit(2.5e5), F.lit(True))).first()) == (10.0, 2.5)


@pytest.mark.parametrize(
    ("calls", "threshold", "window", "opened"),
    [([(1, False), (3, False), (9, False), (10, False)], 2, 5.0, [3.0, 10.0]), ([(0, False), (1, True), (2, False)], 2, 60.0, []), ([(0, False), (20, False), (40, False)], 2, 15.0, [])],
)
def test_bursts(spark, calls, threshold, window, opened):
    d = spark.createDataFrame([("r", ok, i, float(t)) for i, (t, ok) in enumerate(calls)], "run_id string, ok boolean, seq int, t double")
    got = [r.opened_at for r in pl.failure_bursts(d.withColumn("ts", F.col("t").cast("timestamp")), threshold, window, slice_s=4).collect()]
    assert got[: len(opened)] == opened[: len(got)] and bool(got) == bool(opened)


def test_resampling(spark):
    def mask(cells):
        return mk.to_rle(spark.createDataFrame([("m", r, c, True) for r, c in cells], "mask_id string, r int, c int, land boolean"))

    def cells(rle):
        return sorted((x.r, x.c) for x in mk.from_rle(rle).collect())

    three_of_four = [(0, 4), (0, 5), (1, 4), (2, 6), (3, 7), (2, 0)]
    assert cells(mk.resample_mask(mask(three_of_four), (4, 8), (2, 4))) == [(0, 2)]
    assert cells(mk.resample_mask(mask([(1, 0)]), (2, 4), (4, 8))) == [(2, 0), (2, 1), (3, 0), (3, 1)]


def test_polygon_with_a_hole(spark):
    def box(x0, y0, x1, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]

    rows = [(0, 1, 0, 0, box(-180.0, -90.0, -45.0, 0.0)), (0, 1, 0, 1, box(-135.0, -67.5, -90.0, -22.5)), (1, 0, 1, 0, box(-67.5, -22.5, -45.0, 0.0))]
    d = spark.createDataFrame(rows, "layer_pos int, burn int, shape_id int, ring_no int, ring array<struct<x:double,y:double>>")
    got = {(r.r, r.c) for r in mk.from_rle(mk.rasterize_polygons(mk.polygon_edges(d), (8, 16))).collect()}
    assert got == {(r, c) for r in range(4, 8) for c in range(6)} - {(r, c) for r in (5, 6) for c in (2, 3)} - {(4, 5)}
