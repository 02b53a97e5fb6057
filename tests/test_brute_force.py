"""Scalable forms against plain loops on small random inputs, and identities of the scores."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions.common import exact_quantiles
from cellscore.operators import components as cc
from cellscore.operators import raster as ra
from cellscore.operators import score as sc
from cellscore.operators import truth as tr
from cellscore.operators import uncertainty as un
from cellscore.sources import grid as gr
from cellscore.sources import masks as mk

H, W = 12, 24


def random_mask(seed, share=0.4):
    rng = np.random.default_rng(seed)
    return rng.random((H, W)) < share


def pixels(spark, m, **extra):
    rows = [("m", r, c, bool(m[r, c])) for r in range(m.shape[0]) for c in range(m.shape[1])]
    return spark.createDataFrame(rows, "mask_id string, r int, c int, land boolean")


def test_distance_is_exact_and_periodic(spark):
    t = random_mask(1, 0.05)
    px = pixels(spark, t)
    got = ra.nearest_distance(px, px.where("land"), ["mask_id"], (H, W), 15.0, 15.0).collect()
    assert len(got) == H * W
    tr_, tc = np.nonzero(t)
    for g in got:
        dc = np.abs(tc - g.c)
        want = 15.0 * np.sqrt(((tr_ - g.r) ** 2 + np.minimum(dc, W - dc) ** 2).min())
        assert abs(g.distance - want) < 1e-9
    none = ra.nearest_distance(px, px.where("false"), ["mask_id"], (H, W), 1.0, 1.0)
    assert none.where("distance is not null").count() == 0


def test_boundary(spark):
    m = random_mask(2)
    got = {(r.r, r.c) for r in ra.boundary_cells(pixels(spark, m), ["mask_id"], "land", W).collect()}
    want = set()
    for r in range(H):
        for c in range(W):
            for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                if 0 <= r + dr < H and m[r, c] != m[r + dr, (c + dc) % W]:
                    want.add((r, c))
    assert got == want


def test_components_join_the_seam(spark):
    for seed in (3, 4):
        m = random_mask(seed, 0.45)
        got = cc.label_components(mk.to_rle(pixels(spark, m)), ["mask_id"], W)
        by_pixel = {(p.r, p.c): p.label for p in mk.from_rle(got).collect()}
        seen, parts = set(), []
        for start in zip(*np.nonzero(m)):
            start = (int(start[0]), int(start[1]))
            if start in seen:
                continue
            stack, part = [start], set()
            while stack:
                r, c = stack.pop()
                if (r, c) in part or not (0 <= r < H) or not m[r, c]:
                    continue
                part.add((r, c))
                stack += [(r + a, (c + b) % W) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            seen |= part
            parts.append(part)
        assert len({*by_pixel.values()}) == len(parts)
        assert all(len({by_pixel[p] for p in part}) == 1 for part in parts)


def test_majority_truth(spark):
    m = random_mask(5)  # 15 degree pixels
    rle = mk.to_rle(pixels(spark, m))
    for step, place in ((30.0, geo.CELL_CENTER), (22.5, geo.CELL_CENTER), (22.5, geo.CELL_CORNER), (5.0, geo.CELL_CENTER)):
        cells = gr.full_grid(spark, step, place)
        b = geo.cell_bounds(F.col("lat"), F.col("lon"), step, place)
        for row in tr.truth_majority(cells, rle, (H, W), step, place).withColumns(b).collect():
            votes = []
            for r in range(H):
                la = 90 - (r + 0.5) * 15
                for c in range(W):
                    lo = -180 + (c + 0.5) * 15
                    if row.south - 1e-9 <= la <= row.north + 1e-9 and any(
                        row.west - 1e-9 <= lo + k <= row.east + 1e-9 for k in (-360, 0, 360)
                    ):
                        votes.append(m[r, c])
            if votes:
                want = int(2 * sum(votes) > len(votes))
            else:
                r = min(max(math.floor((90 - (row.south + row.north) / 2) / 15 + 1e-9), 0), H - 1)
                want = int(m[r, math.floor(((row.west + row.east) / 2 + 180) / 15 + 1e-9) % W])
            assert row.truth == want, (step, place, row)


def test_exact_quantiles(spark):
    rnd = random.Random(0)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(5000)] + [("b", float(rnd.randint(0, 3))) for _ in range(3000)] + [("c", 7.5)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(d, ["k"], "v", {"lo": 0.0, "mid": 0.5, "p95": 0.95, "hi": 1.0}).collect()}
    for k in "abc":
        v = np.array([x for g, x in rows if g == k])
        for name, q in (("lo", 0), ("mid", 50), ("p95", 95), ("hi", 100)):
            assert abs(got[k][name] - np.percentile(v, q)) < 1e-12


def make_points(spark, p_of):
    d = gr.full_grid(spark, 10.0)
    t = ((F.abs("lat") < 40) & (F.col("lon") > -60)).cast("int")
    d = d.withColumn("truth", t).withColumn("run_id", F.lit("a"))
    return d.withColumn("p_land", p_of(F.col("truth")))


def test_score_identities(spark):
    perfect = sc.point_flags(make_points(spark, lambda t: t.cast("double")))
    m = sc.metrics_by(perfect, ["run_id"], ["acc_area", "skill", "f1", "brier"]).first()
    assert (m.acc_area, m.skill, m.f1, m.brier) == (1.0, 1.0, 1.0, 0.0)
    water = sc.metrics_by(sc.point_flags(make_points(spark, lambda t: F.lit(0.0))), ["run_id"], ["acc_area", "baseline_area", "skill"]).first()
    assert abs(water.acc_area - water.baseline_area) < 1e-12 and abs(water.skill) < 1e-12
    sure = sc.point_flags(make_points(spark, lambda t: F.when(t == 1, 0.9).otherwise(0.1)))
    b = sc.metrics_by(sure, ["run_id"], ["brier", "log_loss"]).first()
    assert abs(b.brier - 0.01) < 1e-12 and abs(b.log_loss + math.log(0.9)) < 1e-12
    assert abs(sc.expected_calibration_error(sc.calibration_bins(sure)).first().ece - 0.1) < 1e-12
    codes = spark.createDataFrame(
        [("a", 0.0, 1.0, 1, 0.9), ("a", 0.0, 1.0, 0, 0.9), ("a", 0.0, 1.0, 1, 0.1), ("a", 0.0, 1.0, 1, None), ("a", 0.0, 1.0, 1, float("nan"))],
        "run_id string, lat double, weight double, truth int, p_land double",
    )
    got = [r[0] for r in sc.point_flags(codes).select(sc.error_class()).collect()]
    assert got == [0, 1, 2, 3, 3]


def test_bootstrap_of_a_constant_has_no_width(spark):
    f = sc.point_flags(make_points(spark, lambda t: t.cast("double")))
    r = un.block_bootstrap_ci(f, n_boot=50).first()
    assert (r.est, r.lo, r.hi) == (1.0, 1.0, 1.0)


def test_ranks_follow_long_tie_groups(spark):
    """Groups longer than the first reach: the leader is compared further until its group ends."""
    acc = [round(0.9 - 0.01 * i, 2) for i in range(12)] + [None]
    scores = spark.createDataFrame([("c", f"r{i:02d}", a) for i, a in enumerate(acc)], "comparison string, run_id string, acc_area double")

    def compare(pairs):
        s = scores.select("run_id", "acc_area")
        a = s.withColumnsRenamed({"run_id": "run_a", "acc_area": "x"})
        b = s.withColumnsRenamed({"run_id": "run_b", "acc_area": "y"})
        d = pairs.join(a, "run_a").join(b, "run_b")
        return d.select("run_a", "run_b", (F.col("x") - F.col("y") > 0.045).alias("significant"), F.lit(None).cast("string").alias("error"))

    got = [(r["rank"], r.tied) for r in un.rank_with_ties(scores, compare, reach=2).orderBy("pos").collect()]
    assert got == [(1, True)] * 5 + [(6, True)] * 5 + [(11, True)] * 2 + [(13, False)]
