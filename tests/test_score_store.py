"""Stored block states: only changed runs are scored again, and the result is that of scoring everything."""

import random

from pyspark.sql import functions as F

from cellscore.operators import score as sc
from cellscore.operators import uncertainty as un
from cellscore.operators.score_store import ScoreStore

SCHEMA = "run_id string, idx int, lat double, lon double, weight double, truth int, p_land double"


def points(spark, seed, runs=("a", "b", "c"), n=80):
    r = random.Random(seed)
    rows = []
    for k in runs:
        for i in range(n):
            rows.append((k, i, r.uniform(-90, 90), r.uniform(-180, 180), None if i % 9 == 0 else r.random(), r.choice((0, 1, None)), None if i % 7 == 0 else r.random()))
    return spark.createDataFrame(rows, SCHEMA)


def whole(points, threshold):
    f = sc.point_flags(points, threshold)
    names = ["acc_area", "skill", "f1", "brier", "n_points"]
    a = {r.run_id: [r[n] for n in names] for r in sc.metrics_by(f, ["run_id"], names).collect()}
    b = {r.run_id: [r.est, r.lo, r.hi] for r in un.block_bootstrap_ci(f, n_boot=60).collect()}
    return {k: a[k] + b[k] for k in a}


def stored(store, threshold):
    names = ["acc_area", "skill", "f1", "brier", "n_points"]
    a = {r.run_id: [r[n] for n in names] for r in store.scores(names).where(F.col("threshold") == threshold).collect()}
    b = {r.run_id: [r.est, r.lo, r.hi] for r in store.intervals("acc_area", n_boot=60).where(F.col("threshold") == threshold).collect()}
    return {k: a[k] + b[k] for k in a}


def same(x, y):
    assert x.keys() == y.keys()
    for k in x:
        assert all(p == q or abs(p - q) < 1e-12 for p, q in zip(x[k], y[k])), (k, x[k], y[k])


def test_only_changed_runs_are_scored_again(spark, tmp_path):
    one = points(spark, 1)
    store = ScoreStore(spark, str(tmp_path / "s"), (0.5, 0.7), buckets=3)
    assert {r[0] for r in store.refresh(one).collect()} == {"a", "b", "c"}
    same(stored(store, 0.7), whole(one, 0.7))
    assert store.refresh(one).collect() == []

    two = one.where("run_id <> 'b'").unionByName(points(spark, 2, ("b", "d")))  # other answers for b, and a new run
    two = two.unionByName(spark.createDataFrame([("c", 500, 1.0, 2.0, 1.0, 1, 0.9)], SCHEMA))
    seen = []
    plain = store.block_states
    store.block_states = lambda p: (seen.append({r[0] for r in p.select("run_id").distinct().collect()}), plain(p))[1]
    assert {r[0] for r in store.refresh(two).collect()} == {"b", "c", "d"} and seen == [{"b", "c", "d"}]
    for t in (0.5, 0.7):
        same(stored(store, t), whole(two, t))
    again = ScoreStore(spark, str(tmp_path / "s"), (0.5, 0.7), buckets=3)
    assert again.refresh(two).collect() == []
    same(stored(again, 0.5), whole(two, 0.5))


def test_any_ratio(spark, tmp_path):
    own = {"mean_p": (F.when(F.col("valid"), F.col("p_land") * F.col("w")).otherwise(0.0), F.when(F.col("valid"), F.col("w")).otherwise(0.0))}
    d = points(spark, 3)
    store = ScoreStore(spark, str(tmp_path / "s"), statistics=own)
    store.refresh(d)
    f = sc.point_flags(d).where("valid").groupBy("run_id").agg((F.sum(F.col("p_land") * F.col("w")) / F.sum("w")).alias("m"))
    want = {r.run_id: r.m for r in f.collect()}
    assert all(abs(r.est - want[r.run_id]) < 1e-12 and r.lo <= r.est <= r.hi for r in store.intervals("mean_p", n_boot=100).collect())
