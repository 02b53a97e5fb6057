"""Streams that stop and go on, batches that run again, rows that come late."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellscore.operators import points_log as pl
from cellscore.streaming import jobs
from cellscore.streaming.upsert import UpsertTable

CALLS = "run_id string, ts timestamp, ok boolean, seq bigint"


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def added(d):
    return d.groupBy("k").agg(F.sum("n").alias("n"), F.max("t").alias("t"))


def batch(spark, rows):
    return spark.createDataFrame(rows, "k int, n bigint, t bigint")


def test_upsert_and_replay(spark, tmp_path):
    r, want = random.Random(1), {}
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], added, buckets=4)
    assert table.read() is None
    for epoch in range(6):
        rows = [(r.randrange(40), 1, epoch * 10 + r.randrange(10)) for _ in range(r.choice((3, 30)))]
        for k, n, t in rows:
            a, b = want.get(k, (0, -1))
            want[k] = (a + n, max(b, t))
        table.merge(batch(spark, rows), epoch)
        if epoch % 2:
            table.merge(batch(spark, rows), epoch)  # the batch runs again: nothing counts twice
        if epoch == 3:
            table = UpsertTable(spark, str(tmp_path / "t"), ["k"], added, buckets=4)
        assert {x.k: (x.n, x.t) for x in table.read().collect()} == want
    table.merge(batch(spark, []), 6)
    assert {x.k: (x.n, x.t) for x in table.read().collect()} == want


def test_a_batch_that_broke_off_leaves_the_last_state(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], added, buckets=2)
    table.merge(batch(spark, [(1, 1, 1), (2, 1, 1)]), 0)
    added_up = batch(spark, [(1, 5, 5)])
    added_up.withColumn("_b", F.lit(0)).write.partitionBy("_b").parquet(str(tmp_path / "t/data/epoch=1"))  # written, but in no manifest
    assert sorted(map(tuple, table.read().collect())) == [(1, 1, 1), (2, 1, 1)]
    table.merge(added_up, 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, 6, 5), (2, 1, 1)]


def test_reading_does_not_grow_with_the_batches(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], added, buckets=3)
    files = []
    for epoch in range(12):
        table.merge(batch(spark, [(k, 1, epoch) for k in range(50)]), epoch)
        files.append(len(table.read().inputFiles()))
    assert files == [3] * 12 and table.read().where("n <> 12").isEmpty()
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 6  # this version and the one before
    table.merge(batch(spark, [(1, 1, 99)]), 12)
    touched = [f for f in table.read().inputFiles() if "epoch=12" in f]
    assert len(touched) == 1  # one key, one bucket


@pytest.fixture
def brute_bursts(spark):
    def go(rows, threshold, window_s):
        d = spark.createDataFrame(rows, CALLS)
        return {x.run_id: x.opened_at for x in pl.failure_bursts(d, threshold, window_s).collect()}

    return go


def test_bursts_with_late_rows_and_a_restart(spark, tmp_path, brute_bursts):
    """Files hold rows out of order, up to the watermark's delay late; the stream stops after each and goes on."""
    r, start = random.Random(5), pd.Timestamp("2026-01-01")
    rows = []
    for run in ("a", "b", "c", "d"):
        t = 0.0
        for i in range(300):
            t += r.choice((1, 5, 40, 400))
            rows.append((run, start + pd.Timedelta(seconds=t), r.random() < 0.5 if run != "d" else True, len(rows)))
    rows.sort(key=lambda x: x[1] + pd.Timedelta(seconds=r.uniform(0, 100)))
    work, folder = str(tmp_path / "work"), tmp_path / "in"
    for i in range(6):
        part = rows[i * 200 : (i + 1) * 200]
        put(spark, folder, f"f{i}", [(a, b.to_pydatetime(), c, d) for a, b, c, d in part], CALLS)
        got = jobs.failure_bursts(stream(spark, folder, CALLS), work, threshold=4, window_s=60.0, slice_s=3600, late="3 minutes")
        found = {x.run_id: x.opened_at for x in got.collect()}
        assert found == brute_bursts([(a, b.to_pydatetime(), c, d) for a, b, c, d in rows[: (i + 1) * 200]], 4, 60.0), i
    assert set(found) == {"a", "b", "c"}


def test_a_late_success_undoes_a_burst(spark, tmp_path):
    t0 = pd.Timestamp("2026-01-01 10:00:00")

    def at(s):
        return (t0 + pd.Timedelta(seconds=s)).to_pydatetime()

    work, folder = str(tmp_path / "work"), tmp_path / "in"
    put(spark, folder, "f0", [("x", at(s), False, s) for s in (0, 10, 20)], CALLS)
    run = lambda: jobs.failure_bursts(stream(spark, folder, CALLS), work, threshold=3, window_s=60.0).collect()
    assert [x.opened_at for x in run()] == [t0.timestamp() + 20]
    put(spark, folder, "f1", [("x", at(15), True, 9)], CALLS)
    assert run() == []
    put(spark, folder, "f2", [("x", at(s), False, s) for s in (30, 40)], CALLS)
    assert [x.opened_at for x in run()] == [t0.timestamp() + 40]


def test_budget_with_late_rows(spark, tmp_path):
    schema = "comparison string, run_id string, idx int, seq bigint, updated_at timestamp, cost_usd double"
    r, t0 = random.Random(2), pd.Timestamp("2026-01-30")
    rows = [(c, f"r{i % 3}", i, i, (t0 + pd.Timedelta(minutes=37 * i)).to_pydatetime(), None if i % 11 == 0 else 0.25) for c in ("one", "two") for i in range(200 if c == "one" else 60)]
    r.shuffle(rows)
    work, folder = str(tmp_path / "work"), tmp_path / "in"
    for n in range(4):
        put(spark, folder, f"f{n}", rows[n * 65 : (n + 1) * 65], schema)
        got = {x.comparison: (x.run_id, x.idx, x.spent) for x in jobs.budget_guard(stream(spark, folder, schema), work, 8.0).collect()}
        want = {}
        for c in ("one", "two"):
            spent = 0.0
            for x in sorted((x for x in rows[: (n + 1) * 65] if x[0] == c), key=lambda x: x[4]):
                spent += x[5] or 0.0
                if spent >= 8.0:
                    want[c] = (x[1], x[2], spent)
                    break
        assert got == want, n
    assert set(want) == {"one", "two"}


def test_points_and_totals_over_restarts(spark, tmp_path):
    schema = "run_id string, idx int, updated_at timestamp, seq bigint, p_land double, error string, input_tokens int, output_tokens int, cost_usd double"
    r, t0 = random.Random(3), pd.Timestamp("2026-01-01")
    rows = [(f"r{r.randrange(3)}", r.randrange(20), (t0 + pd.Timedelta(seconds=r.randrange(9999))).to_pydatetime(), i, r.random(), None if i % 4 else "e", 5, i % 7, 0.5) for i in range(300)]
    work, folder = tmp_path, tmp_path / "in"
    for n in range(3):
        put(spark, folder, f"f{n}", rows[n * 100 : (n + 1) * 100], schema)
        some = rows[: (n + 1) * 100]
        got = {(x.run_id, x.idx): (x.attempts, x.p_land) for x in jobs.points_upsert(stream(spark, folder, schema), str(work / "p"), ["p_land", "error"]).collect()}
        want = {}
        for x in some:
            want.setdefault(x[:2], []).append((x[2], x[3], x[4]))
        assert got == {k: (len(v), max(v)[2]) for k, v in want.items()}
        totals = {x.run_id: (x.input_tokens, x.output_tokens, x.n_ok, x.n_failed, x.cost_usd) for x in jobs.run_totals(stream(spark, folder, schema), str(work / "t")).collect()}
        for k, v in totals.items():
            own = [x for x in some if x[0] == k]
            assert v == (5 * len(own), sum(x[7] for x in own), sum(x[5] is None for x in own), sum(x[5] is not None for x in own), 0.5 * len(own))
