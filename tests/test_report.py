"""Reports and plans on small cases: order and ties, filters, fairness, prompts that fail, estimates, late points."""

import pandas as pd
from pyspark.sql import functions as F

from cellscore.operators import compare as cp
from cellscore.operators import extract as ex
from cellscore.operators import truth as tr
from cellscore.operators import worklist as wl


def test_leaderboard_is_ordered_by_rank(spark):
    rows = [("c", f"r{i}", rank, acc, tied) for i, (rank, acc, tied) in enumerate([(10, 0.1, False), (2, 0.8, True), (1, 0.9, False), (2, 0.7, True), (4, 0.6, False)])]
    d = spark.createDataFrame(rows, "comparison string, run_id string, rank int, acc_area double, tied boolean")
    assert [r["rank"] for r in d.orderBy(*cp.leaderboard_order()).collect()] == [1, 2, 2, 4, 10]


def test_notes_of_ties(spark):
    ranks = spark.createDataFrame(
        [("c", "a", 1, 1, True), ("c", "b", 2, 1, True), ("c", "d", 3, 1, True), ("c", "e", 4, 4, False), ("x", "b", 1, 1, False)],
        "comparison string, run_id string, pos int, rank int, tied boolean",
    )
    assert sorted(map(tuple, cp.tie_pairs(ranks).collect())) == [("c", "a", "b"), ("c", "a", "d")]
    diffs = spark.createDataFrame([("a", "b", 0.02, -0.01, 0.05, None), ("a", "d", None, None, None, "runs differ in grid or truth")], "run_a string, run_b string, diff double, lo double, hi double, error string")
    runs = spark.createDataFrame([("a", "A"), ("b", "B"), ("d", "D")], "run_id string, label string")
    got = {r.run_id: r for r in cp.tie_notes(ranks, diffs, runs).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"].tie_note.startswith("leads") and got["a"].tie_with is None
    assert (got["b"].tie_with, got["b"].tie_diff, got["b"].tie_lo, got["b"].tie_hi) == ("A", -0.02, -0.05, 0.01)
    assert got["d"].tie_note.endswith("runs differ in grid or truth")


def test_filters_of_the_leaderboard(spark):
    d = spark.createDataFrame(
        [("r1", "One", "v0", "m0", "low", "sample", True, False, 1.0), ("r2", "Two", "v1", "m1", "high", "greedy", False, False, None), ("r3", "Three", "v0", "m0", "high", "sample", None, True, 5.0)],
        "run_id string, label string, vendor string, model_key string, effort string, extraction_mode string, thinking boolean, forced_thinking boolean, cost_usd double",
    )
    ids = lambda **f: {r.run_id for r in cp.leaderboard_filters(d, **f).collect()}
    assert ids() == {"r1", "r2", "r3"} and ids(vendors=["v0"]) == {"r1", "r3"} and ids(thinking=False) == {"r2", "r3"}
    assert ids(efforts=["high"], modes=["sample"]) == {"r3"} and ids(models=[]) == set() and ids(priced=False) == {"r2"}
    assert ids(max_cost=2.0) == {"r1"} and ids(text="TWO") == {"r2"} and ids(forced_thinking=True) == {"r3"}


def test_lineage_and_effort_of_each_comparison(spark):
    rows = [("x", "a", "v", "m", "low", 0.5, "2024"), ("x", "b", "v", "m", "high", 0.7, "2024"), ("y", "a", "v", "m", "low", 0.5, "2024")]
    d = spark.createDataFrame(rows, "comparison string, run_id string, vendor string, model_key string, effort string, acc_area double, release_date string").withColumns({"lo": F.lit(0.1), "hi": F.lit(0.9)})
    assert {(r.comparison, r.run_id) for r in cp.lineage(d).collect()} == {("x", "b"), ("y", "a")}
    assert {(r.comparison, r.effort) for r in cp.effort_curve(d).collect()} == {("x", "low"), ("x", "high")}


def test_fairness_by_name(spark):
    members = spark.createDataFrame([("one", "a"), ("one", "b"), ("two", "a"), ("two", "c")], "comparison string, run_id string")
    runs = spark.createDataFrame(
        [("a", "A", "s0", "sample", "complete", False, False, 10, 10), ("b", "B", "s0", "greedy", "failed", True, True, 10, 10), ("c", "C", "s1", "sample", "complete", False, False, 4, 10)],
        "run_id string, label string, spec_id string, extraction_mode string, status string, thinking boolean, forced_thinking boolean, n_done int, n_total int",
    )
    got = {r.comparison: r for r in cp.comparison_check(members, runs).collect()}
    assert got["one"].refused is None and got["one"].rank_on == "acc_area" and got["one"].n_partial == 1
    assert "not complete: B" in got["one"].warnings and "thinking forced on: B" in got["one"].warnings
    assert got["two"].refused == "runs of several specs: s0, s1" and got["two"].n_partial == 1 and "not complete" not in got["two"].warnings


def test_truth_of_the_own_mask(spark):
    truth = spark.createDataFrame([("a", 0, 1), ("b", 0, 0)], "mask_id string, idx int, truth int")
    points = spark.createDataFrame([("x", "a", 0, None), ("y", "b", 0, None), ("z", "b", 0, 1)], "run_id string, mask_id string, idx int, truth int")
    filled = {r.run_id: r.truth for r in tr.truth_refill(points, truth).collect()}
    assert filled == {"x": 1, "y": 0, "z": 1}
    assert {r.run_id: r.truth for r in tr.truth_refill(points, truth, mask_changed=True).collect()} == {"x": 1, "y": 0, "z": 0}


def test_a_scorer_that_fails(spark):
    """Prompts whose call raises get an error; the others are answered; plain texts are enough."""
    d = spark.createDataFrame([(f"r{i % 2}", i, str(i), "") for i in range(40)], "run_id string, idx int, prompt string, system_prompt string")

    def scorer(prompt: pd.Series, system: pd.Series):
        if (prompt == "7").any():
            raise RuntimeError("no model")
        if (prompt == "8").any():
            return prompt.iloc[:0]
        return "answer " + prompt

    out = {r.idx: r for r in ex.batch_scoring(d, scorer, batch=1).collect()}
    assert len(out) == 40 and out[7].error == "RuntimeError: no model" and out[8].error == "ValueError: 0 answers to 1 prompts"
    assert all(out[i].text == f"answer {i}" and out[i].error is None and out[i].latency_s >= 0 for i in range(40) if i not in (7, 8))


def test_late_points_and_pilots(spark):
    runs = spark.createDataFrame([("a", "complete", "2025-01-02"), ("b", "running", "2025-01-02"), ("c", "complete", None)], "run_id string, status string, ended_at string")
    points = spark.createDataFrame([(k, i, f"2025-01-0{i}") for k in "abc" for i in (1, 2, 3)] + [("a", 3, "2025-01-04")], "run_id string, idx int, updated_at string")
    assert [tuple(r) for r in wl.late_points(points, runs).collect()] == [("points", "a:3", "written after its run was complete")]
    calls = spark.createDataFrame([(1, 10, 2, None), (1, 13, 3, None), (1, 99, 9, "e"), (2, 5, 5, "e")], "position int, input_tokens int, output_tokens int, error string")
    assert [tuple(r) for r in wl.pilot_usage(calls, "position").collect()] == [(1, 12, 2)]
