"""A cross-section of the registered jobs against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "accuracy_leaderboard", "cell_metrics", "threshold_sweep", "region_table", "run_health", "block_bootstrap_ci", "pair_matrix",
    "retry_queue", "budget_cutoff", "points_scan", "truth_majority", "rasterize_polygons", "mask_fingerprint", "coastline_error",
    "landmass_iou", "extract_auto", "response_normalise", "prompt_table", "work_plan", "price_lookup", "stream_points_upsert",
    "stream_rate_usage", "stream_failure_bursts", "stream_run_totals", "stream_budget_guard", "rescored_runs", "mask_source_rle", "boundary_f",
    "pixel_iou_dice", "ssim", "render_bilinear", "error_overlay", "landmass_names", "component_stats", "lineage", "effort_curve", "leaderboard",
    "comparison_check", "run_views", "metrics_export", "batch_scoring", "run_key", "spec_key", "table_checks", "work_plan_total",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "lineitem orders customer part events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def ordered(rows):
    """Rows with their doubles behind the other values, so that the last digits don't decide the order."""
    return sorted((tuple(repr(v) for v in row if not isinstance(v, float)), tuple(v for v in row if isinstance(v, float))) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(tuple(r[c] for c in cols) for r in df.collect())
    sql = entry.oracle_sql()[name]
    heads = [d[0] for d in con.execute("describe " + sql).fetchall()]
    want = ordered(tuple(r[heads.index(c)] for c in cols) for r in con.execute(sql).fetchall())
    assert [x for x, _ in got] == [x for x, _ in want]
    for (_, a), (_, b) in zip(got, want):  # both are rounded: a tie may fall to either side
        assert all(math.isclose(x, y, rel_tol=1e-10, abs_tol=1.5e-6) for x, y in zip(a, b)), (a, b)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 8
