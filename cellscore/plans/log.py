"""The attempt log, the grid and the work that is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions.common import rounded
from cellscore.operators import compare as cp
from cellscore.operators import points_log as pl
from cellscore.operators import score as sc
from cellscore.operators import uncertainty as un
from cellscore.operators import worklist as wl
from cellscore.operators.regions import region_accuracy
from cellscore.plans.masks import SHAPE, mask_rle
from cellscore.plans.scoring import flags, kept_flags, kept_points
from cellscore.session import checkpoint_dir
from cellscore.sources import grid as gr
from cellscore.sources import masks as mk
from cellscore.sources import points as io
from cellscore.sources import testbed as tb

SEED = 0
BUDGET = 0.5
FIT_CHUNK = 100


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"


def all_cells(spark: SparkSession) -> DataFrame:
    return gr.cells_of(tb.runs(spark).select("run_id"), tb.STEP)


def latest_points(spark, sf):
    p = tb.points(spark, sf, "p_land", "error", "attempts")
    return rounded(p.select("run_id", "idx", "attempts", "p_land", "error"))


def points_scan(spark, sf):
    path = _scratch(spark)
    io.export_points(tb.points(spark, sf, *tb.ALL_PAYLOAD), path)
    d = io.read_points(spark, path, runs=["r1", "r4", "r6"])
    return rounded(d.select("run_id", "idx", "lat", "lon", "truth", "p_land", "n_samples", "latency_s")).orderBy("run_id", "idx")


def points_export(spark, sf):
    path = _scratch(spark)
    io.export_points(tb.points(spark, sf, *tb.ALL_PAYLOAD), path, fmt="csv")
    d = io.read_points(spark, path, fmt="csv")
    return rounded(d.select("run_id", "idx", "weight", "truth", "p_land", "finish_reason", "error", "output_tokens"))


def points_append_log(spark, sf):
    log, rejects = _scratch(spark), _scratch(spark)
    a = tb.attempts(spark, sf).select("run_id", "idx", "updated_at", "p_land", "error")
    done = tb.runs(spark).withColumn("status", F.when(F.col("run_id").isin("r2", "r5"), "complete").otherwise("running"))
    io.append_attempts(a, done, log, rejects)
    kept = spark.read.parquet(log).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("table", F.lit("log"))
    refused = spark.read.parquet(rejects).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("table", F.lit("rejects"))
    return kept.unionByName(refused)


def metrics_export(spark, sf):
    """A document of each run: the run, what is kept of its model, its spec and mask, and its metrics at two thresholds."""
    p = kept_points(spark, sf)
    names = ["n_points", "n_valid", "n_unknown_truth", "n_correct"]
    marks = mk.mask_fingerprint(mask_rle(spark, sf), SHAPE, tb.masks(spark))
    last = p.groupBy("run_id").agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd").alias("computed_at"))
    rows = [sc.metrics_by(sc.point_flags(p, t), ["run_id"], names).withColumn("threshold", F.lit(t)) for t in (0.7, 0.5)]
    m = rows[0].unionByName(rows[1]).join(last, "run_id").select("run_id", "computed_at", "threshold", *names)
    runs = cp.with_variant(tb.runs(spark)).join(tb.run_state(spark), "run_id")
    models = runs.select("run_id", F.col("model_key").alias("name"), "provider", "vendor", "forced_thinking")
    specs = runs.select("run_id", "spec_id").join(tb.specs(spark), "spec_id").withColumn("mask_id", F.lit("mask")).join(marks, "mask_id")
    return io.metrics_documents(runs.select("run_id", "variant", "extraction_mode", "repeat_idx", "status"), m, models, specs.select("run_id", "spec_id", "coord_format", "mask_id", "mask_hash"))


def points_sorted(spark, sf):
    return rounded(tb.points(spark, sf).select("run_id", "idx", "p_land")).orderBy("run_id", "idx")


def grid_source(spark, sf):
    """The grid with the number of attempts on every cell."""
    n = tb.attempts(spark, sf).groupBy("idx").agg(F.count("*").alias("n_attempts"))
    d = gr.full_grid(spark, tb.STEP).join(n, "idx", "left").na.fill(0, ["n_attempts"])
    return rounded(d)


def grid_subset(spark, sf):
    cells = gr.grid_subset(gr.full_grid(spark, tb.STEP), 0.1, SEED, tb.N_CELLS).select("idx")
    return rounded(tb.points(spark, sf).join(cells, "idx", "left_semi").select("run_id", "idx", "p_land"))


def visit_order(spark: SparkSession) -> DataFrame:
    return gr.stratified_order(gr.full_grid(spark, tb.STEP), SEED)


def stratified_order(spark, sf):
    n = tb.attempts(spark, sf).groupBy("idx").agg(F.count("*").alias("n_attempts"))
    d = visit_order(spark).join(n, "idx", "left").na.fill(0, ["n_attempts"])
    return d.select("idx", "level", F.col("visit").cast("bigint").alias("visit"), "n_attempts")


def progress_by_prefix(spark, sf):
    """Coverage by the first k visited cells among those that were ever attempted."""
    seen = tb.attempts(spark, sf).select("idx").distinct()
    d = visit_order(spark).join(seen, "idx", "left_semi")
    return pl.progress_by_prefix(d, [1, 4, 10, 40, 400, 4000])


def cell_bounds(spark, sf):
    p = tb.points(spark, sf)
    b = geo.cell_bounds(F.col("lat"), F.col("lon"), tb.STEP)
    return rounded(p.select("run_id", "idx", *[c.alias(n) for n, c in b.items()]))


def cell_index(spark, sf):
    p = tb.points(spark, sf)
    r, c = geo.cell_row(F.col("lat"), tb.STEP), geo.cell_col(F.col("lon"), tb.STEP)
    return p.select("run_id", "idx", r.alias("row"), c.alias("col"))


def block_id(spark, sf):
    p = tb.points(spark, sf)
    return p.select("run_id", "idx", geo.block_id(F.col("lat"), F.col("lon")).alias("block"))


def missing_points(spark, sf):
    d = pl.missing_points(all_cells(spark), tb.points(spark, sf, "error"))
    d = d.join(visit_order(spark).select("idx", "visit"), "idx")
    return d.select("run_id", "idx", F.col("visit").cast("bigint").alias("visit")).orderBy("run_id", "visit")


def failed_points(spark, sf):
    return pl.failed_points(tb.points(spark, sf, "error", "attempts")).select("run_id", "idx", "error", "attempts")


def retry_queue(spark, sf):
    d = pl.retry_queue(all_cells(spark), tb.points(spark, sf, "error"), visit_order(spark))
    return d.select("run_id", "idx", "phase", F.col("visit").cast("bigint").alias("visit")).orderBy("run_id", "phase", "visit")


def points_missing_set(spark, sf):
    p = tb.points(spark, sf, "error")
    left = all_cells(spark).exceptAll(p.select("run_id", "idx"))
    return left.groupBy("run_id").agg(F.count("*").alias("n_missing"))


def run_totals(spark, sf):
    return rounded(pl.run_totals(tb.attempt_costs(spark, sf), tb.points(spark, sf, "error")))


def run_completion(spark, sf):
    p = tb.points(spark, sf, "error")
    seen = p.groupBy("run_id").agg(F.count("*").alias("n_seen"))
    half = F.substring("run_id", 2, 1).cast("int") % 2 == 0
    tot = tb.runs(spark).join(seen, "run_id", "left")
    tot = tot.select("run_id", F.when(half, F.lit(tb.N_CELLS)).otherwise(F.col("n_seen")).cast("bigint").alias("n_total"))
    return pl.run_completion(p, tot, max_failed=0.025)


def usage_per_point(spark, sf):
    return pl.usage_per_point(tb.points(spark, sf, "error", "input_tokens", "output_tokens", "thinking_tokens"))


def cost_usd(spark, sf):
    """Live cost, and what the same calls cost at batch price."""
    d = tb.attempts(spark, sf).join(run_prices(spark, sf), "run_id")
    per = [wl.usage_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(batch)) for batch in (False, True)]
    return rounded(d.groupBy("run_id").agg(F.sum(per[0]).alias("cost_usd"), F.sum(per[1]).alias("batch_cost_usd")))


def run_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of the runs' models by the lookup: the model's own where it has one, else by name."""
    m = cp.with_variant(tb.runs(spark)).join(tb.run_state(spark).select("run_id", "provider"), "run_id")
    m = m.select(F.col("run_id").alias("model_id"), "provider", F.lit("remote").alias("kind"), F.col("model_key").alias("name"), F.col("price_in").alias("own_input"), F.col("price_out").alias("own_output"))
    found = wl.price_lookup(m, wl.price_table(*tb.price_rows(spark, sf)))
    return found.select(F.col("model_id").alias("run_id"), "input_per_m", "output_per_m", "batch_discount")


def budget_cutoff(spark, sf):
    c = tb.attempt_costs(spark, sf).join(tb.comparison_runs(spark), "run_id")
    d = pl.budget_cutoff(c, cap=BUDGET, prior=0.1)
    return rounded(
        d.groupBy("comparison", "run_id").agg(
            F.sum(F.col("kept").cast("bigint")).alias("n_kept"),
            F.sum((~F.col("kept")).cast("bigint")).alias("n_cut"),
            F.sum(F.when(F.col("kept"), F.col("cost_usd"))).alias("spent"),
            F.max(F.col("cost_usd").isNull()).alias("unknown_price"),
        )
    )


def batch_budget_fit(spark, sf):
    p = tb.points(spark, sf, "error")
    todo = pl.missing_points(all_cells(spark), p).groupBy("run_id").agg(F.count("*").alias("n_todo"))
    tot = pl.run_totals(tb.attempt_costs(spark, sf), p)
    d = todo.join(tot, "run_id").select(
        "run_id",
        "n_todo",
        (F.col("cost_usd") / F.col("n_points_done")).alias("est_per_point"),
        (F.col("cost_usd") * 0.1).alias("room"),
    )
    return pl.batch_budget_fit(d, chunk=FIT_CHUNK)


def event_calls(spark: SparkSession, sf: str) -> DataFrame:
    return tb.calls_of(tb.table(spark, sf, "events"))


def failure_bursts(spark, sf):
    return rounded(pl.failure_bursts(event_calls(spark, sf), threshold=3, window_s=7200.0))


def rate_limits(spark: SparkSession) -> DataFrame:
    rows = [("p0", 1, None), ("p0", 3, 120), ("p1", None, 60), ("p1", 2, 130)]
    return spark.createDataFrame(rows, "provider string, rpm int, tpm int")


def rate_usage(spark, sf):
    d = pl.rate_usage(event_calls(spark, sf), rate_limits(spark))
    return d.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


def run_progress(spark, sf):
    runs = tb.runs(spark).withColumn("n_total", F.lit(tb.N_CELLS))
    return rounded(pl.run_progress(tb.points(spark, sf), runs, tb.run_costs(spark, sf)))


def run_views(spark, sf):
    """One wide row per comparison member: run, model, config, metrics, interval, regions, error shares and cost."""
    f = kept_flags(spark, sf)
    ci = un.block_bootstrap_ci(f).select("run_id", "lo", "hi")
    regions = region_accuracy(f).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("position", "region", "acc"))).alias("a"))  # at most one a region
    named = F.transform("a", lambda x: F.concat(x["region"], F.lit(" "), F.format_string("%.4f", x["acc"])))
    regions = regions.select("run_id", F.array_join(named, "; ").alias("regions"))
    m = sc.metrics_by(f, ["run_id"], ["acc_area", "acc_valid_only", "skill", "f1", "invalid_rate", "n_points"])
    d = (
        tb.comparison_runs(spark)
        .join(cp.with_variant(tb.runs(spark)), "run_id")
        .join(m, "run_id", "left")
        .join(sc.error_breakdown(f).drop("n_false_land", "n_false_water", "n_invalid"), "run_id", "left")
        .join(tb.run_costs(spark, sf), "run_id", "left")
        .join(ci, "run_id", "left")
        .join(regions, "run_id", "left")
    )
    d = d.withColumn("config", F.to_json("config")).withColumn("vendor", F.coalesce("vendor", F.lit("unknown")))
    d = d.withColumn("thinking", F.col("thinking") | F.col("forced_thinking"))
    d = d.withColumn("position", F.col("position").cast("int"))
    return rounded(d.drop("price_in", "price_out", "n_samples_set"))


def report_header(spark, sf):
    a = tb.attempt_costs(spark, sf)
    per = a.groupBy("run_id").agg(
        F.min("updated_at").alias("started"), F.max("updated_at").alias("ended"), F.sum("cost_usd").alias("cost_usd")
    )
    d = tb.comparison_runs(spark).join(per, "run_id").join(tb.runs(spark), "run_id").join(tb.run_state(spark), "run_id")
    return rounded(
        d.groupBy("comparison").agg(
            F.date_format(F.min("started"), "yyyy-MM-dd HH:mm").alias("first_start"),
            F.date_format(F.max("ended"), "yyyy-MM-dd HH:mm").alias("last_end"),
            F.sum("cost_usd").alias("total_spend"),
            F.sum(F.col("cost_usd").isNull().cast("bigint")).alias("n_without_price"),
            F.count("*").alias("n_runs"),
            F.array_join(F.sort_array(F.collect_set("extraction_mode")), ", ").alias("modes"),
            F.array_join(F.sort_array(F.collect_set("runner_version")), ", ").alias("runner_versions"),
        )
    )


def comparison_check(spark, sf):
    """Fairness of every comparison: one spec, modes, unfinished and forced-thinking runs, by name."""
    done = tb.points(spark, sf, "error").groupBy("run_id").agg(F.count("*").alias("n_done"))
    d = cp.with_variant(tb.runs(spark)).join(tb.run_state(spark), "run_id").join(done, "run_id", "left").withColumn("n_total", F.lit(tb.N_CELLS))
    return cp.comparison_check(tb.comparison_runs(spark), d)


def comparison_runs(spark, sf):
    n = tb.attempts(spark, sf).groupBy("run_id").agg(F.count("*").alias("n_attempts"))
    d = tb.comparison_runs(spark).join(n, "run_id", "left")
    return d.select("comparison", F.col("position").cast("int").alias("position"), "run_id", "n_attempts")


def modes_union(spark, sf):
    """Distinct extraction modes of the comparisons whose runs have points."""
    have = tb.attempts(spark, sf).select("run_id").distinct()
    d = tb.comparison_runs(spark).join(have, "run_id", "left_semi").join(tb.runs(spark), "run_id")
    return d.select("comparison", "extraction_mode").distinct()


QUERIES = {
    "latest_points": latest_points,
    "points_scan": points_scan,
    "points_export": points_export,
    "points_append_log": points_append_log,
    "metrics_export": metrics_export,
    "points_sorted": points_sorted,
    "grid_source": grid_source,
    "grid_subset": grid_subset,
    "stratified_order": stratified_order,
    "progress_by_prefix": progress_by_prefix,
    "cell_bounds": cell_bounds,
    "cell_index": cell_index,
    "block_id": block_id,
    "missing_points": missing_points,
    "failed_points": failed_points,
    "retry_queue": retry_queue,
    "points_missing_set": points_missing_set,
    "run_totals": run_totals,
    "run_completion": run_completion,
    "usage_per_point": usage_per_point,
    "cost_usd": cost_usd,
    "budget_cutoff": budget_cutoff,
    "batch_budget_fit": batch_budget_fit,
    "failure_bursts": failure_bursts,
    "rate_usage": rate_usage,
    "run_progress": run_progress,
    "run_views": run_views,
    "report_header": report_header,
    "comparison_check": comparison_check,
    "comparison_runs": comparison_runs,
    "modes_union": modes_union,
}
