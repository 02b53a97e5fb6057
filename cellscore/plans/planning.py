"""What is planned against what is stored: hits, references, prices, estimates, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions.common import rounded
from cellscore.functions.documents import canonical, document
from cellscore.operators import compare as cp
from cellscore.operators import points_log as pl
from cellscore.operators import worklist as wl
from cellscore.sources import testbed as tb

BUDGET = 1000.0
RUNS_ENDED = "1998-06-01"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return tb.plan_matrix(spark, sf).select("position", "label", "cell_hash")


def cache_hit(spark, sf):
    return wl.cache_hit(cells(spark, sf), tb.run_log(spark, sf)).select("position", "cached_run_id")


def resumable_run(spark, sf):
    return wl.resumable_run(cells(spark, sf), tb.run_log(spark, sf)).select("position", "resume_run_id", "resume_done")


def duplicate_cells(spark, sf):
    return wl.duplicate_cells(cells(spark, sf)).where(F.col("refused").isNotNull()).select("position", "refused")


def latest_version(spark, sf):
    return wl.latest_version(tb.models(spark, sf), tb.run_log(spark, sf)).select("model_id", "version")


def model_ref_resolve(spark, sf):
    return wl.model_ref_resolve(tb.model_refs(spark, sf), tb.models(spark, sf)).select("k", "ref", "model_id")


def run_prefix_resolve(spark, sf):
    return wl.run_prefix_resolve(tb.asked_runs(spark, sf), tb.run_log(spark, sf))


def price_table(spark, sf):
    return rounded(wl.price_table(*tb.price_rows(spark, sf)))


def price_union(spark, sf):
    """How many entries of each source the lookup goes through, in order of precedence."""
    d = wl.price_table(*tb.price_rows(spark, sf))
    return d.groupBy("precedence", "source").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


def price_lookup(spark, sf):
    d = wl.price_lookup(tb.models(spark, sf), wl.price_table(*tb.price_rows(spark, sf)))
    return rounded(d.select("model_id", "name", "input_per_m", "output_per_m", "batch_discount", "source"))


def resolved_cells(spark: SparkSession, sf: str) -> DataFrame:
    d = tb.plan_matrix(spark, sf)
    mode, refusal = wl.resolve_mode(F.col("requested"), F.col("has_logprobs"), F.col("thinking"))
    d = wl.effective_config(d.withColumn("mode", mode).withColumn("refusal", refusal))
    prices = wl.price_lookup(tb.models(spark, sf), wl.price_table(*tb.price_rows(spark, sf)))
    return d.join(prices.select("model_id", "input_per_m", "output_per_m", "batch_discount"), "model_id")


def effective_config(spark, sf):
    d = tb.plan_matrix(spark, sf)
    mode, refusal = wl.resolve_mode(F.col("requested"), F.col("has_logprobs"), F.col("thinking"))
    d = wl.effective_config(d.withColumn("mode", mode).withColumn("refusal", refusal))
    return rounded(
        d.select("position", "mode", "refusal", "thinking", "temperature", "n_samples", "top_logprobs", "max_output_tokens")
    )


def stored_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Mean tokens per point of stored runs with ten points or more, from the points table that each run's answers are in."""
    use = pl.usage_per_point(tb.points(spark, sf, "error", "input_tokens", "output_tokens", "thinking_tokens"))
    use = use.select(F.col("run_id").alias("points_of"), F.col("input_tokens").alias("stored_in"), F.col("output_tokens").alias("stored_out"))
    return tb.run_log(spark, sf).where(F.col("n_points_done") >= 10).select("run_id", "points_of").join(use, "points_of")


def _plan(spark, sf):
    prompt = wl.sample_prompt(F.col("template"), F.col("coord_format"))
    cells = resolved_cells(spark, sf).join(tb.specs(spark).withColumn("prompt", prompt), "spec_id")  # once a spec
    pilots = wl.pilot_usage(tb.responses(spark, sf), "run_id").withColumnRenamed("run_id", "pilot_of")
    pilots = cells.select("position", "pilot_of").join(pilots, "pilot_of")
    return wl.work_plan(cells, tb.run_log(spark, sf), stored_usage(spark, sf), tb.N_CELLS, pilots)


def work_plan(spark, sf):
    return rounded(
        _plan(spark, sf).select(
            "position", "mode", "refused", "cached_run_id", "resume_run_id", "n_points", "n_calls", "est_source", "est_in", "est_out", "est_cost_usd"
        )
    )


def work_plan_total(spark, sf):
    return rounded(wl.work_plan_total(_plan(spark, sf), BUDGET), 4)


def metrics_freshness(spark, sf):
    """Metrics rows kept for the runs of the attempt log, one per order."""
    o, k = tb.table(spark, sf, "orders"), F.col("o_orderkey")
    now = tb.attempts(spark, sf).groupBy("run_id").agg(F.countDistinct("idx").alias("n_now"))
    m = o.select(
        F.concat(F.lit("r"), (k % 8).cast("string")).alias("run_id"),
        k.alias("metrics_id"),
        F.concat(F.lit("mask"), (F.col("o_custkey") % 3).cast("string")).alias("mask_hash"),
        (0.4 + F.col("o_custkey") % 2 / 10).alias("threshold"),
        F.col("o_orderdate").alias("computed_at"),
    ).join(now, "run_id")
    stale = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    pr = o.select(k.alias("metrics_id"), stale.alias("stale"))
    m = m.join(pr, "metrics_id").withColumn("n_points", F.col("n_now") - F.col("stale").cast("int"))
    return wl.metrics_freshness(m, now, "mask1", 0.5)


def spec_document(coord_format, template, odd, name, path):
    """The same spec as two writers put it: other orders, numbers, names and places of the mask."""
    grid, mask = {"placement": F.lit("center")}, {"source": F.lit("rle"), "truth_rule": F.lit("cell_center")}
    one = document({"grid": document(step_deg=F.lit(int(tb.STEP)), **grid), "mask": document(path=path, **mask)}, id=name, template=template, coord_format=coord_format)
    two = document({"mask": document(**mask), "grid": document(**grid, step_deg=F.lit(tb.STEP))}, coord_format=coord_format, template=template, name=name)
    return F.when(odd, one).otherwise(two)


def spec_key(spark, sf):
    """Key of the spec of every place: equal content has one key, whoever wrote it."""
    d = tb.places(spark, sf).join(tb.specs(spark), "spec_id")
    k = F.col("place_id")
    doc = spec_document(F.col("coord_format"), F.col("template"), k % 2 == 1, k, F.concat(F.lit("/masks/"), k.cast("string")))
    mask = F.md5(F.concat(F.lit("mask"), (k % 3).cast("string")))
    return d.select("place_id", wl.spec_key(doc, mask).alias("spec_key"))


def run_key(spark, sf):
    """Runs of the log with the configuration that they were called with; headers carry a credential."""
    specs = tb.specs(spark).select("spec_id", wl.spec_key(spec_document(F.col("coord_format"), F.col("template"), F.lit(True), F.col("spec_id"), F.lit("/m")), F.lit("mask")).alias("spec"))
    r = tb.run_log(spark, sf).join(specs, "spec_id", "left").join(tb.models(spark, sf).select("model_id", "provider", "name", "quant"), "model_id", "left")
    headers = document(Authorization=F.lit("Bearer x"), trace=F.lit("t"))
    config = document({"headers": headers}, temperature=F.lit(1), rpm=F.col("n_points_done"), n_samples=F.col("repeat_idx") + 1, effort=F.lit(None).cast("string"))
    key = wl.run_key(F.col("spec"), F.col("provider"), F.coalesce("name", "model_id"), F.col("quant"), F.col("resolved_version"), config, F.col("extraction_mode"), F.col("repeat_idx"))
    return r.select("run_id", key.alias("run_key"))


def config_key(spark, sf):
    """Key of the effective configuration of each planned cell."""
    d = resolved_cells(spark, sf)
    names = ("effort", "temperature", "n_samples", "top_logprobs", "max_output_tokens", "system_prompt")
    doc = document(**{n: F.col(n) for n in names}, rpm=F.col("k"), api_key=F.lit("x"))
    return d.select("position", wl.config_key(doc).alias("config_key"))


def scrub_config(spark, sf):
    """Stored configurations, with credentials at several depths taken out."""
    c = tb.table(spark, sf, "customer")
    nation = F.col("c_nationkey")
    auth = F.concat(F.lit("["), document(password=F.lit("p"), user=F.lit("u")), F.lit("]"))
    provider = document({"auth": auth}, client_Secret_2=F.lit("y"), name=F.concat(F.lit("p"), (nation % 7).cast("string")))
    doc = document({"provider": provider}, API_KEY=F.lit("x"), segment=F.col("c_mktsegment"), nation=nation)
    return c.select("c_custkey", canonical(doc).alias("config"))


def variant_parts(spark, sf):
    """Variant names made from the set fields in key order, and taken apart again."""
    d = tb.plan_matrix(spark, sf)
    part = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.col(n).cast("string")))
    opts = F.array_join(F.array_compact(F.array(part("effort"), part("n_samples"), part("temperature"))), ",")
    name = F.when(opts == "", F.col("model_id")).otherwise(F.concat_ws("@", "model_id", opts))
    d = cp.with_variant(d.withColumn("variant", name).drop("effort", "label"))
    temp = F.try_element_at("config", F.lit("temperature"))
    return d.select("position", "variant", "model_key", "effort", temp.alias("temperature_text"), "label")


def run_filters(spark, sf):
    m = tb.models(spark, sf)
    r = tb.run_log(spark, sf).join(m.select("model_id", "store_id"), "model_id").drop("model_id")
    d = wl.run_filters(r, m, status="complete", model="p3/m17")
    e = wl.run_filters(r, m, spec="s1", model="m10")
    return d.select("run_id", "created_at").withColumn("asked", F.lit("complete of p3/m17")).unionByName(
        e.select("run_id", "created_at").withColumn("asked", F.lit("s1 of m10"))
    ).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


def runs_newest(spark, sf):
    d = tb.run_log(spark, sf).orderBy(F.col("created_at").desc(), "run_id")
    return d.select("run_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


def table_checks(spark, sf):
    r = tb.run_log(spark, sf)
    status = ["queued", "running", "paused", "complete", "failed"]
    runs_bad = wl.table_checks(
        r, "runs", "run_id",
        {
            "status": F.col("status").isin(status),
            "cost_usd not null": F.col("cost_usd").isNotNull(),
            "n_points_done": F.col("n_points_done").between(0, 4000),
        },
    )
    c = tb.table(spark, sf, "customer")
    x = F.col("c_acctbal") / 4000
    conf_bad = wl.table_checks(
        c, "configs", "c_custkey",
        {
            "n_samples 1..16": F.col("c_nationkey").between(1, 16),
            "temperature 0..2": x.between(0, 2),
            "repeats 1..100": (F.col("c_custkey") % 120).between(1, 100),
            "step divides 180": F.lit(180) % (F.col("c_nationkey") + 1) == 0,
            "subset 0..1": (((F.col("c_custkey") % 13) / 10) > 0) & (((F.col("c_custkey") % 13) / 10) <= 1),
            "max_output_tokens over 0": F.col("c_custkey") % 40 > 0,
            "truth rule": F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "HOUSEHOLD", "MACHINERY"),
        },
    )
    lost = wl.orphans(r.withColumn("model_id", F.concat(F.lit("m"), (F.length("run_id") + F.col("n_points_done")).cast("string"))),
                      tb.models(spark, sf), "runs", "run_id", "model_id")
    place = tb.places(spark, sf)
    place_bad = wl.table_checks(place, "places", "place_id", {"latitude -90..90": F.col("lat").between(-90, 90), "longitude -180..180": F.col("lon").between(-180, 180)})
    metrics = tb.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 23 / 20).alias("threshold"), (F.col("o_orderkey") % 50 - 1).alias("n_points"))
    metrics_bad = wl.table_checks(metrics, "metrics", "o_orderkey", {"threshold 0..1": F.col("threshold").between(0, 1), "n_points": F.col("n_points") >= 0})
    a = tb.attempts(spark, sf)
    point_bad = wl.table_checks(a.withColumn("key", F.concat_ws(":", "run_id", F.col("idx").cast("string"))).select("key", "p_land", "n_valid", "n_samples").distinct(), "points", "key", {
        "p_land 0..1": F.col("p_land").isNull() | F.col("p_land").between(0, 1), "valid samples": F.col("n_valid") <= F.col("n_samples"), "an answer has samples": F.col("p_land").isNull() | (F.col("n_samples") > 0)})
    late = wl.late_points(a, tb.run_state(spark).withColumn("ended_at", F.to_date(F.lit(RUNS_ENDED))))
    for more in (conf_bad, lost, place_bad, metrics_bad, point_bad, late):
        runs_bad = runs_bad.unionByName(more)
    return runs_bad


QUERIES = {
    "cache_hit": cache_hit,
    "resumable_run": resumable_run,
    "duplicate_cells": duplicate_cells,
    "latest_version": latest_version,
    "model_ref_resolve": model_ref_resolve,
    "run_prefix_resolve": run_prefix_resolve,
    "price_table": price_table,
    "price_union": price_union,
    "price_lookup": price_lookup,
    "effective_config": effective_config,
    "work_plan": work_plan,
    "work_plan_total": work_plan_total,
    "metrics_freshness": metrics_freshness,
    "run_key": run_key,
    "config_key": config_key,
    "spec_key": spec_key,
    "scrub_config": scrub_config,
    "variant_parts": variant_parts,
    "run_filters": run_filters,
    "runs_newest": runs_newest,
    "table_checks": table_checks,
}
