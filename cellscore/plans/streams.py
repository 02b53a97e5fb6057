"""The streaming jobs run over the test tables up to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions.common import rounded
from cellscore.plans.log import BUDGET, rate_limits
from cellscore.session import checkpoint_dir
from cellscore.sources import testbed as tb
from cellscore.streaming import jobs


def _work(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return tb.attempts_of(jobs.read_table_stream(spark, sf, "lineitem"))


def costed(spark: SparkSession, sf: str) -> DataFrame:
    priced = tb.runs(spark).select("run_id", "price_in", "price_out")
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    return attempts(spark, sf).join(priced, "run_id").withColumn("cost_usd", cost)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    e = jobs.read_table_stream(spark, sf, "events")
    return tb.calls_of(e).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_points_upsert(spark, sf):
    d = jobs.points_upsert(attempts(spark, sf), _work(spark), ["p_land", "error"])
    return rounded(d.select("run_id", "idx", "attempts", "p_land", "error"))


def stream_run_totals(spark, sf):
    return rounded(jobs.run_totals(costed(spark, sf), _work(spark)), 9)  # costs have seven decimals: six would round ties


def stream_rate_usage(spark, sf):
    d = jobs.rate_usage(calls(spark, sf), _work(spark), rate_limits(spark))
    return d.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


def stream_rate_usage_sliding(spark, sf):
    """Minutes that begin every 20 seconds."""
    d = jobs.rate_usage(calls(spark, sf), _work(spark), rate_limits(spark), slide="20 seconds")
    return d.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm:ss"))


def stream_dedupe(spark, sf):
    """Every call is delivered twice."""
    c = calls(spark, sf)
    d = jobs.dedupe(c.unionByName(c), _work(spark), "seq")
    return d.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("seq").alias("sum_seq"))


def stream_failure_bursts(spark, sf):
    return rounded(jobs.failure_bursts(calls(spark, sf), _work(spark), threshold=3, window_s=7200.0))


def stream_budget_guard(spark, sf):
    c = costed(spark, sf).join(tb.comparison_runs(spark), "run_id")
    d = jobs.budget_guard(c, _work(spark), BUDGET)
    return rounded(d.select("comparison", "run_id", "idx", F.date_format("updated_at", "yyyy-MM-dd").alias("day"), "spent"))


QUERIES = {
    "stream_points_upsert": stream_points_upsert,
    "stream_run_totals": stream_run_totals,
    "stream_rate_usage": stream_rate_usage,
    "stream_rate_usage_sliding": stream_rate_usage_sliding,
    "stream_dedupe": stream_dedupe,
    "stream_failure_bursts": stream_failure_bursts,
    "stream_budget_guard": stream_budget_guard,
}
