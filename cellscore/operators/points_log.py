"""The attempt log and what follows from it: latest view, work left over, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellscore.functions.common import bucketed_running_sum, count_if, flag


# Fixed value: buckets of (run, cell) for which ``late_attempts`` broadcasts a time.
TIME_BUCKETS = 1 << 16


def late_attempts(attempts: DataFrame) -> DataFrame:
    """The attempts without such as are older than the last time of their (run, cell), for most of them.

    The last times are brought together in a fixed number of buckets, each with the earliest of them, so any number of runs
    can be filtered this way. A bucket with a (run, cell) without any time keeps all its rows.
    """
    bucket = F.pmod(F.xxhash64("run_id", "idx"), F.lit(TIME_BUCKETS)).cast("int")
    last = attempts.groupBy("run_id", "idx").agg(F.max("updated_at").alias("_t")).select(bucket.alias("_bucket"), "_t")
    since = last.groupBy("_bucket").agg(F.when(F.count("*") == F.count("_t"), F.min("_t")).alias("_since"))
    d = attempts.withColumn("_bucket", bucket).join(F.broadcast(since), "_bucket")  # TIME_BUCKETS rows at most
    return d.where(F.col("_since").isNull() | (F.col("updated_at") >= F.col("_since"))).drop("_bucket", "_since")


def latest_points(attempts: DataFrame, payload: Sequence[str], counted: bool = True) -> DataFrame:
    """Last attempt per (run, cell) and, if ``counted``, the number of attempts.

    A maximum over (time, sequence, payload) instead of a window: the log is reduced before the
    shuffle, so a cell that was retried very often does not end up in one task as a pile of rows.
    Spark sorts all rows for a maximum of structs, but not for one of times; so that one goes first, and few rows are left.
    """
    last = F.max(F.struct("updated_at", "seq", *payload)).alias("_last")
    d = late_attempts(attempts).groupBy("run_id", "idx").agg(last)
    if counted:
        n = attempts.groupBy(F.col("run_id").alias("_run"), F.col("idx").alias("_idx")).agg(F.count("*").alias("attempts"))
        d = d.join(n, d["run_id"].eqNullSafe(n["_run"]) & d["idx"].eqNullSafe(n["_idx"]))
    return d.select("run_id", "idx", *(["attempts"] if counted else []), F.col("_last.updated_at").alias("updated_at"),
                    *[F.col(f"_last.{c}").alias(c) for c in payload])


def comparison_members(saved: DataFrame) -> DataFrame:
    """Runs of every comparison in position order; the last save under a name counts."""
    last = saved.groupBy("name").agg(F.max_by("run_ids", "saved_at").alias("run_ids"))
    d = last.select(F.col("name").alias("comparison"), F.posexplode("run_ids").alias("position", "run_id"))
    return d.groupBy("comparison", "run_id").agg(F.min("position").alias("position"))


def usable_attempts(attempts: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts that may be appended, and those refused because their run is complete (immutable)."""
    done = runs.where(F.col("status") == "complete").select("run_id")
    return attempts.join(done, "run_id", "left_anti"), attempts.join(done, "run_id", "left_semi")


def missing_points(cells: DataFrame, latest: DataFrame) -> DataFrame:
    """Cells of a run without a successful answer; ``cells`` lists (run_id, idx) wanted."""
    done = latest.where(F.col("error").isNull()).select("run_id", "idx")
    return cells.join(done, ["run_id", "idx"], "left_anti")


def failed_points(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("error").isNotNull())


def retry_queue(cells: DataFrame, latest: DataFrame, order: DataFrame) -> DataFrame:
    """Work list: cells never answered first (phase 0), then cells whose last attempt failed (1)."""
    tried = latest.select("run_id", "idx", F.col("error").isNotNull().alias("failed"))
    d = cells.join(tried, ["run_id", "idx"], "left").where(F.col("failed").isNull() | F.col("failed"))
    phase = F.when(F.col("failed").isNull(), F.lit(0)).otherwise(F.lit(1))
    return d.select("run_id", "idx", phase.alias("phase")).join(order.select("idx", "visit"), "idx")


def run_totals(costed: DataFrame, latest: DataFrame) -> DataFrame:
    """Tokens and cost over all attempts, successful cells of the latest view."""
    tot = costed.groupBy("run_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "thinking_tokens")],
        F.sum("cost_usd").alias("cost_usd"),
    )
    done = latest.groupBy("run_id").agg(count_if(F.col("error").isNull()).alias("n_points_done"))
    return tot.join(done, "run_id", "left")


def run_completion(latest: DataFrame, totals: DataFrame, max_failed: float = 0.01) -> DataFrame:
    """Complete when nothing is missing and at most ``max_failed`` of the cells failed."""
    agg = latest.groupBy("run_id").agg(
        count_if(F.col("error").isNull()).alias("n_done"), count_if(F.col("error").isNotNull()).alias("n_failed")
    )
    d = totals.select("run_id", "n_total").join(agg, "run_id", "left").na.fill(0, ["n_done", "n_failed"])
    d = d.withColumn("n_missing", F.col("n_total") - F.col("n_done") - F.col("n_failed"))
    bad = (F.col("n_missing") > 0) | (F.col("n_failed") > F.col("n_total") * max_failed)
    note = (
        F.when(bad, F.format_string("to be resumed: %d points with errors, %d without answer", "n_failed", "n_missing"))
        .when(F.col("n_failed") > 0, F.format_string("points left with errors: %d", "n_failed"))
    )
    return d.withColumn("status", F.when(bad, F.lit("failed")).otherwise(F.lit("complete"))).withColumn("note", note)


def usage_per_point(latest: DataFrame, min_points: int = 10) -> DataFrame:
    """Mean tokens per successful point, half-even; only for runs with enough points."""
    agg = latest.where(F.col("error").isNull()).groupBy("run_id").agg(
        F.count("*").alias("n"),
        *[F.rint(F.avg(c)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "thinking_tokens")],
    )
    return agg.where(F.col("n") >= min_points)


def budget_cutoff(costed: DataFrame, cap: float, prior: float = 0.0, days: int = 30) -> DataFrame:
    """Flags the rows of every comparison that come after its spend reached the cap.

    Rows run in completion order; a row is kept while the spend before it is under the cap. Unknown
    prices add nothing. The running sum goes over time slices, so no task sees a whole comparison.
    """
    slices = F.floor(F.datediff(F.to_date("updated_at"), F.lit("1970-01-01")) / days)
    d = bucketed_running_sum(
        costed,
        ["comparison"],
        slices,
        [F.col("updated_at"), F.col("seq"), F.col("run_id")],
        {"spent_before": F.coalesce("cost_usd", F.lit(0.0))},
    )
    return d.withColumn("kept", F.col("spent_before") + prior < cap)


def batch_budget_fit(todo: DataFrame, chunk: int = 10_000) -> DataFrame:
    """How many rows of each batch chunk fit the money left.

    ``todo``: run_id, n_todo, est_per_point, room (limit less spent and reserved). Chunks before this
    one are reserved in full, or submission has stopped; so the room at a chunk is closed form.
    """
    n_chunks = F.ceil(F.col("n_todo") / chunk).cast("int")
    d = todo.where(F.col("n_todo") > 0).select("*", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"))
    size = F.least(F.lit(chunk), F.col("n_todo") - F.col("chunk") * chunk).cast("bigint")
    room = F.greatest(F.lit(0.0), F.col("room") - F.col("est_per_point") * F.col("chunk") * chunk)
    fit = F.floor(room / F.col("est_per_point") + 1e-9)
    d = d.withColumn("size", size)
    sent = F.when(F.col("est_per_point") > 0, F.greatest(F.lit(0), F.least(F.col("size"), fit))).otherwise(F.col("size"))
    return d.select("run_id", "chunk", "size", sent.cast("bigint").alias("submitted"))


def failure_bursts(log: DataFrame, threshold: int = 20, window_s: float = 60.0, slice_s: int = 3600) -> DataFrame:
    """First time a run has ``threshold`` failures in a row within ``window_s`` seconds.

    A burst ends at a failure whose ``threshold`` - 1 predecessors are failures no older than the
    window. So a slice of time needs only the rows of the window before it as a margin, and a busy
    run is searched slice by slice.
    """
    t = F.col("ts").cast("timestamp").cast("double")
    own = F.floor(t / slice_s)
    d = log.select("run_id", "ok", "seq", t.alias("t"), own.alias("own"))
    last = F.floor((F.col("t") + window_s) / slice_s)
    d = d.select("*", F.explode(F.sequence(F.col("own"), last)).alias("slice"))
    w = Window.partitionBy("run_id", "slice").orderBy("t", "seq").rowsBetween(-(threshold - 1), 0)
    full = (F.count("*").over(w) == threshold) & (F.sum(F.col("ok").cast("int")).over(w) == 0)
    near = F.col("t") - F.min("t").over(w) <= window_s
    hit = d.withColumn("hit", full & near).where(F.col("hit") & (F.col("own") == F.col("slice")))
    return hit.groupBy("run_id").agg(F.min("t").alias("opened_at"))


def rate_usage(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests and tokens per provider and minute against the limits (the least over the configs)."""
    lim = limits.groupBy("provider").agg(F.min("rpm").alias("rpm"), F.min("tpm").alias("tpm"))
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    use = calls.groupBy("provider", minute.alias("minute")).agg(
        F.count("*").alias("requests"), F.sum("tokens").cast("bigint").alias("tokens")
    )
    over = flag(F.col("requests") > F.col("rpm")) | flag(F.col("tokens") > F.col("tpm"))
    return use.join(lim, "provider", "left").withColumn("over_limit", over)


def progress_by_prefix(order: DataFrame, prefixes: list[int]) -> DataFrame:
    """How much of the globe the first k points of the visiting order touch."""
    d = order.select("lat", "lon", "visit", F.explode(F.array(*[F.lit(k) for k in prefixes])).alias("k"))
    d = d.where(F.col("visit") <= F.col("k"))
    hemi = F.struct(F.col("lat") > 0, F.col("lon") > 0)
    return d.groupBy("k").agg(
        F.count("*").alias("n"),
        F.countDistinct(hemi).alias("n_hemispheres"),
        F.countDistinct(F.floor((F.col("lon") + 180) / 60)).alias("n_sextants"),
        F.countDistinct(F.floor((F.col("lat") + 90) / 45)).alias("n_bands"),
    )


def run_progress(latest: DataFrame, runs: DataFrame, costs: DataFrame) -> DataFrame:
    agg = latest.groupBy("run_id").agg(
        F.count("*").alias("n_done"), count_if(F.col("p_land").isNull()).alias("n_invalid")
    )
    d = runs.select("run_id", "variant", "n_total").join(agg, "run_id", "left").join(costs, "run_id", "left")
    d = d.na.fill(0, ["n_done", "n_invalid"])
    return d.withColumn("share", F.col("n_done") / F.col("n_total"))
