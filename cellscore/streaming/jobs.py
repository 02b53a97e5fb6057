"""The log operators on streams.

Every job keeps only what its keys need. Results go to Parquet folders or to tables that batches are merged into; either
way a batch that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellscore.functions.common import bucketed_running_sum, flag
from cellscore.streaming.upsert import UpsertTable


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table of a folder as a stream of its files; the schema comes from the files' footer."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def _drain(writer, work: str) -> None:
    q = writer.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def by_batch(stream: DataFrame, work: str, handle, mode: str = "append") -> None:
    """Run the stream to its present end; ``handle(batch, folder, epoch)`` writes into its own folder."""

    def one(batch: DataFrame, epoch: int) -> None:
        handle(batch, f"{work}/out/epoch={epoch}", epoch)

    _drain(stream.writeStream.outputMode(mode).foreachBatch(one), work)


def points_upsert(attempts: DataFrame, work: str, payload: list[str]) -> DataFrame:
    """Latest point per (run, cell), in a table that batches are merged into."""

    def latest(d: DataFrame) -> DataFrame:
        return d.groupBy("run_id", "idx").agg(F.max("last").alias("last"), F.sum("n").alias("n"))

    table = UpsertTable(attempts.sparkSession, f"{work}/points", ["run_id", "idx"], latest)
    rows = attempts.select("run_id", "idx", F.struct("updated_at", "seq", *payload).alias("last"), F.lit(1).cast("bigint").alias("n"))
    by_batch(rows, work, lambda batch, folder, epoch: table.merge(batch, epoch))
    d = table.read()
    d = rows_of(attempts.sparkSession, rows) if d is None else d
    return d.select("run_id", "idx", F.col("n").alias("attempts"), *[F.col(f"last.{c}").alias(c) for c in ["updated_at", *payload]])


def rows_of(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """No rows, with the columns of a stream."""
    return spark.createDataFrame([], stream.schema)


def run_totals(costed: DataFrame, work: str) -> DataFrame:
    """Running tokens, cost and failures per run, in a table that batches are merged into."""
    sums = ["input_tokens", "output_tokens", "cost_usd", "n_ok", "n_failed"]

    def added(d: DataFrame) -> DataFrame:
        return d.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in sums])

    ok = F.col("error").isNull().cast("bigint")
    rows = costed.select("run_id", *[F.col(c).cast("bigint").alias(c) for c in sums[:2]], "cost_usd", ok.alias("n_ok"), (1 - ok).cast("bigint").alias("n_failed"))
    table = UpsertTable(costed.sparkSession, f"{work}/totals", ["run_id"], added)
    by_batch(rows, work, lambda batch, folder, epoch: table.merge(batch, epoch))
    d = table.read()
    return rows_of(costed.sparkSession, rows) if d is None else d


def rate_usage(calls: DataFrame, work: str, limits: DataFrame | None = None, slide: str | None = None, late: str = "2 minutes") -> DataFrame:
    """Requests and tokens per provider and minute (beginning every ``slide``), with the limits (provider, rpm, tpm; the least
    count) where they are given. Rows later than the watermark are dropped."""
    win = F.window("ts", "1 minute", slide) if slide else F.window("ts", "1 minute")
    agg = calls.withWatermark("ts", late).groupBy(win, "provider").agg(
        F.count("*").alias("requests"), F.sum("tokens").cast("bigint").alias("tokens")
    )
    flat = agg.select("provider", F.col("window.start").alias("minute"), "requests", "tokens")
    schema = "provider string, minute timestamp, requests bigint, tokens bigint"
    if limits is not None:
        least = limits.groupBy("provider").agg(F.min("rpm").alias("rpm"), F.min("tpm").alias("tpm"))
        over = flag(F.col("requests") > F.col("rpm")) | flag(F.col("tokens") > F.col("tpm"))
        flat = flat.join(least, "provider", "left").withColumn("over_limit", over)
        schema += ", rpm int, tpm int, over_limit boolean"
    _drain(flat.writeStream.outputMode("append").format("parquet").option("path", f"{work}/out"), work)
    return calls.sparkSession.read.schema(schema).parquet(f"{work}/out")


def dedupe(calls: DataFrame, work: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Calls delivered twice within the watermark are kept once."""
    d = calls.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    _drain(d.writeStream.outputMode("append").format("parquet").option("path", f"{work}/out"), work)
    return calls.sparkSession.read.schema(calls.schema).parquet(f"{work}/out")


def failure_bursts(calls: DataFrame, work: str, threshold: int = 20, window_s: float = 60.0, slice_s: int = 86400, late: str = "2 minutes") -> DataFrame:
    """First burst of failures per run, with keyed state and event-time timers.

    State belongs to a (run, slice of time), with the rows of one window before the slice repeated in it, so that a busy run
    is spread over many keys. It holds the rows newer than the watermark, which later rows may still come
    between, and of the older ones only the last ``threshold`` - 1 of one window; a burst that the watermark has passed
    is latched and the rows go. Each change of what is known (a burst found, moved or undone by a late success) is put out with
    a number; the view takes the last of each key. When the watermark passes the slice's end its state is removed.
    """
    t = F.col("ts").cast("double")
    own = F.floor(t / slice_s)
    d = calls.withWatermark("ts", late).select("run_id", "ts", "ok", "seq", t.alias("t"), own.alias("own"))
    d = d.select("*", F.explode(F.sequence(F.col("own"), F.floor((F.col("t") + window_s) / slice_s))).alias("slice"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, seqs, oks, owns, found, number, latched = state.get if state.exists else ([], [], [], [], None, 0, False)
        if state.hasTimedOut:
            state.remove()
            return
        frames = list(batches)
        mark = state.getCurrentWatermarkMs() / 1000.0
        if not latched:
            new = pd.concat(frames)
            t = np.concatenate((np.array(times, float), new["t"].to_numpy(float)))
            seq = np.concatenate((np.array(seqs, np.int64), new["seq"].to_numpy(np.int64)))
            ok = np.concatenate((np.array(oks, bool), new["ok"].to_numpy(bool)))
            mine = np.concatenate((np.array(owns, bool), new["own"].to_numpy() == key[1]))
            order = np.lexsort((seq, t))
            t, seq, ok, mine = t[order], seq[order], ok[order], mine[order]
            at = np.arange(len(t))
            streak = at - np.maximum.accumulate(np.where(ok, at, -1))
            hot = np.flatnonzero(mine & (streak >= threshold) & (t - t[np.maximum(at - threshold + 1, 0)] <= window_s))
            now = float(t[hot[0]]) if len(hot) else None
            if now != found:
                found, number = now, number + 1
                yield pd.DataFrame({"run_id": [key[0]], "slice": [key[1]], "number": [number], "opened_at": pd.array([now], dtype="Float64")})
            latched = now is not None and now <= mark
            past = int(np.searchsorted(t, mark, "right"))
            first = max(0, past - threshold + 1, int(np.searchsorted(t, mark - window_s)))
            keep = slice(len(t), None) if latched else slice(first, None)
            times, seqs, oks, owns = t[keep].tolist(), seq[keep].tolist(), ok[keep].tolist(), (mine[keep] & (t[keep] > mark)).tolist()
        end = (key[1] + 1) * slice_s
        if end <= mark:
            state.remove()
        else:
            state.update((times, seqs, oks, owns, found, number, latched))
            state.setTimeoutTimestamp(int(end * 1000))

    kept = "times array<double>, seqs array<bigint>, oks array<boolean>, owns array<boolean>, found double, number bigint, latched boolean"
    schema = "run_id string, slice bigint, number bigint, opened_at double"
    out = d.groupBy("run_id", "slice").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
    _drain(out.writeStream.outputMode("append").format("parquet").option("path", f"{work}/out"), work)
    got = calls.sparkSession.read.schema(schema).parquet(f"{work}/out")
    last = got.groupBy("run_id", "slice").agg(F.max_by("opened_at", "number").alias("opened_at")).where("opened_at is not null")
    return last.groupBy("run_id").agg(F.min("opened_at").alias("opened_at"))


def budget_guard(costed: DataFrame, work: str, cap: float) -> DataFrame:
    """The first row of a comparison, in the order of time, with which its spend reaches the cap.

    Batches are merged into a table of spend per comparison and day, and their rows are put into folders by month. The view adds
    up the days, and reads only the folders of the days in which a comparison crosses the cap; so rows that come late count
    where they belong, and a batch costs what it brings.
    """
    spark = costed.sparkSession
    cost = F.coalesce("cost_usd", F.lit(0.0))
    rows = costed.select("comparison", "run_id", "idx", "seq", "updated_at", cost.alias("cost"), F.to_date("updated_at").alias("day"))
    rows = rows.withColumn("month", F.date_format("day", "yyyy-MM"))

    def added(d: DataFrame) -> DataFrame:
        return d.groupBy("comparison", "day").agg(F.sum("cost").alias("cost"))

    table = UpsertTable(spark, f"{work}/days", ["comparison", "day"], added)

    def handle(batch: DataFrame, folder: str, epoch: int) -> None:
        dealt = batch.withColumn("epoch", F.lit(epoch)).repartition("month")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "month").parquet(f"{work}/rows")
        table.merge(batch.select("comparison", "day", "cost"), epoch)

    by_batch(rows, work, handle)
    days = table.read()
    schema = "comparison string, run_id string, idx int, updated_at timestamp, spent double"
    if days is None:
        return spark.createDataFrame([], schema)
    w = Window.partitionBy("comparison").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("cost").over(w), F.lit(0.0)))
    near = 1e-9 * abs(cap)  # a day's sum and the running sum of its rows differ in the last places
    crossing = days.where((F.col("before") < cap) & (F.col("before") + F.col("cost") >= cap - near)).select("comparison", "day", "before")
    crossing = crossing.withColumn("month", F.date_format("day", "yyyy-MM"))
    held = spark.read.parquet(f"{work}/rows").drop("epoch").join(crossing, ["comparison", "day", "month"])  # the months prune the folders
    d = bucketed_running_sum(held, ["comparison", "day"], F.hour("updated_at"), [F.col("updated_at"), F.col("seq"), F.col("run_id")], {"own": F.col("cost")})
    d = d.withColumn("spent", F.col("before") + F.col("own") + F.col("cost"))
    d = d.where((F.col("spent") >= cap) & (F.col("spent") - F.col("cost") < cap))
    order = F.struct("day", "updated_at", "seq")
    first = d.groupBy("comparison").agg(F.min_by(F.struct("run_id", "idx", "updated_at", "spent"), order).alias("x"))
    return first.select("comparison", "x.*")
