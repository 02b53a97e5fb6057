"""Points tables on disk: Parquet by run, CSV, metrics documents and the append-only attempt log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("truth", T.IntegerType()),
        T.StructField("p_land", T.DoubleType()),
        T.StructField("n_valid", T.IntegerType()),
        T.StructField("n_samples", T.IntegerType()),
        T.StructField("validity_mass", T.DoubleType()),
        T.StructField("answer_text", T.StringType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("thinking_tokens", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """The fixed columns in order; text that is no number becomes NULL, missing columns are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in POINT_SCHEMA.fields
        ]
    )


def read_points(spark: SparkSession, path: str, runs: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Points of the wanted runs; on Parquet written by ``export_points`` only their folders are read."""
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.schema(POINT_SCHEMA).parquet(path)
    if runs is not None:
        raw = raw.where(F.col("run_id").isin(runs))
    return conform(raw)


def export_points(points: DataFrame, path: str, fmt: str = "parquet", by_run: bool = True) -> None:
    """All runs in one job. A run is a folder (Parquet), or ``run_id`` the first column (CSV).

    Rows are ranged over (run, cell), so that a large run becomes several files.
    """
    d = conform(points).repartitionByRange("run_id", "idx").sortWithinPartitions("run_id", "idx")
    if fmt == "csv":
        d.write.mode("errorifexists").option("header", True).csv(path)
    elif fmt == "parquet":
        w = d.write.mode("errorifexists")
        (w.partitionBy("run_id") if by_run else w).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def append_attempts(attempts: DataFrame, runs: DataFrame, log_path: str, reject_path: str) -> None:
    """Append attempts of unfinished runs to the log; attempts of complete runs go to the rejects."""
    from cellscore.operators.points_log import usable_attempts

    good, refused = usable_attempts(attempts, runs)
    good.write.mode("append").partitionBy("run_id").parquet(log_path)
    refused.write.mode("append").parquet(reject_path)


def metrics_documents(runs: DataFrame, metrics: DataFrame, models: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    """One JSON document per run: the run record, its model and spec where they are given (by run_id), and its metrics rows
    by time of computation, then threshold."""
    own = [c for c in metrics.columns if c not in ("run_id", "computed_at")]
    rows = metrics.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("computed_at", *own))).alias("metrics")  # one row a mask and threshold
    )
    d, parts = runs.select("run_id", F.struct(*runs.columns).alias("run")), ["run"]
    for name, side in (("model", models), ("spec", specs)):
        if side is not None:
            d = d.join(side.select("run_id", F.struct(*[c for c in side.columns if c != "run_id"]).alias(name)), "run_id", "left")
            parts.append(name)
    d = d.join(rows, "run_id", "left")
    return d.select("run_id", F.to_json(F.struct(*parts, "metrics")).alias("document"))


def export_metrics(runs: DataFrame, metrics: DataFrame, path: str, models: DataFrame | None = None, specs: DataFrame | None = None) -> None:
    metrics_documents(runs, metrics, models, specs).select("document").write.mode("errorifexists").text(path)
