"""Cell-level scores of all runs: flags, one wide aggregation, calibration and threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscore.functions.common import count_if, exact_quantiles, flag, has_number, num, safe_div

# Log-loss clip and number of calibration bins.
LOG_LOSS_EPS = 1e-6
N_BINS = 10

ERROR_CLASSES = {"correct": 0, "false_land": 1, "false_water": 2, "invalid": 3}


def clean_probability(df: DataFrame, name: str = "p_land") -> DataFrame:
    """NaN to NULL: NULL is the only mark of an invalid answer."""
    return df.withColumn(name, F.when(has_number(name), F.col(name)))


def point_flags(points: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per point: w, known, t_land, valid, pred_land (strictly above the threshold), correct."""
    own = F.when(has_number("weight"), F.col("weight"))
    w = F.greatest(F.coalesce(own, F.cos(F.radians("lat"))), F.lit(0.0))
    known, valid = F.col("truth").isNotNull(), has_number("p_land")
    t_land = flag(F.col("truth") > 0.5)
    pred = valid & flag(F.col("p_land") > threshold)
    return points.withColumns(
        {
            "w": w,
            "known": known,
            "t_land": t_land,
            "valid": valid,
            "pred_land": pred,
            "correct": valid & known & (pred == t_land),
        }
    )


def error_class() -> Column:
    """0 correct, 1 false land, 2 false water, 3 invalid, NULL when the truth is unknown."""
    return (
        F.when(~F.col("known"), F.lit(None).cast("int"))
        .when(~F.col("valid"), F.lit(3))
        .when(F.col("correct"), F.lit(0))
        .when(F.col("pred_land"), F.lit(1))
        .otherwise(F.lit(2))
    )


def _wsum(cond: Column) -> Column:
    return F.sum(F.when(F.col("known") & cond, F.col("w")).otherwise(F.lit(0.0)))


def metric_sums() -> dict[str, Column]:
    """The additive parts of all scalar metrics; needs ``point_flags``."""
    p = F.least(F.greatest(F.col("p_land"), F.lit(0.0)), F.lit(1.0))
    y = num(F.col("t_land"))
    pc = F.least(F.greatest(p, F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    loss = -(y * F.log(pc) + (1.0 - y) * F.log(1.0 - pc))
    scored = F.col("known") & F.col("valid")
    t, pred = F.col("t_land"), F.col("pred_land")
    return {
        "n_points": F.count("*"),
        "n_valid": count_if(F.col("valid")),
        "n_known": count_if(F.col("known")),
        "n_unknown_truth": count_if(~F.col("known")),
        "n_correct": count_if(F.col("correct")),
        "sw": _wsum(F.lit(True)),
        "sw_valid": _wsum(F.col("valid")),
        "sw_correct": _wsum(F.col("correct")),
        "sw_land": _wsum(t),
        "sw_pred": _wsum(pred),
        "tp": _wsum(pred & t),
        "fp": _wsum(pred & ~t),
        "fn": _wsum(~pred & t),
        "s_sq": F.sum(F.when(scored, F.col("w") * F.pow(p - y, F.lit(2.0))).otherwise(F.lit(0.0))),
        "s_log": F.sum(F.when(scored, F.col("w") * loss).otherwise(F.lit(0.0))),
    }


def metric_columns() -> dict[str, Column]:
    """Scalar metrics from the sums of ``metric_sums``; NULL where a denominator is not positive."""
    sw = F.col("sw")
    acc = safe_div(F.col("sw_correct"), sw)
    base = safe_div(sw - F.col("sw_land"), sw)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {
        "acc_area": acc,
        "acc_unweighted": F.when(sw > 0, safe_div(F.col("n_correct"), F.col("n_known"))),
        "acc_valid_only": safe_div(F.col("sw_correct"), F.col("sw_valid")),
        "baseline_area": base,
        "skill": F.when(base < 1.0, (acc - base) / (1.0 - base)),
        "land_share_true": safe_div(F.col("sw_land"), sw),
        "land_share_pred": safe_div(F.col("sw_pred"), sw),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "iou": safe_div(tp, tp + fp + fn),
        "brier": safe_div(F.col("s_sq"), F.col("sw_valid")),
        "log_loss": safe_div(F.col("s_log"), F.col("sw_valid")),
        "invalid_rate": safe_div(F.col("n_points") - F.col("n_valid"), F.col("n_points")),
    }


def metrics_by(flags: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The named metrics per key; sums nobody asks for are pruned by the optimizer."""
    sums = flags.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_sums().items()])
    cols = metric_columns()
    return sums.select(*keys, *[cols[n].alias(n) if n in cols else F.col(n) for n in names])


def is_probabilistic(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Logprobs runs, and sampling runs with more than one sample per point."""
    n = points.groupBy("run_id").agg(F.max("n_samples").alias("max_samples"))
    mode = F.col("extraction_mode")
    return (
        runs.select("run_id", "extraction_mode")
        .join(n, "run_id", "left")
        .withColumn(
            "probabilistic",
            (mode == "logprobs") | ((mode == "sample") & flag(F.col("max_samples") > 1)),
        )
    )


def calibration_bins(flags: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Reliability table per run, an edge value belongs to the bin above it."""
    p = F.least(F.greatest(F.col("p_land"), F.lit(0.0)), F.lit(1.0))
    b = F.least(F.floor(p * n_bins), F.lit(n_bins - 1)).cast("int")
    d = flags.where(F.col("known") & F.col("valid"))
    agg = d.groupBy("run_id", b.alias("bin")).agg(
        F.sum("w").alias("weight"),
        F.count("*").alias("n"),
        F.sum(F.col("w") * p).alias("_p"),
        F.sum(F.col("w") * num(F.col("t_land"))).alias("_y"),
    )
    return agg.where(F.col("weight") > 0).select(
        "run_id",
        "bin",
        (F.col("bin") / n_bins).alias("lo"),
        ((F.col("bin") + 1) / n_bins).alias("hi"),
        (F.col("_p") / F.col("weight")).alias("mean_p"),
        (F.col("_y") / F.col("weight")).alias("frac_land"),
        "weight",
        "n",
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.col("weight") * F.abs(F.col("mean_p") - F.col("frac_land"))
    return bins.groupBy("run_id").agg(safe_div(F.sum(gap), F.sum("weight")).alias("ece"))


def reliability_bins(flags: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Like ``calibration_bins``, but an edge value belongs to the bin below it; p is not clipped."""
    inner = [i / n_bins for i in range(1, n_bins)]
    b = sum((F.when(F.col("p_land") > e, 1).otherwise(0) for e in inner), F.lit(0))
    d = flags.where(F.col("known") & F.col("valid"))
    agg = d.groupBy("run_id", b.alias("bin")).agg(
        F.sum("w").alias("_w"),
        F.sum(F.col("w") * F.col("p_land")).alias("_p"),
        F.sum(F.col("w") * num(F.col("t_land"))).alias("_y"),
        F.count("*").alias("count"),
    )
    den = F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.lit(1.0))
    return agg.select(
        "run_id",
        (F.col("bin") / n_bins).alias("bin_lo"),
        ((F.col("bin") + 1) / n_bins).alias("bin_hi"),
        (F.col("_p") / den).alias("mean_p"),
        (F.col("_y") / den).alias("observed"),
        "count",
    )


def volume_latency(points: DataFrame) -> DataFrame:
    """Counts, token sums and exact latency quantiles over all points, failed ones included."""
    p_ok = has_number("p_land")
    vol = points.groupBy("run_id").agg(
        F.count("*").alias("n_points"),
        count_if(p_ok).alias("n_valid"),
        count_if(F.col("truth").isNull()).alias("n_unknown_truth"),
        F.avg(num(~p_ok)).alias("invalid_rate"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "thinking_tokens")],
    )
    q = exact_quantiles(points, ["run_id"], "latency_s", {"latency_p50": 0.5, "latency_p95": 0.95})
    return vol.join(q, "run_id", "left")


CELL_METRICS = (
    "n_points", "n_valid", "n_unknown_truth", "acc_area", "acc_unweighted", "acc_valid_only",
    "baseline_area", "skill", "land_share_true", "land_share_pred", "precision", "recall", "f1",
    "iou", "brier", "log_loss", "invalid_rate",
)


def cell_metrics(points: DataFrame, runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One wide row per run; probability scores only where the run is probabilistic."""
    flags = point_flags(points, threshold)
    bins = calibration_bins(flags)
    wide = metrics_by(flags, ["run_id"], CELL_METRICS)
    ece = bins.groupBy("run_id").agg(
        safe_div(F.sum(F.col("weight") * F.abs(F.col("mean_p") - F.col("frac_land"))), F.sum("weight")).alias("ece"),
        F.sort_array(F.collect_list(F.struct("lo", "hi", "mean_p", "frac_land", "weight", "n"))).alias("calibration_bins"),
    )
    speed = volume_latency(points).drop("n_points", "n_valid", "n_unknown_truth", "invalid_rate")
    d = (
        wide.join(ece, "run_id", "left")
        .join(speed, "run_id", "left")
        .join(is_probabilistic(points, runs).select("run_id", "probabilistic"), "run_id", "left")
    )
    for c in ("brier", "log_loss", "ece", "calibration_bins"):
        d = d.withColumn(c, F.when(F.col("probabilistic"), F.col(c)))
    return d.withColumn("threshold", F.lit(float(threshold)))


def threshold_sweep(points: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Scores of every run at every threshold from one pass.

    Each point is reduced to the number of thresholds below its answer, and the sums per (run,
    number) are shuffled: at most T + 1 rows a run, whatever the number of points. The scores at a
    threshold are suffix sums over these rows.
    """
    ts = sorted(set(float(t) for t in thresholds))
    flags = point_flags(points, ts[0]).where("known")
    above = sum((F.when(flag(F.col("p_land") > t), 1).otherwise(0) for t in ts), F.lit(0))
    t, valid, w = F.col("t_land"), F.col("valid"), F.col("w")
    per = flags.groupBy("run_id", F.when(valid, above).alias("_k")).agg(
        F.sum(w).alias("_w"), F.sum(F.when(t, w).otherwise(0.0)).alias("_land")
    )
    rows = per.select("*", F.posexplode(F.array(*[F.lit(x) for x in ts])).alias("_i", "threshold"))
    said = flag(F.col("_k") > F.col("_i"))  # NULL k: no valid answer
    water = F.col("_w") - F.col("_land")
    agg = rows.groupBy("run_id", "threshold").agg(
        F.sum("_w").alias("sw"),
        F.sum("_land").alias("sw_land"),
        F.sum(F.when(F.col("_k").isNotNull(), F.col("_w")).otherwise(0.0)).alias("sw_valid"),
        F.sum(F.when(said, F.col("_land")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(said, water).otherwise(0.0)).alias("fp"),
        F.sum(F.when(F.col("_k").isNotNull() & ~said, water).otherwise(0.0)).alias("tn"),
    )
    agg = agg.withColumn("fn", F.col("sw_land") - F.col("tp"))
    agg = agg.withColumn("sw_correct", F.col("tp") + F.col("tn")).withColumn("sw_pred", F.col("tp") + F.col("fp"))
    names = ("acc_area", "acc_valid_only", "skill", "land_share_pred", "precision", "recall", "f1", "iou")
    cols = metric_columns()
    return agg.select("run_id", "threshold", *[cols[n].alias(n) for n in names])


def error_breakdown(flags: DataFrame) -> DataFrame:
    """Area shares of correct, false land, false water and invalid (sum 1) and their counts."""
    d = flags.withColumn("_e", error_class())
    sw = _wsum(F.lit(True))
    shares = [safe_div(_wsum(F.col("_e") == k), sw).alias(n) for n, k in ERROR_CLASSES.items()]
    counts = [count_if(F.col("_e") == k).alias(f"n_{n}") for n, k in ERROR_CLASSES.items() if k]
    return d.groupBy("run_id").agg(*shares, *counts)


def repeat_spread(scores: DataFrame) -> DataFrame:
    """Spread of the accuracy over the repeats of one variant; columns variant, acc_area."""
    a = F.col("acc_area")
    return (
        scores.where(a.isNotNull())
        .groupBy("variant")
        .agg(
            F.count("*").alias("n"),
            F.avg(a).alias("mean"),
            F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("std"),
            F.min(a).alias("min"),
            F.max(a).alias("max"),
        )
    )


def run_health(points: DataFrame) -> DataFrame:
    """Done, invalid (no answer and no error), errors, cut-off answers, low mass, most common error."""
    err = flag(F.col("error") != "")
    vm = F.col("validity_mass")
    top = (
        points.where(err)
        .groupBy("run_id", F.substring("error", 1, 80).alias("_e"))
        .agg(F.count("*").alias("_n"))
        .groupBy("run_id")
        .agg(F.min_by("_e", F.struct(-F.col("_n"), "_e")).alias("top_error"))
    )
    agg = points.groupBy("run_id").agg(
        F.count("*").alias("done"),
        count_if(~has_number("p_land") & ~err).alias("n_invalid"),
        count_if(err).alias("n_errors"),
        count_if(truncated()).alias("n_truncated"),
        F.when(F.count(vm) > 0, count_if(vm < 0.5) / F.count("*")).alias("low_mass"),
    )
    q = exact_quantiles(points, ["run_id"], "latency_s", {"p50": 0.5, "p95": 0.95})
    d = agg.join(q, "run_id", "left").join(top, "run_id", "left")
    return d.withColumn("top_error", F.coalesce("top_error", F.lit("")))


def truncated() -> Column:
    # Finish reasons that mean the answer was cut off.
    return flag(F.lower("finish_reason").isin("length", "max_tokens", "max_output_tokens"))


def latency_histogram(points: DataFrame, n_bins: int = 60) -> DataFrame:
    """Positive latencies in equal bins per run, and whether a log axis is called for."""
    d = points.where(F.col("latency_s") > 0).select("run_id", F.col("latency_s").alias("v"))
    ends = d.groupBy("run_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    b = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(n_bins - 1))).otherwise(F.lit(0))
    hist = (
        d.join(ends, "run_id")
        .groupBy("run_id", "lo", "hi", b.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    q = exact_quantiles(d, [], "v", {"p1": 0.01, "p99": 0.99})
    q = q.select((F.col("p99") / F.greatest("p1", F.lit(1e-6)) > 50).alias("log_axis"))
    return hist.crossJoin(F.broadcast(q)).select(  # one row
        "run_id",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        "n",
        "log_axis",
    )


def map_layer(points: DataFrame, cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Dense map rows per run: p_land, binary, error and whether the cell was evaluated.

    ``cells`` holds every cell of every run wanted; both sides shuffle on (run, cell).
    """
    f = point_flags(points, threshold).withColumn("error_code", error_class())
    d = f.select(
        "run_id",
        "idx",
        "p_land",
        F.when(F.col("valid"), F.col("pred_land").cast("int")).alias("binary"),
        "error_code",
        F.lit(True).alias("present"),
    )
    return cells.join(d, ["run_id", "idx"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def infer_grid(points: DataFrame) -> DataFrame:
    """Step and placement per run from the coordinates alone.

    Works on the distinct latitudes and longitudes with their counts, which the grid bounds.
    """

    def smallest_gap(col: str) -> DataFrame:
        u = points.where(F.col(col).isNotNull()).select("run_id", F.round(col, 6).alias("v")).distinct()
        gap = F.col("v") - F.lag("v").over(Window.partitionBy("run_id").orderBy("v"))
        return u.withColumn("gap", gap).where(F.col("gap") > 1e-6).select("run_id", "gap")

    step = (
        smallest_gap("lat")
        .unionByName(smallest_gap("lon"))
        .groupBy("run_id")
        .agg(F.round(F.min("gap"), 6).alias("step"))
    )
    lats = points.where(F.col("lat").isNotNull()).groupBy("run_id", "lat").agg(F.count("*").alias("m"))
    d = lats.join(step, "run_id", "left").withColumn("step", F.coalesce("step", F.lit(2.0)))
    off = F.abs(F.pmod((F.lit(90.0) - F.col("lat")) / F.col("step"), F.lit(1.0)) - 0.5)
    out = d.withColumn("off", off).groupBy("run_id").agg(
        F.max("step").alias("step_deg"), F.expr("percentile(off, 0.5, m)").alias("_med")
    )
    place = F.when(F.col("_med") < 0.25, F.lit("cell_center")).otherwise(F.lit("cell_corner"))
    return out.select("run_id", "step_deg", place.alias("placement"))
