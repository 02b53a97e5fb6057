"""Scores per run: the flags, metrics, calibration, regions and health jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions import geo
from cellscore.functions.common import rounded
from cellscore.operators import regions as rg
from cellscore.operators import score as sc
from cellscore.operators.points_log import latest_points
from cellscore.operators.score_store import ScoreStore
from cellscore.session import checkpoint_dir, cut_lineage, stored
from cellscore.sources import testbed as tb
from cellscore.sources.grid import cells_of

LATE_RUNS, LATE_FROM = ("r0", "r1", "r2", "r3"), "1998-01-01"
STORED_METRICS = ("acc_area", "acc_unweighted", "skill", "f1", "brier", "n_points")
THRESHOLDS = [i / 20 for i in range(21)]


def flags(spark: SparkSession, sf: str, *payload: str) -> DataFrame:
    return sc.point_flags(tb.points(spark, sf, "p_land", *payload))


def kept_points(spark: SparkSession, sf: str, *payload: str) -> DataFrame:
    """Points written once, for jobs that pass over them several times: the log is read once."""
    return stored(tb.points(spark, sf, "p_land", *payload))


def kept_flags(spark: SparkSession, sf: str) -> DataFrame:
    return sc.point_flags(kept_points(spark, sf))


def accuracy_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: runs by area-weighted accuracy, with skill over the all-water answer."""
    d = sc.metrics_by(flags(spark, sf), ["run_id"], ["acc_area", "baseline_area", "skill", "n_points"])
    return rounded(d).orderBy(F.col("acc_area").desc_nulls_last(), "run_id")


def _metrics(*names: str):
    def job(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(sc.metrics_by(flags(spark, sf), ["run_id"], names))

    return job


def brier_logloss(spark: SparkSession, sf: str) -> DataFrame:
    pts = tb.points(spark, sf, "p_land", "n_samples")
    m = sc.metrics_by(sc.point_flags(pts), ["run_id"], ["brier", "log_loss"])
    d = m.join(sc.is_probabilistic(pts, tb.runs(spark)).select("run_id", "probabilistic"), "run_id")
    for c in ("brier", "log_loss"):
        d = d.withColumn(c, F.when(F.col("probabilistic"), F.col(c)))
    return rounded(d)


def calibration_bins(spark, sf):
    return rounded(sc.calibration_bins(flags(spark, sf)))


def ece(spark, sf):
    return rounded(sc.expected_calibration_error(sc.calibration_bins(flags(spark, sf))))


def reliability_bins(spark, sf):
    return rounded(sc.reliability_bins(flags(spark, sf)))


def is_probabilistic(spark, sf):
    return sc.is_probabilistic(tb.points(spark, sf, "n_samples"), tb.runs(spark))


def volume_latency(spark, sf):
    p = kept_points(spark, sf, "latency_s", "input_tokens", "output_tokens", "thinking_tokens")
    return rounded(sc.volume_latency(p))


def cell_metrics(spark, sf):
    p = kept_points(spark, sf, "n_samples", "latency_s", "input_tokens", "output_tokens", "thinking_tokens")
    d = sc.cell_metrics(p, tb.runs(spark))
    n_bins = F.when(F.col("calibration_bins").isNotNull(), F.size("calibration_bins"))
    return rounded(d.withColumn("n_calibration_bins", n_bins).drop("calibration_bins"))


def threshold_sweep(spark, sf):
    return rounded(sc.threshold_sweep(tb.points(spark, sf), THRESHOLDS))


def point_flags(spark, sf):
    d = flags(spark, sf)
    return rounded(d.select("run_id", "idx", "w", "known", "t_land", "valid", "pred_land", "correct"))


def error_class(spark, sf):
    d = flags(spark, sf).withColumn("error_code", sc.error_class())
    return d.select("run_id", "idx", "error_code")


def error_breakdown(spark, sf):
    return rounded(sc.error_breakdown(flags(spark, sf)))


def map_layer(spark, sf):
    cells = cells_of(tb.runs(spark).select("run_id"), tb.STEP)
    return rounded(sc.map_layer(tb.points(spark, sf), cells))


def infer_grid(spark, sf):
    return rounded(sc.infer_grid(tb.points(spark, sf)))


def truncated_filter(spark, sf):
    p = tb.points(spark, sf, "finish_reason")
    return p.where(sc.truncated()).select("run_id", "idx", "finish_reason")


def low_mass_filter(spark, sf):
    p = tb.points(spark, sf, "validity_mass")
    return rounded(p.where(F.col("validity_mass") < 0.5).select("run_id", "idx", "validity_mass"))


def region_label(spark, sf):
    d = geo.with_region(tb.points(spark, sf))
    return d.groupBy("run_id", "region").agg(F.count("*").alias("n"), F.sum("idx").alias("sum_idx"))


def nearest_anchor(spark, sf):
    p = tb.points(spark, sf).withColumn("anchor", geo.nearest_anchor(F.col("lat"), F.col("lon")))
    return p.select("run_id", "idx", "anchor")


def region_accuracy(spark, sf):
    return rounded(rg.region_accuracy(flags(spark, sf)))


def region_heat(spark, sf):
    d = rg.region_heat(rg.region_accuracy(flags(spark, sf)))
    return rounded(d.select("run_id", "region", "col_group", "acc", "lo", "hi", "heat"))


def region_table(spark, sf):
    return rounded(rg.region_table(rg.region_accuracy(flags(spark, sf))))


def repeat_spread(spark, sf):
    m = sc.metrics_by(flags(spark, sf), ["run_id"], ["acc_area"])
    return rounded(sc.repeat_spread(m.join(tb.runs(spark), "run_id")))


def run_health(spark, sf):
    p = kept_points(spark, sf, "error", "finish_reason", "validity_mass", "latency_s")
    return rounded(sc.run_health(p))


def latency_histogram(spark, sf):
    return rounded(sc.latency_histogram(tb.points(spark, sf, "latency_s")))


def rescored_runs(spark, sf):
    """Scores from stored block states, at two thresholds: all runs scored without the late attempts of some, then the
    runs with new points scored again. ``rescored`` tells which these were."""
    store = ScoreStore(spark, f"{checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}", (0.5, 0.7))
    a = tb.attempts(spark, sf)
    late = F.col("run_id").isin(*LATE_RUNS) & (F.col("updated_at") >= F.lit(LATE_FROM))
    store.refresh(tb.place(latest_points(a.where(~late), ["p_land"], counted=False)))
    again = store.refresh(cut_lineage(tb.place(latest_points(a, ["p_land"], counted=False))))
    ci = store.intervals("acc_area").select("run_id", "threshold", F.col("lo").alias("acc_lo"), F.col("hi").alias("acc_hi"))
    d = store.scores(STORED_METRICS).join(ci, ["run_id", "threshold"]).join(again.withColumn("rescored", F.lit(True)), "run_id", "left")
    return rounded(d.withColumn("rescored", F.coalesce("rescored", F.lit(False))))


QUERIES = {
    "rescored_runs": rescored_runs,
    "accuracy_leaderboard": accuracy_leaderboard,
    "acc_area": _metrics("acc_area"),
    "acc_unweighted": _metrics("acc_unweighted"),
    "acc_valid_only": _metrics("acc_valid_only"),
    "baseline_skill": _metrics("baseline_area", "skill", "land_share_true", "land_share_pred"),
    "land_prf_iou": _metrics("precision", "recall", "f1", "iou"),
    "brier_logloss": brier_logloss,
    "calibration_bins": calibration_bins,
    "ece": ece,
    "reliability_bins": reliability_bins,
    "is_probabilistic": is_probabilistic,
    "volume_latency": volume_latency,
    "cell_metrics": cell_metrics,
    "threshold_sweep": threshold_sweep,
    "point_flags": point_flags,
    "error_class": error_class,
    "error_breakdown": error_breakdown,
    "map_layer": map_layer,
    "infer_grid": infer_grid,
    "truncated_filter": truncated_filter,
    "low_mass_filter": low_mass_filter,
    "region_label": region_label,
    "nearest_anchor": nearest_anchor,
    "region_accuracy": region_accuracy,
    "region_heat": region_heat,
    "region_table": region_table,
    "repeat_spread": repeat_spread,
    "run_health": run_health,
    "latency_histogram": latency_histogram,
}
