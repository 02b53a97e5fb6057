"""Intervals, paired comparisons, ranks and the report tables that follow from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions.common import rounded
from cellscore.operators import compare as cp
from cellscore.operators import score as sc
from cellscore.operators import uncertainty as un
from cellscore.plans.scoring import flags, kept_flags, kept_points
from cellscore.session import cut_lineage
from cellscore.sources import testbed as tb


def scores(spark: SparkSession, sf: str, f: DataFrame | None = None) -> DataFrame:
    """comparison, run_id, acc_area for every member of every comparison."""
    acc = sc.metrics_by(flags(spark, sf) if f is None else f, ["run_id"], ["acc_area"])
    return tb.comparison_runs(spark).join(acc, "run_id", "left")


def report_pairs(spark: SparkSession, sf: str, f: DataFrame | None = None) -> DataFrame:
    """Of every comparison the pairs that its report shows; a pair of several comparisons comes once."""
    return cp.report_pairs(un.ranked_runs(scores(spark, sf, f))).select("run_a", "run_b").distinct()


def run_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per comparison member: accuracy, interval, cost, variant fields."""
    ci = un.block_bootstrap_ci(flags(spark, sf)).withColumnRenamed("est", "acc_area")
    d = tb.comparison_runs(spark).join(ci, "run_id", "left").join(tb.run_costs(spark, sf), "run_id", "left")
    return cp.with_variant(d.join(tb.runs(spark), "run_id"))


def block_sums(spark, sf):
    return rounded(un.block_sums(flags(spark, sf)))


def block_bootstrap_ci(spark, sf):
    return rounded(un.block_bootstrap_ci(flags(spark, sf)))


def _weighted_accuracy(rows) -> float:
    den = float(rows["w"].sum())
    return float((rows["w"] * rows["correct"]).sum() / den) if den > 0 else float("nan")


def bootstrap_any_stat(spark, sf):
    f = flags(spark, sf).where("known")
    return rounded(un.bootstrap_any_stat(f, _weighted_accuracy, ["w", "correct"]))


def _median_confidence(rows) -> float:
    p = rows["p_land"].dropna().to_numpy()
    return float(np.median(np.abs(p - 0.5))) if p.size else float("nan")


def bootstrap_median_confidence(spark, sf):
    return rounded(un.bootstrap_any_stat(flags(spark, sf), _median_confidence, ["p_land"]))


def paired_align(spark, sf):
    f = kept_flags(spark, sf)
    return un.paired_align(f, report_pairs(spark, sf, f))


def paired_difference(spark, sf):
    f = kept_flags(spark, sf)
    d = un.paired_difference(f, report_pairs(spark, sf, f))
    return rounded(d.drop("error"))


def pair_matrix(spark, sf):
    f = kept_flags(spark, sf)
    d = un.pair_matrix(un.paired_difference(f, report_pairs(spark, sf, f)))
    return rounded(d.drop("error"))


def _ranks(spark, sf, f=None):
    f = kept_flags(spark, sf) if f is None else f
    return un.rank_with_ties(scores(spark, sf, f), lambda p: un.paired_difference(f, p))


def rank_with_ties(spark, sf):
    return rounded(_ranks(spark, sf).select("comparison", "run_id", "acc_area", "rank", "tied"))


def leaderboard(spark, sf):
    p = kept_points(spark, sf, "n_samples", "latency_s", "input_tokens", "output_tokens", "thinking_tokens")
    ci = un.block_bootstrap_ci(sc.point_flags(p)).select("run_id", "lo", "hi")
    m = sc.cell_metrics(p, tb.runs(spark)).join(ci, "run_id").join(tb.run_costs(spark, sf), "run_id", "left")
    ranks, runs = cut_lineage(_ranks(spark, sf, sc.point_flags(p))), cp.with_variant(tb.runs(spark))
    pairs = cp.tie_pairs(ranks).select("run_a", "run_b").distinct()
    notes = cp.tie_notes(ranks, un.paired_difference(sc.point_flags(p), pairs), runs)
    d = cp.leaderboard(ranks, m, runs).join(notes, ["comparison", "run_id"], "left")
    return rounded(
        d.select(
            "comparison", "run_id", "label", "vendor", "rank", "rank_label", "tie_note", "tie_with", "tie_diff", "tie_lo", "tie_hi", "acc_area", "lo", "hi", "acc_valid_only",
            "skill", "f1", "invalid_rate", "brier", "ece", "cost_usd", "latency_p50", "latency_p95",
            F.col("n_points").alias("n_done"), F.lit(tb.N_CELLS).alias("n_total"),
        )
    ).orderBy(*cp.leaderboard_order())


def leaderboard_filters(spark, sf):
    """Leaderboard rows of vendors v0 to v2 that think, in sampling mode, without forced thinking."""
    d = cp.leaderboard_filters(run_scores(spark, sf), vendors=["v0", "v1", "v2"], modes=["sample"], thinking=True, forced_thinking=False)
    return rounded(d.select("comparison", "run_id", "label", "vendor", "acc_area", "cost_usd"))


def diff_pairs_topk(spark, sf):
    f = kept_flags(spark, sf)
    pairs = cp.top_pairs(un.ranked_runs(scores(spark, sf, f))).select("run_a", "run_b").distinct()
    stats = cp.disagreement(cp.disagreement_rows(f, pairs))
    d = un.paired_difference(f, pairs).drop("error").join(stats, ["run_a", "run_b"], "left")
    return rounded(d.drop("acc_a", "acc_b"))


def disagreement(spark, sf):
    f = kept_flags(spark, sf)
    return rounded(cp.disagreement(cp.disagreement_rows(f, report_pairs(spark, sf, f))))


def disagreement_map(spark, sf):
    f = kept_flags(spark, sf)
    rows = cp.disagreement_rows(f, report_pairs(spark, sf, f))
    return rows.select("run_a", "run_b", "idx", "cell_class")


def points_common(spark, sf):
    f = kept_flags(spark, sf)
    return un.pair_rows(f, report_pairs(spark, sf, f), []).select("run_a", "run_b", "idx")


def pareto_frontier(spark, sf):
    return rounded(cp.pareto_frontier(run_scores(spark, sf)).select("comparison", "run_id", "cost_usd", "acc_area"))


def cost_vs_accuracy(spark, sf):
    return rounded(cp.cost_vs_accuracy(run_scores(spark, sf)))


def lineage(spark, sf):
    return rounded(cp.lineage(run_scores(spark, sf)))


def effort_curve(spark, sf):
    return rounded(cp.effort_curve(run_scores(spark, sf)))


QUERIES = {
    "block_sums": block_sums,
    "block_bootstrap_ci": block_bootstrap_ci,
    "bootstrap_any_stat": bootstrap_any_stat,
    "bootstrap_median_confidence": bootstrap_median_confidence,
    "paired_align": paired_align,
    "paired_difference": paired_difference,
    "pair_matrix": pair_matrix,
    "rank_with_ties": rank_with_ties,
    "leaderboard": leaderboard,
    "leaderboard_filters": leaderboard_filters,
    "diff_pairs_topk": diff_pairs_topk,
    "disagreement": disagreement,
    "disagreement_map": disagreement_map,
    "points_common": points_common,
    "pareto_frontier": pareto_frontier,
    "cost_vs_accuracy": cost_vs_accuracy,
    "lineage": lineage,
    "effort_curve": effort_curve,
}
