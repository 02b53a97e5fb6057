"""Comparisons of runs: disagreement, leaderboard, frontier, lineage, effort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscore.functions.common import count_if, flag, safe_div
from cellscore.operators.uncertainty import pair_rows

MAX_DIFF_RUNS = 16

# Fixed value: order of the effort levels; others come after these.
EFFORT_ORDER = ["default", "off", "none", "minimal", "low", "medium", "high", "xhigh", "max"]


def answer(prefix: str) -> Column:
    """1 land, 0 water, -1 invalid."""
    return F.when(F.col(f"valid_{prefix}"), F.col(f"pred_land_{prefix}").cast("int")).otherwise(F.lit(-1))


def disagreement_rows(flags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair and common cell: agreement class. Two invalid answers agree."""
    j = pair_rows(flags, pairs, ["lat", "truth", "valid", "pred_land"])
    truth = F.coalesce("truth_a", "truth_b")
    d = j.withColumn("aa", answer("a")).withColumn("ab", answer("b"))
    ok_a = flag((F.col("aa") >= 0) & (F.col("aa") == truth))
    ok_b = flag((F.col("ab") >= 0) & (F.col("ab") == truth))
    cls = (
        F.when((F.col("aa") == F.col("ab")) & (F.col("aa") == 1), F.lit("agree_land"))
        .when(F.col("aa") == F.col("ab"), F.lit("agree_water"))
        .when(ok_a & ~ok_b, F.lit("only_a"))
        .when(ok_b & ~ok_a, F.lit("only_b"))
        .otherwise(F.lit("neither"))
    )
    return d.select("run_a", "run_b", "idx", F.col("lat_a").alias("lat"), cls.alias("cell_class"))


def disagreement(rows: DataFrame) -> DataFrame:
    """Per pair: common cells, differing cells, area share of disagreement, cells only one has right."""
    w = F.cos(F.radians("lat"))
    differ = F.col("cell_class").isin("only_a", "only_b", "neither")
    return rows.groupBy("run_a", "run_b").agg(
        F.count("*").alias("n_both"),
        count_if(differ).alias("n_disagree"),
        safe_div(F.sum(F.when(differ, w).otherwise(0.0)), F.sum(w)).alias("share_disagree_area"),
        count_if(F.col("cell_class") == "only_a").alias("n_only_a"),
        count_if(F.col("cell_class") == "only_b").alias("n_only_b"),
    )


def report_pairs(ranked: DataFrame) -> DataFrame:
    """Each run of a comparison with its leader and with the next in rank: twice as many pairs as runs at most."""
    before = [F.struct(F.lit(1).alias("pos")), F.struct((F.col("pos") - 1).alias("pos"))]
    b = ranked.where("pos > 1").select("comparison", F.col("run_id").alias("run_b"), F.explode(F.array_distinct(F.array(*before))).alias("x"))
    a = ranked.select("comparison", F.col("run_id").alias("run_a"), F.col("pos"))
    return b.select("comparison", "run_b", F.col("x.pos").alias("pos")).join(a, ["comparison", "pos"]).select("comparison", "run_a", "run_b")


def top_pairs(ranked: DataFrame, max_runs: int = MAX_DIFF_RUNS) -> DataFrame:
    """All pairs of the best ``max_runs`` runs of a comparison (120 pairs for 16)."""
    top = ranked.where(F.col("pos") <= max_runs)
    a = top.select("comparison", F.col("run_id").alias("run_a"), F.col("pos").alias("pa"))
    b = top.select("comparison", F.col("run_id").alias("run_b"), F.col("pos").alias("pb"))
    return a.join(b, "comparison").where(F.col("pa") < F.col("pb")).select("comparison", "run_a", "run_b")


def pareto_frontier(runs: DataFrame, n_groups: int = 64) -> DataFrame:
    """Runs no other run beats on cost and accuracy; columns comparison, run_id, cost_usd, acc_area.

    Runs are thinned in hashed groups first; only the survivors of a group meet in the final pass.
    """
    d = runs.where(F.col("cost_usd").isNotNull() & F.col("acc_area").isNotNull())
    order = [F.col("cost_usd"), F.col("acc_area").desc(), F.col("run_id")]

    def keep(rows: DataFrame, *keys) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        best = F.max("acc_area").over(w)
        return rows.withColumn("_best", best).where(F.col("_best").isNull() | (F.col("acc_area") > F.col("_best"))).drop("_best")

    group = F.pmod(F.hash("run_id"), F.lit(n_groups))
    return keep(keep(d.withColumn("_g", group), "comparison", "_g").drop("_g"), "comparison")


def cost_vs_accuracy(runs: DataFrame) -> DataFrame:
    """Priced runs with frontier flag, interval half-widths in points and whether a log axis helps."""
    d = runs.where(F.col("cost_usd").isNotNull() & F.col("acc_area").isNotNull())
    front = pareto_frontier(runs).select("comparison", "run_id", F.lit(True).alias("on_frontier"))
    span = d.where(F.col("cost_usd") > 0).groupBy("comparison").agg(
        (F.max("cost_usd") / F.greatest(F.min("cost_usd"), F.lit(1e-9)) > 20).alias("log_axis")
    )
    half = lambda x: F.coalesce(F.greatest(F.lit(0.0), x * 100), F.lit(0.0))
    return (
        d.join(front, ["comparison", "run_id"], "left")
        .join(span, "comparison", "left")
        .select(
            "comparison",
            "run_id",
            "cost_usd",
            "acc_area",
            F.coalesce("on_frontier", F.lit(False)).alias("on_frontier"),
            half(F.col("hi") - F.col("acc_area")).alias("err_up"),
            half(F.col("acc_area") - F.col("lo")).alias("err_down"),
            F.coalesce("log_axis", F.lit(False)).alias("log_axis"),
        )
    )


def lineage(runs: DataFrame) -> DataFrame:
    """Best run per (vendor, model) of each comparison by release date; the earlier run wins a tie."""
    d = runs.where(F.col("release_date").isNotNull() & F.col("acc_area").isNotNull())
    best = d.groupBy("comparison", "vendor", "model_key").agg(
        F.min_by(F.struct("run_id", "acc_area", "release_date"), F.struct(-F.col("acc_area"), "run_id")).alias("b")
    )
    return best.select("comparison", "vendor", "model_key", "b.run_id", "b.acc_area", "b.release_date")


def effort_position(effort: Column) -> Column:
    p = F.array_position(F.array(*[F.lit(e) for e in EFFORT_ORDER]), effort)
    return F.when(p > 0, p - 1).otherwise(F.lit(len(EFFORT_ORDER))).cast("int")


def effort_curve(runs: DataFrame) -> DataFrame:
    """Mean accuracy and interval per (model, effort) of each comparison, for models with two efforts or more in it."""
    per = runs.groupBy("comparison", "model_key", "effort").agg(
        F.avg("acc_area").alias("acc"), F.avg("lo").alias("lo"), F.avg("hi").alias("hi"), F.count("*").alias("n_runs")
    )
    n = F.count("*").over(Window.partitionBy("comparison", "model_key"))
    d = per.withColumn("_n", n).where(F.col("_n") >= 2)
    return d.select("comparison", "model_key", "effort", effort_position(F.col("effort")).alias("position"), "acc", "lo", "hi", "n_runs")


def with_variant(runs: DataFrame) -> DataFrame:
    """model_key, config map, effort and label from the variant name ``model@key=value,...``."""
    model = F.trim(F.split_part("variant", F.lit("@"), F.lit(1)))
    rest = F.split_part("variant", F.lit("@"), F.lit(2))
    pairs = F.filter(F.split(rest, ","), lambda p: p.contains("="))
    kv = F.transform(
        pairs,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("value"),
        ),
    )
    label = F.when(F.col("repeat_idx") > 0, F.concat("variant", F.lit(" #"), (F.col("repeat_idx") + 1).cast("string")))
    return (
        runs.withColumn("model_key", model)
        .withColumn("config", F.map_from_entries(kv))
        .withColumn("effort", F.coalesce(F.try_element_at("config", F.lit("effort")), F.lit("default")))
        .withColumn("label", F.coalesce(label, F.col("variant")))
    )


def tie_pairs(ranks: DataFrame) -> DataFrame:
    """(comparison, run_a, run_b): each tied run with the leader of its rank, the run at whose position the rank begins."""
    first = ranks.where(F.col("pos") == F.col("rank")).select("comparison", "rank", F.col("run_id").alias("run_a"))
    tied = ranks.where(F.col("tied") & (F.col("pos") != F.col("rank"))).select("comparison", "rank", F.col("run_id").alias("run_b"))
    return tied.join(first, ["comparison", "rank"]).select("comparison", "run_a", "run_b")


def tie_notes(ranks: DataFrame, differences: DataFrame, runs: DataFrame) -> DataFrame:
    """comparison, run_id, tie_note, tie_with (label of the leader), tie_diff, tie_lo, tie_hi of the tied runs.

    ``differences`` has the paired differences of ``tie_pairs`` (leader less run); they are given as run less leader.
    """
    name = runs.select(F.col("run_id").alias("run_a"), F.col("label").alias("tie_with"))
    d = tie_pairs(ranks).join(differences, ["run_a", "run_b"], "left").join(name, "run_a")
    note = F.when(F.col("error").isNotNull(), F.concat(F.lit("no paired comparison with the leader: "), "error")).otherwise(F.lit("the interval of the difference to the leader includes 0"))
    behind = d.select("comparison", F.col("run_b").alias("run_id"), note.alias("tie_note"), "tie_with", (-F.col("diff")).alias("tie_diff"), (-F.col("hi")).alias("tie_lo"), (-F.col("lo")).alias("tie_hi"))
    lead = ranks.where(F.col("tied") & (F.col("pos") == F.col("rank"))).select("comparison", "run_id", F.lit("leads runs whose difference to it has an interval that includes 0").alias("tie_note"))
    return behind.unionByName(lead, allowMissingColumns=True)


def comparison_check(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Per comparison: what makes it unfair, with the names of the runs. ``members`` has (comparison, run_id), ``runs`` (run_id, label,
    spec_id, extraction_mode, status, thinking, forced_thinking, n_done, n_total).

    Runs of several specs cannot be compared, so such a comparison is refused. A run is unfinished by its status, or if it
    has fewer points than it should.
    """
    d = members.select("comparison", "run_id").join(runs, "run_id")
    partial = (F.col("status") != "complete") | (F.coalesce("n_done", F.lit(0)) < F.col("n_total"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ", ")
    agg = d.groupBy("comparison").agg(
        F.countDistinct("spec_id").alias("_specs"),
        listed("spec_id").alias("specs"),
        (F.countDistinct("extraction_mode") > 1).alias("mixed_modes"),
        F.sum(partial.cast("bigint")).alias("n_partial"),
        listed(F.when(F.col("status") != "complete", F.col("label"))).alias("_open"),
        F.sum(F.col("forced_thinking").cast("bigint")).alias("n_forced"),
        listed(F.when(F.col("forced_thinking"), F.col("label"))).alias("_forced"),
        (F.max("thinking") & ~F.min("thinking")).alias("mixed_thinking"),
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("mixed_modes"), F.lit("modes differ, so ranks use accuracy alone")),
            F.when(F.col("_open") != "", F.concat(F.lit("not complete: "), "_open")),
            F.when(F.col("n_partial") > 0, F.lit("some runs are unfinished and count with what they have")),
            F.when(F.col("n_forced") > 0, F.concat(F.lit("thinking forced on: "), "_forced")),
            F.when(F.col("mixed_thinking"), F.lit("only part of the runs think")),
        )
    )
    return agg.select(
        "comparison", F.when(F.col("_specs") > 1, F.concat(F.lit("runs of several specs: "), "specs")).alias("refused"), "mixed_modes", "n_partial", "n_forced", "mixed_thinking",
        F.when(F.col("mixed_modes"), F.lit("acc_area")).alias("rank_on"), F.array_join(notes, "; ").alias("warnings"),
    )


def leaderboard_order() -> list[Column]:
    """By comparison, rank, and accuracy within a rank."""
    return [F.col("comparison"), F.col("rank"), F.col("acc_area").desc_nulls_last(), F.col("run_id")]


def leaderboard_filters(
    rows: DataFrame, vendors: Sequence[str] | None = None, models: Sequence[str] | None = None, efforts: Sequence[str] | None = None,
    modes: Sequence[str] | None = None, thinking: bool | None = None, forced_thinking: bool | None = None, max_cost: float | None = None, priced: bool | None = None, text: str | None = None,
) -> DataFrame:
    """Leaderboard rows that fulfil all given filters. ``text`` is looked for in labels and vendors, whatever its case; a
    limit of cost leaves out runs without price."""
    for name, some in (("vendor", vendors), ("model_key", models), ("effort", efforts), ("extraction_mode", modes)):
        if some is not None:
            rows = rows.where(F.col(name).isin(list(some)))
    for name, want in (("thinking", thinking), ("forced_thinking", forced_thinking)):
        if want is not None:
            rows = rows.where(F.coalesce(F.col(name), F.lit(False)) == want)
    if priced is not None:
        rows = rows.where(F.col("cost_usd").isNotNull() == priced)
    if max_cost is not None:
        rows = rows.where(F.col("cost_usd") <= max_cost)
    if text is not None:
        rows = rows.where(F.lower(F.concat_ws(" ", "label", "vendor")).contains(text.lower()))
    return rows


def leaderboard(ranks: DataFrame, metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Rank label (``=1`` when tied), scores, cost and counts per run of a comparison.

    Brier and ECE only for probabilistic runs, and never where extraction modes are mixed.
    """
    mixed = (
        ranks.select("comparison", "run_id")
        .join(runs.select("run_id", "extraction_mode"), "run_id")
        .groupBy("comparison")
        .agg((F.countDistinct("extraction_mode") > 1).alias("mixed_modes"))
    )
    d = ranks.drop("acc_area").join(metrics, "run_id").join(runs, "run_id").join(mixed, "comparison")
    shown = F.col("probabilistic") & ~F.col("mixed_modes")
    label = F.when(F.col("tied"), F.concat(F.lit("="), F.col("rank").cast("string"))).otherwise(F.col("rank").cast("string"))
    return d.withColumns(
        {
            "rank_label": label,
            "brier": F.when(shown, F.col("brier")),
            "ece": F.when(shown, F.col("ece")),
        }
    )
