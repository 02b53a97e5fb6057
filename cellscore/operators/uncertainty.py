"""Block bootstrap intervals, paired differences and ranks with ties."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscore.functions.common import flag, num, safe_div
from cellscore.functions.geo import block_id
from cellscore.session import cut_lineage

N_BOOT = 1000
REP_CHUNKS = 8
REPS_PER_TASK = 100


def block_sums(flags: DataFrame, block_deg: float = 10.0) -> DataFrame:
    """Numerator and denominator of the accuracy per (run, block): the state of a ratio statistic."""
    w = F.when(F.col("known"), F.col("w")).otherwise(F.lit(0.0))
    return flags.groupBy("run_id", block_id(F.col("lat"), F.col("lon"), block_deg).alias("block")).agg(
        F.sum(w * num(F.col("correct"))).alias("num"), F.sum(w).alias("den")
    )


def draw(rep: Column, pos: Column, n: Column, seed: int) -> Column:
    """Which of n blocks resample ``rep`` takes at place ``pos``: integer mixing modulo 2^31 - 1.

    The draw depends on nothing but its arguments, so lost tasks draw the same again, and all runs
    (and pairs) share one set of draws.
    """
    m = 2147483647

    def mix(h: Column, shift: int) -> Column:
        return h.bitwiseXOR(F.shiftright(h, shift))

    h = mix((rep.cast("bigint") * 48271 + F.lit((seed * 69621 + 12345) % m)) % m, 13)
    h = mix((h * 16807 + pos.cast("bigint") * 39373 + 977) % m, 15)
    h = mix((h * 48271) % m, 16)
    return (h % n.cast("bigint")).cast("int")


def drawn_places(rep: int, n: int, seed: int) -> np.ndarray:
    """``draw`` for all n places of one resample."""
    m = 2147483647
    h = (rep * 48271 + (seed * 69621 + 12345) % m) % m
    h = ((h ^ (h >> 13)) * 16807 + np.arange(n, dtype=np.int64) * 39373 + 977) % m
    h = (h ^ (h >> 15)) * 48271 % m
    return (h ^ (h >> 16)) % n


def bootstrap_ratio(
    blocks: DataFrame, keys: Sequence[str], n_boot: int = N_BOOT, seed: int = 0, alpha: float = 0.05
) -> DataFrame:
    """Percentile interval of sum(num)/sum(den) from resampling blocks with replacement.

    The blocks of a key (648 at most for 10 degree tiles) become one array row; resamples are
    spread over tasks in chunks and summed before they are shuffled, so a key sends n_boot rows.
    """
    keys = list(keys)
    arr = F.sort_array(F.collect_list(F.struct("block", "num", "den")))
    d = blocks.groupBy(*keys).agg(arr.alias("b"), F.sum("num").alias("_n"), F.sum("den").alias("_d"))
    est = safe_div(F.col("_n"), F.col("_d")).alias("est")
    d = d.select(
        *keys,
        est,
        F.transform("b", lambda x: x["num"]).alias("bn"),
        F.transform("b", lambda x: x["den"]).alias("bd"),
        F.size("b").alias("nb"),
    )
    size = -(-n_boot // REP_CHUNKS)
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(REP_CHUNKS - 1))).alias("_chunk")).repartition(
        parts, *keys, "_chunk"
    )
    reps = spread.select(
        "*",
        F.explode(
            F.sequence(F.col("_chunk") * size, F.least((F.col("_chunk") + 1) * size, F.lit(n_boot)) - 1)
        ).alias("rep"),
    )
    pos = reps.select(*keys, "est", "rep", "nb", "bn", "bd", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pos"))
    pick = draw(F.col("rep"), F.col("pos"), F.col("nb"), seed)
    boot = (
        pos.select(*keys, "est", "rep", "bn", "bd", pick.alias("k"))
        .groupBy(*keys, "est", "rep")
        .agg(F.sum(F.get("bn", F.col("k"))).alias("n"), F.sum(F.get("bd", F.col("k"))).alias("d"))
    )
    ratio = safe_div(F.col("n"), F.col("d"))
    ends = F.percentile(ratio, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))  # n_boot values a key
    out = boot.groupBy(*keys, "est").agg(ends.alias("_ci"))
    return out.select(*keys, "est", F.get("_ci", F.lit(0)).alias("lo"), F.get("_ci", F.lit(1)).alias("hi"))


def block_bootstrap_ci(flags: DataFrame, n_boot: int = N_BOOT, seed: int = 0, block_deg: float = 10.0) -> DataFrame:
    """Accuracy of every run with its block-bootstrap interval."""
    return bootstrap_ratio(block_sums(flags, block_deg), ["run_id"], n_boot, seed)


def bootstrap_any_stat(
    flags: DataFrame,
    stat: Callable[[pd.DataFrame], float],
    columns: Sequence[str],
    n_boot: int = N_BOOT,
    seed: int = 0,
    block_deg: float = 10.0,
) -> DataFrame:
    """The same resampling for any statistic of the rows.

    The rows of a run, which the grid bounds, go to ``ceil(n_boot / REPS_PER_TASK)`` tasks, each of which draws its
    resamples itself and repeats a row as often as its block was drawn.
    """
    d = flags.withColumn("_block", block_id(F.col("lat"), F.col("lon"), block_deg)).select("run_id", "_block", *columns)
    chunks = F.sequence(F.lit(0), F.lit((n_boot - 1) // REPS_PER_TASK))
    names = list(columns)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run, chunk = key
        _, at = np.unique(pdf["_block"].to_numpy(), return_inverse=True)
        n = int(at.max()) + 1
        reps = range(chunk * REPS_PER_TASK, min(n_boot, (chunk + 1) * REPS_PER_TASK))
        out = []
        for rep in reps:
            times = np.bincount(drawn_places(rep, n, seed), minlength=n)
            out.append(float(stat(pdf.loc[pdf.index.repeat(times[at]), names].reset_index(drop=True))))
        return pd.DataFrame({"run_id": run, "rep": list(reps), "stat": out})

    rows = d.withColumn("_chunk", F.explode(chunks))
    boot = rows.groupBy("run_id", "_chunk").applyInPandas(one, "run_id string, rep int, stat double")
    ok = F.when(~F.isnan("stat"), F.col("stat"))
    return boot.groupBy("run_id").agg(
        F.percentile(ok, F.lit(0.025)).alias("lo"), F.percentile(ok, F.lit(0.975)).alias("hi")
    )


def pair_rows(flags: DataFrame, pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the cells both runs of a pair have: columns end in _a and _b.

    ``pairs`` lists the pairs wanted (run_a, run_b). Run A is sent to its pairs, then joined on
    (run, cell), so no task sees a whole run.
    """
    a = flags.select(F.col("run_id").alias("run_a"), "idx", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = flags.select(F.col("run_id").alias("run_b"), "idx", *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.select("run_a", "run_b").join(a, "run_a").join(b, ["run_b", "idx"])


PAIR_COLUMNS = ("lat", "lon", "truth", "w", "known", "correct")


def paired_align(flags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: common cells, and cells whose place or known truth does not agree."""
    j = pair_rows(flags, pairs, PAIR_COLUMNS)
    off_grid = (F.abs(F.col("lat_a") - F.col("lat_b")) > 1e-6) | (F.abs(F.col("lon_a") - F.col("lon_b")) > 1e-6)
    other_truth = flag(F.col("truth_a") != F.col("truth_b"))
    return j.groupBy("run_a", "run_b").agg(
        F.count("*").alias("n_paired"),
        F.count(F.when(off_grid, 1)).alias("n_other_place"),
        F.count(F.when(other_truth, 1)).alias("n_other_truth"),
    )


def pair_block_sums(flags: DataFrame, pairs: DataFrame, block_deg: float = 10.0) -> DataFrame:
    j = pair_rows(flags, pairs, PAIR_COLUMNS)
    w = F.when(F.col("known_a") & F.col("known_b"), F.col("w_a")).otherwise(F.lit(0.0))
    bad = (
        (F.abs(F.col("lat_a") - F.col("lat_b")) > 1e-6)
        | (F.abs(F.col("lon_a") - F.col("lon_b")) > 1e-6)
        | flag(F.col("truth_a") != F.col("truth_b"))
    )
    ca, cb = num(F.col("correct_a")), num(F.col("correct_b"))
    return j.groupBy("run_a", "run_b", block_id(F.col("lat_a"), F.col("lon_a"), block_deg).alias("block")).agg(
        F.sum(w * (ca - cb)).alias("num"),
        F.sum(w).alias("den"),
        F.sum(w * ca).alias("sa"),
        F.sum(w * cb).alias("sb"),
        F.count("*").alias("n"),
        F.count(F.when(bad, 1)).alias("n_bad"),
    )


def paired_difference(flags: DataFrame, pairs: DataFrame, n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """Accuracy of A minus B on common cells of every listed pair, with a paired block interval.

    Pairs on different grids or truths get an error and no figures.
    """
    blocks = pair_block_sums(flags, pairs)
    keys = ["run_a", "run_b"]
    tot = blocks.groupBy(*keys).agg(
        F.sum("n").alias("n_paired"),
        F.sum("den").alias("_d"),
        F.sum("sa").alias("_a"),
        F.sum("sb").alias("_b"),
        F.sum("n_bad").alias("_bad"),
    )
    ci = bootstrap_ratio(blocks, keys, n_boot, seed)
    d = pairs.select(*keys).join(tot, keys, "left").join(ci, keys, "left")
    ok = flag(F.col("_bad") == 0)
    sig = flag(ok & ((F.col("lo") > 0) | (F.col("hi") < 0)))
    return d.select(
        *keys,
        F.when(ok, F.col("est")).alias("diff"),
        F.when(ok, F.col("lo")).alias("lo"),
        F.when(ok, F.col("hi")).alias("hi"),
        sig.alias("significant"),
        F.coalesce("n_paired", F.lit(0)).alias("n_paired"),
        F.when(ok, safe_div(F.col("_a"), F.col("_d"))).alias("acc_a"),
        F.when(ok, safe_div(F.col("_b"), F.col("_d"))).alias("acc_b"),
        F.when(F.col("_bad") > 0, F.lit("runs differ in grid or truth")).alias("error"),
    )


def pair_matrix(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair; the reverse negates the difference and swaps the ends."""
    back = pairs.select(
        F.col("run_b").alias("run_a"),
        F.col("run_a").alias("run_b"),
        (-F.col("diff")).alias("diff"),
        (-F.col("hi")).alias("lo"),
        (-F.col("lo")).alias("hi"),
        "significant",
        "n_paired",
        F.col("acc_b").alias("acc_a"),
        F.col("acc_a").alias("acc_b"),
        "error",
    )
    return pairs.select(*back.columns).unionByName(back)


def ranked_runs(scores: DataFrame) -> DataFrame:
    """Position of every run in its comparison: accuracy down, missing accuracy last, ties by run."""
    w = Window.partitionBy("comparison").orderBy(F.col("acc_area").desc_nulls_last(), "run_id")
    return scores.select("comparison", "run_id", "acc_area", F.row_number().over(w).alias("pos"))


def near_pairs(ranked: DataFrame, reach: int) -> DataFrame:
    """Pairs of runs at most ``reach`` positions apart: reach rows a run, not all pairs."""
    ok = ranked.where(F.col("acc_area").isNotNull())
    a = ok.select(
        "comparison",
        F.col("run_id").alias("run_a"),
        F.col("pos").alias("pos_a"),
        F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + reach)).alias("pos_b"),
    )
    b = ok.select("comparison", F.col("run_id").alias("run_b"), F.col("pos").alias("pos_b"))
    return a.join(b, ["comparison", "pos_b"])


def rank_with_ties(
    scores: DataFrame,
    compare: Callable[[DataFrame], DataFrame],
    reach: int = 16,
) -> DataFrame:
    """Ranks in which a run ties with its group leader unless their paired difference is significant.

    ``scores`` has (comparison, run_id, acc_area); ``compare`` turns (run_a, run_b) pairs into rows
    with ``significant`` and ``error``. For every run the first later run it does not tie with is
    looked up (``next``); the leaders are the runs reached from the top by following ``next``, found
    by doubling the jumps, so the number of rounds is the logarithm of the longest comparison.
    Only pairs up to ``reach`` positions apart are compared at first. Leaders whose group goes
    beyond that are compared with twice as many until no leader is left open.
    """
    ranked = ranked_runs(scores)
    ranked = cut_lineage(ranked)
    longest = ranked.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    counts = ranked.groupBy("comparison").agg(F.count("acc_area").alias("n_scored"))
    known = None
    todo = near_pairs(ranked, reach)
    while True:
        got = todo.join(compare(todo.select("run_a", "run_b").distinct()), ["run_a", "run_b"])
        apart = F.col("significant") | F.col("error").isNotNull()
        got = got.select("comparison", "pos_a", "pos_b", "run_a", "run_b", apart.alias("apart"))
        known = cut_lineage(got if known is None else known.unionByName(got))
        firsts = known.groupBy("comparison", F.col("pos_a").alias("pos")).agg(
            F.min(F.when(F.col("apart"), F.col("pos_b"))).alias("nxt"), F.max("pos_b").alias("seen")
        )
        nodes = (
            ranked.where(F.col("acc_area").isNotNull())
            .join(counts, "comparison")
            .join(firsts, ["comparison", "pos"], "left")
            .withColumn("open", F.col("nxt").isNull() & (F.coalesce("seen", F.col("pos")) < F.col("n_scored")))
        )
        leaders = _reachable(nodes.select("comparison", "pos", "nxt"), longest)
        open_ones = cut_lineage(
            nodes.where("open").join(leaders, ["comparison", "pos"], "left_semi").select("comparison", "run_id", "pos", "seen")
        )
        if not open_ones.head(1):
            break
        reach *= 2
        a = open_ones.select(
            "comparison",
            F.col("run_id").alias("run_a"),
            F.col("pos").alias("pos_a"),
            F.explode(F.sequence(F.col("seen") + 1, F.col("pos") + reach)).alias("pos_b"),
        )
        b = ranked.where(F.col("acc_area").isNotNull()).select(
            "comparison", F.col("run_id").alias("run_b"), F.col("pos").alias("pos_b")
        )
        todo = a.join(b, ["comparison", "pos_b"])
    d = ranked.join(leaders.withColumn("is_leader", F.lit(True)), ["comparison", "pos"], "left")
    w = Window.partitionBy("comparison").orderBy("pos")
    scored = F.col("acc_area").isNotNull()
    lead = F.when(scored, F.last(F.when(F.col("is_leader"), F.col("pos")), True).over(w)).otherwise(F.col("pos"))
    d = d.withColumn("rank", lead)
    size = F.count("*").over(Window.partitionBy("comparison", "rank"))
    return d.select("comparison", "run_id", "acc_area", "pos", "rank", (size > 1).alias("tied"))


def _reachable(nodes: DataFrame, longest: int) -> DataFrame:
    """Positions reached from position 1 by following ``nxt``, with doubled jumps."""
    jumps = nodes.where(F.col("nxt").isNotNull())
    reached = nodes.where(F.col("pos") == 1).select("comparison", "pos")
    span = 1
    while span < longest:
        step = reached.join(jumps, ["comparison", "pos"]).select("comparison", F.col("nxt").alias("pos"))
        reached = reached.unionByName(step).distinct()
        far = jumps.select("comparison", F.col("pos").alias("nxt"), F.col("nxt").alias("_far"))
        jumps = jumps.join(far, ["comparison", "nxt"]).select("comparison", "pos", F.col("_far").alias("nxt"))
        span *= 2
    return reached
