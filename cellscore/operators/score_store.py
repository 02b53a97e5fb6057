"""Stored scores that are brought up to date run by run.

What is kept is not the scores but their additive state: for each run, threshold and block of the globe the sums that all
metrics are made of, and numerator and denominator of any ratio statistic. States of blocks add up to the scores of a run, and
are what its bootstrap interval resamples. A run is scored again when its points are others than those its state was
made of (by number and content); the points of all other runs are not read into any score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions.common import num
from cellscore.functions.geo import block_id
from cellscore.operators import score as sc
from cellscore.operators.uncertainty import bootstrap_ratio
from cellscore.session import cut_lineage
from cellscore.streaming.upsert import UpsertTable

def ratios() -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator of ratio statistics, over the columns of ``score.point_flags``."""
    known, right = num(F.col("known")), num(F.col("correct"))
    return {"acc_area": (F.col("w") * known * right, F.col("w") * known), "acc_unweighted": (known * right, known)}


class ScoreStore:
    """States of all runs at some thresholds, under ``path`` in the shared folder."""

    def __init__(self, spark: SparkSession, path: str, thresholds: Sequence[float] = (0.5,), statistics: dict[str, tuple[Column, Column]] | None = None, block_deg: float = 10.0, buckets: int = 16):
        self.thresholds, self.statistics, self.block_deg = thresholds, ratios() if statistics is None else statistics, block_deg
        keys = ["run_id", "threshold", "block"]
        self.states = UpsertTable(spark, f"{path}/states", keys, lambda d: newest(d, keys), buckets)
        self.marks = UpsertTable(spark, f"{path}/marks", ["run_id"], lambda d: newest(d, ["run_id"]), 1)

    def stale(self, points: DataFrame) -> DataFrame:
        """Runs (run_id, n_points, digest) whose points are not those of the stored states."""
        row = F.xxhash64("idx", "p_land", "truth", "weight", "lat", "lon")
        now = points.groupBy("run_id").agg(F.count("*").alias("n_points"), F.bit_xor(row).alias("digest"))
        held = self.marks.read()
        if held is None:
            return now
        same = held.select("run_id", "n_points", "digest")
        return now.join(same, ["run_id", "n_points", "digest"], "left_anti")

    def block_states(self, points: DataFrame) -> DataFrame:
        each = points.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in self.thresholds])))
        f = sc.point_flags(each, F.col("threshold"))
        sums = [c.alias(n) for n, c in sc.metric_sums().items()]
        sums += [F.sum(part).alias(f"{n}_{side}") for n, pair in self.statistics.items() for part, side in zip(pair, ("num", "den"))]
        return f.groupBy("run_id", "threshold", block_id(F.col("lat"), F.col("lon"), self.block_deg).alias("block")).agg(*sums)

    def refresh(self, points: DataFrame) -> DataFrame:
        """Score the stale runs of ``points`` (run_id, idx, lat, lon, weight, truth, p_land); returns them (run_id)."""
        version = self.marks.last_epoch() + 1
        stale = cut_lineage(self.stale(points))
        own = points.join(stale.select("run_id"), "run_id", "left_semi")
        self.states.merge(self.block_states(own).withColumn("version", F.lit(version)), version)
        self.marks.merge(stale.withColumn("version", F.lit(version)), version)  # last: a refresh that broke off is done again
        return stale.select("run_id")

    def current(self) -> DataFrame:
        """The states of each run's last scoring (blocks that it had before and has no more are left out)."""
        return self.states.read().join(self.marks.read().select("run_id", "version"), ["run_id", "version"], "left_semi")

    def scores(self, names: Sequence[str] = ()) -> DataFrame:
        """run_id, threshold and the named metrics (all, if none is named), from the states alone."""
        cols, sums = sc.metric_columns(), list(sc.metric_sums())
        total = self.current().groupBy("run_id", "threshold").agg(*[F.sum(n).alias(n) for n in sums])
        return total.select("run_id", "threshold", *[cols[n].alias(n) if n in cols else F.col(n) for n in names or cols])

    def intervals(self, name: str, **how) -> DataFrame:
        """run_id, threshold, est, lo, hi of a ratio statistic."""
        blocks = self.current().select("run_id", "threshold", "block", F.col(f"{name}_num").alias("num"), F.col(f"{name}_den").alias("den"))
        return bootstrap_ratio(blocks, ["run_id", "threshold"], **how)


def newest(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in d.columns if c not in (*keys, "version", "_b")]
    last = d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_x"), F.max("version").alias("version"))
    return last.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest], "version")
