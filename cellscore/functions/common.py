"""Helpers used by several operators: guarded ratios, exact quantiles, ranks and running sums.

The three plan helpers replace the plain ``percentile`` / ``row_number`` / running ``sum`` where a
single key may hold a large part of all rows: they split every key into value buckets, total the
buckets, and only look inside the bucket that is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL unless den > 0."""
    return F.when(den > 0, num / den)


def flag(cond: Column) -> Column:
    """A condition with NULL read as false."""
    return F.coalesce(cond, F.lit(False))


def has_number(name: str) -> Column:
    """Neither NULL nor NaN (Spark's isnan is false for NULL)."""
    return F.col(name).isNotNull() & ~F.isnan(name)


def num(cond: Column) -> Column:
    """1.0 where the condition holds, else 0.0."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (sums differ in the last places by the order of addition)."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 1000,
) -> DataFrame:
    """Exact quantiles (linear interpolation) per key without sorting a whole key in one task.

    A first pass brackets each wanted rank with ``percentile_approx``, whose rank error is at most
    n / accuracy. In the second pass every value below its bracket is only counted; values inside
    (a few per mille of the key) are ranked. Equal values are combined before any shuffle.
    """
    keys = list(keys)
    eps = 2.0 / accuracy
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ask = []
    for p in probs.values():
        ask += [max(0.0, p - eps), min(1.0, p + eps)]
    bracket = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", ask, accuracy).alias("_b"),
    )
    hist = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_m"))
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos"),
                (F.col("_min") if p - eps <= 0 else F.col("_b")[2 * i]).alias("lo"),
                (F.col("_max") if p + eps >= 1 else F.col("_b")[2 * i + 1]).alias("hi"),
            )
            for i, (name, p) in enumerate(probs.items())
        ]
    )
    sides = bracket.select(*keys, F.explode(wanted).alias("_w"))
    joined = hist.join(sides, keys) if keys else hist.crossJoin(F.broadcast(sides))
    near = (
        joined.where(F.col("_v") <= F.col("_w.hi"))
        .withColumn("_below", F.col("_v") < F.col("_w.lo"))
        .groupBy(
            *keys,
            F.col("_w.name").alias("_name"),
            F.col("_w.pos").alias("_pos"),
            "_below",
            F.when(~F.col("_below"), F.col("_v")).alias("_v"),
        )
        .agg(F.sum("_m").alias("_m"))
    )
    w = Window.partitionBy(*keys, "_name").orderBy(F.col("_below").desc(), "_v")
    ranked = near.withColumn("_end", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.floor("_pos"), F.ceil("_pos")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_m") <= rank), F.col("_v")))

    found = ranked.groupBy(*keys, "_name").agg(
        at(first).alias("_lo"), at(last).alias("_hi"), (F.max("_pos") - F.floor(F.max("_pos"))).alias("_f")
    )
    val = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, val)).alias(name) for name in probs]
    )


def bucketed_rank(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """1-based rank per key; ``bucket`` is monotone in ``order`` and splits a key over many tasks."""
    keys = list(keys)
    d = df.withColumn("_bkt", bucket)
    sizes = d.groupBy(*keys, "_bkt").agg(F.count("*").alias("_cnt"))
    before = sizes.select(
        *keys,
        "_bkt",
        F.coalesce(
            F.sum("_cnt").over(
                Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_off"),
    )
    rn = F.row_number().over(Window.partitionBy(*keys, "_bkt").orderBy(*order))
    out = d.withColumn("_rn", rn).join(before, [*keys, "_bkt"])
    return out.withColumn(name, F.col("_off") + F.col("_rn")).drop("_bkt", "_off", "_rn")


def bucketed_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Running sums before each row (row excluded) per key, with buckets as in ``bucketed_rank``."""
    keys = list(keys)
    d = df.withColumn("_bkt", bucket)
    for name, col in sums.items():
        d = d.withColumn(f"_x_{name}", col)
    totals = d.groupBy(*keys, "_bkt").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    outer = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_bkt", *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inner = (
        Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = d
    for n in sums:
        out = out.withColumn(f"_i_{n}", F.coalesce(F.sum(f"_x_{n}").over(inner), F.lit(0)))
    out = out.join(before, [*keys, "_bkt"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.col(f"_i_{n}"))
    drop = ["_bkt"] + [f"_{k}_{n}" for k in "xoi" for n in sums]
    return out.drop(*drop)
