"""Rasters as runs (c0 to c1 of a row), compared by sweeping over the runs' ends.

Nothing here makes a row per pixel: an image of 8e8 pixels with a coast of some million runs stays some million rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscore.functions import geo


def value_runs(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Runs (keys, r, c0, c1, value) of equal ``value`` among the cells (keys, r, c) there are."""
    w = Window.partitionBy(*keys, "r", value).orderBy("c")
    d = cells.select(*keys, "r", "c", value).withColumn("_g", F.col("c") - F.row_number().over(w))
    return d.groupBy(*keys, "r", value, "_g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("_g")


def merged(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of each key united where they overlap or touch."""
    w = Window.partitionBy(*keys).orderBy("c0", "c1")
    reach = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = runs.select(*keys, "c0", "c1", F.coalesce(F.col("c0") > reach + 1, F.lit(True)).cast("int").alias("_new"))
    d = d.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_g").agg(F.min("c0").cast("int").alias("c0"), F.max("c1").cast("int").alias("c1")).drop("_g")


def states(parts: dict[str, DataFrame], keys: Sequence[str], whole: DataFrame | None = None) -> DataFrame:
    """Stretches (keys, c0, c1) with a flag for each of ``parts`` (keys, c0, c1): does one of its runs cover the stretch.

    With ``whole`` (keys, c0, c1) its stretches are covered from end to end, also where no part is.
    """
    names = list(parts)

    def ends(df: DataFrame, name: str | None) -> DataFrame:
        at = F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("d")), F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("d")))
        d = df.select(*keys, F.explode(at).alias("e"))
        return d.select(*keys, F.col("e.at").alias("at"), *[(F.col("e.d") if n == name else F.lit(0)).alias(n) for n in names])

    every = [ends(df, n) for n, df in parts.items()] + ([] if whole is None else [ends(whole, None)])
    d = every[0]
    for more in every[1:]:
        d = d.unionByName(more)
    d = d.groupBy(*keys, "at").agg(*[F.sum(n).alias(n) for n in names])
    w = Window.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(*keys, F.col("at").alias("c0"), (F.lead("at").over(w) - 1).alias("c1"), *[(F.sum(n).over(upto) > 0).alias(n) for n in names])
    return d.where("c1 >= c0")


def length() -> Column:
    return F.col("c1") - F.col("c0") + 1


def pixels(runs: DataFrame) -> DataFrame:
    keep = [c for c in runs.columns if c not in ("c0", "c1")]
    return runs.select(*keep, F.explode(F.sequence("c0", "c1")).alias("c"))


def _shown(n_out: int, extent: float, step: float, off: float) -> np.ndarray:
    """The source index that each output pixel shows (columns: not yet wrapped)."""
    return np.floor((np.arange(n_out) + 0.5) * (extent / n_out) / step - off + 0.5).astype(np.int64)


def _at(values: Sequence[int], i: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), i.cast("int"))


def render_runs(land: DataFrame, keys: Sequence[str], step: float, shape: tuple[int, int], placement: str = geo.CELL_CENTER) -> DataFrame:
    """Land runs (keys, r, c0, c1) of a grid on the pixels nearest to them: rows are repeated, ends are moved."""
    (h, w), (n_r, n_c), off = shape, geo.grid_dims(step), geo.half_cell(placement)
    rows = np.clip(_shown(h, 180.0, step, off), 0, n_r - 1)
    cols = _shown(w, 360.0, step, off)
    low, high = int(cols.min()), int(cols.max())
    source = np.arange(low, high + 1)
    first, last = np.searchsorted(cols, source), np.searchsorted(cols, source, "right") - 1
    laps = range(math.floor(low / n_c), math.floor(high / n_c) + 1)
    d = land.withColumn("_lap", F.explode(F.array(*[F.lit(k * n_c) for k in laps])))
    d = d.withColumn("c0", F.greatest(F.col("c0") + F.col("_lap"), F.lit(low))).withColumn("c1", F.least(F.col("c1") + F.col("_lap"), F.lit(high)))
    d = d.where("c0 <= c1").withColumn("c0", _at(first, F.col("c0") - low)).withColumn("c1", _at(last, F.col("c1") - low)).where("c0 <= c1")
    top, end = np.searchsorted(rows, np.arange(n_r)), np.searchsorted(rows, np.arange(n_r), "right") - 1
    d = d.withColumn("_r0", _at(top, F.col("r"))).withColumn("_r1", _at(end, F.col("r"))).where("_r0 <= _r1")
    return merged(d.withColumn("r", F.explode(F.sequence("_r0", "_r1"))), [*keys, "r"])


def boundary_runs(land: DataFrame, keys: Sequence[str], shape: tuple[int | None, int], known: DataFrame | None = None) -> DataFrame:
    """Runs (keys, r, value, c0, c1) of the cells that differ from a 4-neighbour; longitude wraps, latitude does not.

    Each row is swept together with the row below it and with itself moved east by one column. Without ``known``
    (runs of the cells that count) every cell of the shape counts; with it the number of rows may be None.
    """
    (h, w), keys = shape, list(keys)
    below = F.array(F.struct(F.lit("v").alias("k"), F.col("r").alias("p"), F.lit(0).alias("s")), F.struct(F.lit("v").alias("k"), (F.col("r") - 1).alias("p"), F.lit(1).alias("s")))
    beside = F.array(F.struct(F.lit("h").alias("k"), F.col("r").alias("p"), F.lit(0).alias("s")), F.struct(F.lit("h").alias("k"), F.col("r").alias("p"), F.lit(1).alias("s")))
    both = F.concat(below, beside) if w > 1 else below

    def sides(df: DataFrame, name: str) -> dict[str, DataFrame]:
        d = df.select(*keys, "r", "c0", "c1", F.explode(both).alias("x")).select(*keys, "x.*", "c0", "c1")
        d = d.where("p >= 0" if h is None else f"p >= 0 and (k = 'h' or p < {h - 1})")
        moved = (F.col("k") == "h") & (F.col("s") == 1)
        shifted = F.array(F.struct((F.col("c0") + 1).alias("c0"), F.least(F.col("c1") + 1, F.lit(w - 1)).alias("c1")), F.struct(F.lit(0).alias("c0"), (F.col("c1") + 1 - w).alias("c1")))
        parts = F.when(moved, shifted).otherwise(F.array(F.struct("c0", "c1")))
        d = d.withColumn("y", F.explode(parts)).select(*keys, "k", "p", "s", "y.c0", "y.c1").where("c0 <= c1")
        return {f"{name}{s}": d.where(F.col("s") == s).drop("s") for s in (0, 1)}

    found = states(sides(land, "land") | ({} if known is None else sides(known, "known")), [*keys, "k", "p"])
    found = found.where("land0 <> land1" if known is None else "land0 <> land1 and known0 and known1")
    other = F.when(F.col("k") == "v", F.array(F.struct("c0", "c1"))).otherwise(
        F.array(F.struct(F.greatest(F.col("c0") - 1, F.lit(0)).alias("c0"), (F.col("c1") - 1).alias("c1")), F.struct(F.lit(w - 1).alias("c0"), F.when(F.col("c0") == 0, F.lit(w - 1)).otherwise(F.lit(0)).alias("c1")))
    )
    mine = found.select(*keys, F.col("p").alias("r"), F.col("land0").alias("value"), "c0", "c1")
    theirs = found.select(*keys, F.when(F.col("k") == "v", F.col("p") + 1).otherwise(F.col("p")).alias("r"), F.col("land1").alias("value"), F.explode(other).alias("x"))
    theirs = theirs.select(*keys, "r", "value", "x.c0", "x.c1").where("c0 <= c1")
    return merged(mine.unionByName(theirs), [*keys, "r", "value"])


def region_cuts(shape: tuple[int, int], rules: Sequence[tuple[str, str]] = geo.LAND_RULES, anchors=geo.ANCHORS) -> "callable":
    """A function of an array of rows that gives for each row the columns where the region may change.

    The rules compare longitudes with constants (or, on two lines, with a linear function of latitude), and the anchors'
    nearness is equal along two longitudes of a row for each pair. A column is cut on both sides of each such longitude, so that
    every piece lies wholly on one side; cutting too often is harmless.
    """
    import re

    h, w = shape
    text = " ".join(t for _, t in rules)
    plain = {float(x) for x in re.findall(r"lon [<>]=? (-?[0-9.]+)(?! ?[-+*])", text)} | {float(x) for pair in re.findall(r"lon between (-?[0-9.]+) and (-?[0-9.]+)", text) for x in pair}
    lines = [tuple(map(float, re.sub("e0", "", "|".join(m)).split("|"))) for m in re.findall(r"lon > (-?[0-9.e]+) \+ \((-?[0-9.e]+) - lat\) \* (-?[0-9.e]+)", text)]
    place = [(math.radians(a), math.radians(b)) for a, b, _ in anchors]

    def cuts(r: np.ndarray) -> list[np.ndarray]:
        lat = 90.0 - (r + 0.5) * (180.0 / h)
        out = [np.full(len(r), x) for x in sorted(plain)] + [x + (y - lat) * k for x, y, k in lines]
        sin, cos = np.sin(np.radians(lat)), np.cos(np.radians(lat))
        for i, (a, b) in enumerate(place):
            for c, d in place[i + 1 :]:
                x, y = cos * (math.cos(a) * math.cos(b) - math.cos(c) * math.cos(d)), cos * (math.cos(a) * math.sin(b) - math.cos(c) * math.sin(d))
                far, size = sin * (math.sin(c) - math.sin(a)), np.hypot(x, y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    turn = np.arccos(far / size)  # NaN where one anchor is nearer all along the row
                for s in (-1, 1):
                    out.append(np.degrees(np.arctan2(y, x) + s * turn))
        lon = np.stack(out)
        at = np.floor(np.mod(lon + 180.0, 360.0) / (360.0 / w) - 0.5)  # the last pixel whose center is not east of it
        found = []
        for k in range(len(r)):
            c = at[:, k][~np.isnan(at[:, k])].astype(np.int64)
            c = np.unique(np.concatenate((c, c + 1, c + 2)))
            found.append(c[(c > 0) & (c < w)].astype(np.int32))
        return found

    return cuts


def region_pieces(land: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Land runs cut where a region's rule changes, with ``continent``: each piece has the label of its first pixel."""
    h, w = shape
    spark, cuts = land.sparkSession, region_cuts(shape)

    def of_rows(frames):
        for pdf in frames:
            pdf["cuts"] = [c.tolist() for c in cuts(pdf["r"].to_numpy())]
            yield pdf

    rows = spark.range(h).select(F.col("id").cast("int").alias("r")).mapInPandas(of_rows, "r int, cuts array<int>")
    d = land.join(rows, "r")
    inside = F.filter("cuts", lambda x: (x > F.col("c0")) & (x <= F.col("c1")))
    d = d.withColumn("_s", F.concat(F.array("c0"), inside)).drop("cuts")
    d = d.withColumn("_x", F.explode(F.arrays_zip("_s", F.concat(F.transform(F.slice("_s", 2, F.size("_s")), lambda x: x - 1), F.array("c1")).alias("_e"))))
    d = d.withColumn("c0", F.col("_x._s")).withColumn("c1", F.col("_x._e")).drop("_s", "_x")
    d = d.withColumn("lat", geo.pixel_lat(F.col("r"), h)).withColumn("lon", geo.pixel_lon(F.col("c0"), w))
    return geo.with_continent(d).drop("lon")


def lon_sums(w: int) -> tuple[Column, Column]:
    """Sums of the sines and of the cosines of the longitudes of a run's pixels, in closed form."""
    n, half = length(), math.pi / w
    middle = F.radians(geo.pixel_lon((F.col("c0") + F.col("c1")) / 2, w))
    size = F.sin(n * half) / math.sin(half)
    return F.sin(middle) * size, F.cos(middle) * size
