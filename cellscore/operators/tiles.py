"""Rasters as tiles: bands of image rows held as arrays, for what needs a neighbourhood or a whole row at once.

A tile of a rendered image is made from the few grid rows it lies between, so images are never exchanged: what crosses
the exchange for each tile are grid rows and the mask's runs, each with the rows next to the tile (its halo).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscore.functions import geo

# Window and constants of the published structural similarity index.
SSIM_WIN = 7
SSIM_K1, SSIM_K2 = 0.01, 0.03
#: Pixels of a tile, at most (a tile has one row at least).
TILE_PIXELS = 1 << 18
HALO = SSIM_WIN // 2
#: Rows and columns of the blocks between which distances are exchanged.
BLOCK_ROWS, BLOCK_COLS = 16, 64


class Axis:
    """For each output index the two source indices around it and the second one's weight."""

    def __init__(self, n_out: int, extent: float, step: float, off: float, n_src: int, wrap: bool):
        s = (np.arange(n_out) + 0.5) * (extent / n_out) / step - off
        low = np.floor(s)
        self.part = s - low
        two = np.stack((low, low + 1)).astype(np.int64)
        self.low, self.high = two % n_src if wrap else np.clip(two, 0, n_src - 1)

    def mixed(self, values: np.ndarray, axis: int) -> np.ndarray:
        part = self.part if axis else self.part[:, None]
        return np.take(values, self.low, axis) * (1.0 - part) + np.take(values, self.high, axis) * part


def tile_height(w: int) -> int:
    return max(1, TILE_PIXELS // w)


def tile_frame(grid: DataFrame, keys: Sequence[str], value: str, step: float, shape: tuple[int, int], placement: str) -> DataFrame:
    """(keys, tile, cells): for each tile the grid rows (r, v) that its rows and its halo lie between."""
    (h, w), (n_r, n_c), off = shape, geo.grid_dims(step), geo.half_cell(placement)
    rows, high = Axis(h, 180.0, step, off, n_r, False), tile_height(w)
    tiles: list[list[int]] = [[] for _ in range(n_r)]
    for t in range(-(-h // high)):
        some = slice(max(0, t * high - HALO), min(h, t * high + high + HALO))
        for r in np.unique(np.concatenate((rows.low[some], rows.high[some]))).tolist():
            tiles[r].append(t)
    of_row = F.get(F.array(*[F.array(*map(F.lit, t)) if t else F.array().cast("array<int>") for t in tiles]), F.col("r"))
    d = grid.groupBy(*keys, "r").agg(F.sort_array(F.collect_list(F.struct("c", F.coalesce(value, F.lit(0.0)).alias("v")))).alias("a"))
    d = d.select(*keys, F.explode(of_row).alias("tile"), F.struct("r", F.col("a.c").alias("c"), F.col("a.v").alias("v")).alias("x"))
    return d.groupBy(*keys, "tile").agg(F.collect_list("x").alias("cells"))


class Renderer:
    """Bilinear tiles, periodic in longitude, clamped at the poles, missing cells 0."""

    def __init__(self, step: float, shape: tuple[int, int], placement: str):
        (self.h, self.w), (self.n_r, self.n_c), off = shape, geo.grid_dims(step), geo.half_cell(placement)
        self.rows, self.cols = Axis(self.h, 180.0, step, off, self.n_r, False), Axis(self.w, 360.0, step, off, self.n_c, True)
        self.high = tile_height(self.w)

    def span(self, tile: int, halo: int) -> tuple[int, int]:
        return max(0, tile * self.high - halo), min(self.h, tile * self.high + self.high + halo)

    def image(self, cells, a: int, b: int) -> np.ndarray:
        """Rows a to b of the image."""
        low = int(self.rows.low[a:b].min())
        grid = np.zeros((int(self.rows.high[a:b].max()) - low + 1, self.n_c))
        for x in cells:
            r = x["r"] - low
            if 0 <= r < len(grid):
                grid[r, np.asarray(x["c"])] = x["v"]
        part = self.rows.part[a:b, None]
        tall = grid[self.rows.low[a:b] - low] * (1.0 - part) + grid[self.rows.high[a:b] - low] * part
        return self.cols.mixed(tall, 1)


def render_tiles(grid: DataFrame, keys: Sequence[str], value: str, step: float, shape: tuple[int, int], placement: str = geo.CELL_CENTER) -> DataFrame:
    """Bilinear images of grids (keys, r, c, value): (keys, r, values), one array for each image row."""
    keys, draw = list(keys), Renderer(step, shape, placement)
    tiled = tile_frame(grid, keys, value, step, shape, placement)

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                a, b = draw.span(row.tile, 0)
                out += [(*[getattr(row, k) for k in keys], a + i, v) for i, v in enumerate(draw.image(row.cells, a, b))]
            yield pd.DataFrame(out, columns=[*keys, "r", "values"])

    types = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    return tiled.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", r int, values array<double>")


def _windows(x: np.ndarray) -> np.ndarray:
    """Means over SSIM_WIN x SSIM_WIN windows that lie wholly inside."""
    for axis in (0, 1):
        n = x.shape[axis] - SSIM_WIN + 1
        x = sum(np.take(x, range(k, k + n), axis) for k in range(SSIM_WIN)) / SSIM_WIN
    return x


def ssim_map(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Structural similarity at each pixel whose window lies inside."""
    if min(x.shape) < SSIM_WIN:
        return np.zeros(0)
    cov = SSIM_WIN**2 / (SSIM_WIN**2 - 1.0)
    mx, my, xx, yy, xy = (_windows(v) for v in (x, y, x * x, y * y, x * y))
    vx, vy, vxy = cov * (xx - mx * mx), cov * (yy - my * my), cov * (xy - mx * my)
    c1, c2 = SSIM_K1**2, SSIM_K2**2
    return (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def tile_scores(grid: DataFrame, truth: DataFrame, runs: DataFrame, value: str, step: float, shape: tuple[int, int], placement: str = geo.CELL_CENTER) -> DataFrame:
    """run_id, ssim (7 x 7 windows, border cropped) and prob_rmse (weighted by row) of bilinear images against the mask.

    ``grid`` (run_id, r, c, value), ``truth`` land runs (mask_id, r, c0, c1), ``runs`` (run_id, mask_id). One row a tile
    leaves the workers, with sums.
    """
    h, w = shape
    draw, high = Renderer(step, shape, placement), tile_height(w)
    tiled = tile_frame(grid, ["run_id"], value, step, shape, placement)
    tile_of = lambda r: F.floor(r / high).cast("int")
    near = F.sequence(tile_of(F.greatest(F.col("r") - HALO, F.lit(0))), tile_of(F.least(F.col("r") + HALO, F.lit(h - 1))))
    land = truth.select("mask_id", F.explode(near).alias("tile"), F.struct("r", "c0", "c1").alias("x"))
    land = land.groupBy("mask_id", "tile").agg(F.collect_list("x").alias("land"))
    both = tiled.join(runs.select("run_id", "mask_id"), "run_id").join(land, ["mask_id", "tile"], "left").select("run_id", "tile", "cells", "land")

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                a, b = draw.span(row.tile, HALO)
                x, y = draw.image(row.cells, a, b), np.zeros((b - a, w))
                for s in row.land if row.land is not None else ():
                    y[s["r"] - a, s["c0"] : s["c1"] + 1] = 1.0
                s = ssim_map(x, y)
                first, last = draw.span(row.tile, 0)
                weight = np.cos(np.radians(90.0 - (np.arange(first, last) + 0.5) * (180.0 / h)))
                error = ((x - y)[first - a : last - a] ** 2).sum(axis=1)
                out.append((row.run_id, float(s.sum()), s.size, float((error * weight).sum()), float(weight.sum() * w)))
            yield pd.DataFrame(out, columns=["run_id", "s", "n", "e", "wt"])

    d = both.mapInPandas(run, "run_id string, s double, n bigint, e double, wt double").groupBy("run_id")
    return d.agg((F.sum("s") / F.when(F.sum("n") > 0, F.sum("n"))).alias("ssim"), F.sqrt(F.sum("e") / F.sum("wt")).alias("prob_rmse"))


def column_distances(at: Sequence[int], h: int) -> np.ndarray:
    """Rows from each of h rows to the nearest of the (sorted) rows ``at``."""
    at = np.asarray(at)
    i = np.searchsorted(at, np.arange(h))
    return np.minimum(np.abs(at[np.minimum(i, len(at) - 1)] - np.arange(h)), np.abs(np.arange(h) - at[np.maximum(i - 1, 0)]))


def row_distances(g: np.ndarray, row: np.ndarray, col: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Distance of each query (row, col) to the nearest target, from ``g``: rows to the nearest target in each column
    (negative: the column has none). Periodic in longitude; infinite where the image has no target.

    The parabolas over a row's columns have a lower envelope on which the nearest column moves east with the query. So the
    middle query of a stretch is tried against all columns of the stretch, and splits queries and columns for both
    halves; all stretches of all rows take a step together.
    """
    n_rows, w = g.shape
    r, c = np.nonzero(g >= 0)
    cost = (g[r, c] * dy) ** 2
    lap = np.concatenate((c - w, c, c + w))
    keep = (lap >= -(w // 2) - 1) & (lap <= w + w // 2 + 1)
    rr, cc, pp = np.tile(r, 3)[keep], np.tile(cost, 3)[keep], lap[keep]
    order = np.lexsort((pp, rr))
    pos, cost = pp[order], cc[order]
    first = np.searchsorted(rr[order], np.arange(n_rows + 1))
    by = np.lexsort((col, row))
    row, col = row[by], col[by]
    best = np.full(len(row), np.inf)
    q0 = np.searchsorted(row, np.arange(n_rows))
    q1 = np.searchsorted(row, np.arange(n_rows), "right")
    stretch = [x[(q0 < q1) & (first[:-1] < first[1:])] for x in (q0, q1, first[:-1], first[1:])]
    while len(stretch[0]):
        lo, hi, a, b = stretch
        mid = (lo + hi) >> 1
        count = b - a
        begin = np.cumsum(count) - count
        k = np.arange(int(count.sum())) + np.repeat(a - begin, count)
        value = ((np.repeat(col[mid], count) - pos[k]) * dx) ** 2 + cost[k]
        least = np.minimum.reduceat(value, begin)
        best[mid] = least
        hit = np.flatnonzero(value == np.repeat(least, count))
        at = k[hit[np.searchsorted(hit, begin)]]
        halves = (np.concatenate((lo, mid + 1)), np.concatenate((mid, hi)), np.concatenate((a, at)), np.concatenate((at + 1, b)))
        left = halves[0] < halves[1]
        stretch = [x[left] for x in halves]
    out = np.empty(len(row))
    out[by] = np.sqrt(best)
    return out


def nearest_distance(queries: DataFrame, targets: DataFrame, keys: Sequence[str], shape: tuple[int, int], dy: float, dx: float) -> DataFrame:
    """Exact distance in degrees from every query cell to the nearest target of its key, NULL where it has none.

    A task of the column pass holds some columns of one image, and passes on blocks of distances; one of the row pass some
    rows of it. ``queries`` and ``targets`` have (keys, r, c).
    """
    keys, (h, w) = list(keys), shape
    types = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    named = ", ".join(f"{k} {types[k]}" for k in keys)

    def column_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_cb"].iloc[0])
        g = np.full((h, min(BLOCK_COLS, w - block * BLOCK_COLS)), -1, np.int32)
        for c, rows in pdf.groupby("c")["r"]:
            g[:, c - block * BLOCK_COLS] = column_distances(np.unique(rows.to_numpy()), h)
        out = pd.DataFrame({"_rb": np.arange(-(-h // BLOCK_ROWS), dtype=np.int32), "_cb": np.int32(block)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["g"] = [g[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS].tobytes() for b in out["_rb"]]
        return out[[*keys, "_rb", "_cb", "g"]]

    def row_pass(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = asked[[*keys, "r", "c"]].reset_index(drop=True)
        if not len(asked):
            return out.assign(distance=np.zeros(0))
        band = int(asked["_rb"].iloc[0])
        g = np.full((min(BLOCK_ROWS, h - band * BLOCK_ROWS), w), -1, np.int32)
        for c, raw in zip(blocks["_cb"], blocks["g"]):
            g[:, c * BLOCK_COLS : (c + 1) * BLOCK_COLS] = np.frombuffer(raw, np.int32).reshape(len(g), -1)
        d = row_distances(g, out["r"].to_numpy() - band * BLOCK_ROWS, out["c"].to_numpy(), dy, dx)
        return out.assign(distance=d)

    t = targets.select(*keys, "r", "c").withColumn("_cb", F.floor(F.col("c") / BLOCK_COLS).cast("int"))
    blocks = t.groupBy(*keys, "_cb").applyInPandas(column_pass, f"{named}, _rb int, _cb int, g binary")
    q = queries.select(*keys, "r", "c").distinct().withColumn("_rb", F.floor(F.col("r") / BLOCK_ROWS).cast("int"))
    found = blocks.groupBy(*keys, "_rb").cogroup(q.groupBy(*keys, "_rb")).applyInPandas(row_pass, f"{named}, r int, c int, distance double")
    return found.withColumn("distance", F.when(F.col("distance") < float("inf"), F.col("distance")))
