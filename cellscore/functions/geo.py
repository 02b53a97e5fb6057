"""Grid, pixel, block and region expressions. Row 0 is the north, column 0 starts at 180 W."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEG = EARTH_RADIUS_KM * math.pi / 180.0

CELL_CENTER = "cell_center"
CELL_CORNER = "cell_corner"


def grid_dims(step: float) -> tuple[int, int]:
    """Rows and columns of a full grid; the step has to divide 180."""
    if not 0 < step <= 180:
        raise ValueError(f"step must lie in (0, 180], not {step}")
    rows = round(180.0 / step)
    if abs(180.0 / step - rows) > 1e-6:
        raise ValueError(f"step {step} does not divide 180")
    return rows, 2 * rows


def half_cell(placement: str) -> float:
    if placement not in (CELL_CENTER, CELL_CORNER):
        raise ValueError(f"unknown placement {placement}")
    return 0.5 if placement == CELL_CENTER else 0.0


def round9(x: Column) -> Column:
    """Nine decimals, no -0.0 (in doubles; ``round`` would go through decimals row by row)."""
    return F.rint(x * 1e9) / 1e9 + F.lit(0.0)


def row_lat(r: Column, step: float, placement: str = CELL_CENTER) -> Column:
    return round9(F.lit(90.0) - (r + F.lit(half_cell(placement))) * step)


def col_lon(c: Column, step: float, placement: str = CELL_CENTER) -> Column:
    return round9(F.lit(-180.0) + (c + F.lit(half_cell(placement))) * step)


def cos_weight(lat: Column) -> Column:
    """cos(lat), 0 at the poles."""
    w = F.cos(F.radians(lat))
    return F.when(w < 1e-12, F.lit(0.0)).otherwise(w)


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def pixel_row(lat: Column, h: int) -> Column:
    """Mask row of a latitude: an edge belongs to the pixel south of it."""
    return clip(F.floor((F.lit(90.0) - lat) / F.lit(180.0 / h) + F.lit(1e-9)), 0, h - 1).cast("int")


def pixel_col(lon: Column, w: int) -> Column:
    """Mask column of a longitude: an edge belongs to the pixel east of it, 180 E is column 0."""
    return F.pmod(F.floor((lon + F.lit(180.0)) / F.lit(360.0 / w) + F.lit(1e-9)), F.lit(w)).cast("int")


def cell_row(lat: Column, step: float, placement: str = CELL_CENTER) -> Column:
    n, _ = grid_dims(step)
    return clip(F.rint((F.lit(90.0) - lat) / step - half_cell(placement)), 0.0, float(n - 1)).cast("int")


def cell_col(lon: Column, step: float, placement: str = CELL_CENTER) -> Column:
    _, n = grid_dims(step)
    return F.pmod(F.rint((lon + F.lit(180.0)) / step - half_cell(placement)).cast("int"), F.lit(n))


def block_id(lat: Column, lon: Column, block: float = 10.0) -> Column:
    """Row-major id of the block x block degree tile around a point."""
    n_r, n_c = math.ceil(180.0 / block - 1e-9), math.ceil(360.0 / block - 1e-9)
    r = clip(F.floor((F.lit(90.0) - lat) / block), 0, n_r - 1)
    c = F.pmod(F.floor((lon + F.lit(180.0)) / block), F.lit(n_c))
    return (r * n_c + c).cast("int")


def cell_bounds(lat: Column, lon: Column, step: float, placement: str = CELL_CENTER) -> dict[str, Column]:
    """west, south, east, north of the cell of a point; latitudes clipped, longitudes not wrapped."""
    back = step * half_cell(placement)  # a corner point is the north-west corner
    return {
        "west": round9(lon - back),
        "south": round9(F.greatest(F.lit(-90.0), lat - (step - back))),
        "east": round9(lon + (step - back)),
        "north": round9(F.least(F.lit(90.0), lat + back)),
    }


def pixel_lat(r: Column, h: int) -> Column:
    return F.lit(90.0) - (r + F.lit(0.5)) * F.lit(180.0 / h)


def pixel_lon(c: Column, w: int) -> Column:
    return F.lit(-180.0) + (c + F.lit(0.5)) * F.lit(360.0 / w)


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


# Region labels in report order, and the hand-drawn boxes and lines that define them.
# Each list is read from the top; the first condition that holds gives the label.
CONTINENTS = ["North America", "South America", "Europe", "Africa", "Asia", "Oceania"]
POLAR = ["Arctic", "Antarctica", "Southern Ocean"]
OCEANS = [
    "Atlantic Ocean",
    "Pacific Ocean",
    "Indian Ocean",
    "Mediterranean & Black Sea",
    "Inland waters",
]
REGION_ORDER = CONTINENTS + POLAR + OCEANS
ARCTIC_LAT = 66.5
ANTARCTIC_LAT = -60.0
LAND_RULES = [
    ("Antarctica", "lat < -60"),
    ("North America", "lat >= 59 and lon between -75 and -10 and (lat >= 67 or lon <= -30)"),
    ("Oceania", "(lat < -10 and lon > 110) or (lon >= 130 and lat < 22) or (lon < -120 and lat < 30)"),
    ("South America", "lat < 12.5 and lon > -92 and lon < -34 and not (lat > 7 and lon < -77.2)"),
    ("North America", "lat >= 7 and lon between -170 and -50 and not (lat > 55 and lon < -168.5)"),
    ("North America", "lon >= 172 and lat > 50 and lat < 56"),
    (
        "Africa",
        "lon between -26 and 52 and lat >= -36 and lat < 35.95 and not (lon > 11.6 and lat > 33.4)"
        " and not (lat between 12.5 and 30 and lon > 34.0e0 + (28.0e0 - lat) * 0.604e0)"
        " and not (lat > 30 and lon > 34.2)",
    ),
    (
        "Europe",
        "lon between -32 and 60 and lat >= 34.5 and not (lon > 26.5 and lat < 41)"
        " and not (lon > 29.5 and lat < 42.2) and not (lon > 39.5 and lat < 43.5)"
        " and not (lon > 50 and lat < 52)",
    ),
    ("Asia", "lon >= 26 or (lon < -168 and lat > 55)"),
]
WATER_RULES = [
    (
        "Mediterranean & Black Sea",
        "lat between 30 and 46 and lon between -5.6 and 36.5 and (lon >= 0 or lat < 38)",
    ),
    ("Mediterranean & Black Sea", "lat between 40.5 and 47.5 and lon between 27 and 42"),
    ("Inland waters", "lat between 36.5 and 47.5 and lon between 46.5 and 55.5"),
    ("Atlantic Ocean", "lat >= 50 and lon >= 20 and lon < 31"),
    ("Arctic", "lat >= 60 and lon >= 31 and lon < 100"),
    ("Inland waters", "lat >= 31 and lon >= 20 and lon < 100"),
    (
        "Indian Ocean",
        "lon between 20 and 147 and lat < 31 and not (lon > 99 and lat > -8)"
        " and (lon < 132 or lat < -30)",
    ),
    ("Atlantic Ocean", "lon >= -70 and lon < 20 and not (lat < -54 and lon < -67.3)"),
    (
        "Atlantic Ocean",
        "lon >= -100 and lon < -70 and lat >= 8 and lat > 17.0e0 - (lon + 92.0e0) * 0.654e0",
    ),
    ("Pacific Ocean", "true"),
]
ANCHORS = [
    (45.0, -100.0, "North America"),
    (-15.0, -60.0, "South America"),
    (50.0, 15.0, "Europe"),
    (5.0, 20.0, "Africa"),
    (40.0, 90.0, "Asia"),
    (-25.0, 135.0, "Oceania"),
    (-15.0, -150.0, "Oceania"),
    (-5.0, 160.0, "Oceania"),
]


def rule_case(rules: list[tuple[str, str]], lat: str, lon: str) -> str:
    """SQL text of a rule list over two named columns."""
    def put(text: str) -> str:
        return re.sub(r"\blon\b", lon, re.sub(r"\blat\b", lat, text))

    return "case " + " ".join(f"when {put(t)} then '{label}'" for label, t in rules) + " end"


def nearest_anchor(lat: Column, lon: Column) -> Column:
    """Label of the anchor with the largest great-circle cosine; the earlier anchor wins a tie."""
    la, lo = F.radians(lat), F.radians(lon)
    scored = [
        F.struct(
            (
                F.sin(la) * math.sin(math.radians(a))
                + F.cos(la) * math.cos(math.radians(a)) * F.cos(lo - math.radians(b))
            ).alias("cosine"),
            F.lit(-i).alias("earlier"),
            F.lit(label).alias("label"),
        )
        for i, (a, b, label) in enumerate(ANCHORS)
    ]
    return F.greatest(*scored)["label"]


def with_continent(df: DataFrame, out: str = "continent", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Continent of land points at any latitude (leftover islands: nearest anchor)."""
    return (
        df.withColumn("_wl", wrap_lon(F.col(lon)))
        .withColumn(
            out,
            F.coalesce(F.expr(rule_case(LAND_RULES, lat, "_wl")), nearest_anchor(F.col(lat), F.col("_wl"))),
        )
        .drop("_wl")
    )


def with_region(
    df: DataFrame, out: str = "region", lat: str = "lat", lon: str = "lon", truth: str = "truth"
) -> DataFrame:
    """Continent, ocean or polar label of every point by place and true class."""
    y, t = F.col(lat), F.col(truth)
    d = with_continent(df, "_land", lat, lon).withColumn("_wl", wrap_lon(F.col(lon)))
    label = (
        F.when(t.isNull(), F.lit("Unknown"))
        .when(y >= ARCTIC_LAT, F.lit("Arctic"))
        .when((y < ANTARCTIC_LAT) & (t > 0.5), F.lit("Antarctica"))
        .when(y < ANTARCTIC_LAT, F.lit("Southern Ocean"))
        .when(t > 0.5, F.col("_land"))
        .otherwise(F.expr(rule_case(WATER_RULES, lat, "_wl")))
    )
    return d.withColumn(out, label).drop("_land", "_wl")
