"""Oracles of ``cellscore.plans.masks``."""

from __future__ import annotations

from cellscore.oracles import log  # noqa: F401  (grid expression)
from cellscore.oracles.base import cte, sql

cte(
    "rle",
    """select mask_id, r, min(c)::int as c0, max(c)::int as c1 from (
select *, c - row_number() over (partition by r order by c) as g from mask where land) group by mask_id, r, g""",
    "mask",
)
cte(
    "fprint",
    """select mask_id, sha256('180x360:' || string_agg(h, '' order by band)) as mask_hash from (
select mask_id, band, sha256(string_agg(h, '' order by r)) as h from (
 select mask_id, r, r // 256 as band, sha256(r || ':' || string_agg(c0 || '-' || c1, ',' order by c0)) as h from rle group by 1, 2) group by 1, 2) group by 1""",
    "rle",
)
cte(
    "rgba",
    """select 'upload' as image_id, (p // 128)::int as r, (p % 128)::int as c, (coalesce(q * 3, 0) + land)::int as red, (coalesce(n * 5 % 100, 0) + land)::int as green,
 (coalesce(ln * 10, 0) + land)::int as blue, (255 - coalesce(ln * 4, 0))::int as alpha
from (select range as p, case when ((range // 128 + range % 128) % 64) < 24 then 80 else 0 end as land from range(16384)) left join (
 select (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 16384 as p, max(l_quantity) as q, count(*) as n, max(l_linenumber) as ln from lineitem group by 1) using (p)""",
)
cte(
    "gray",
    """select image_id, r, c, least(greatest(round_even((0.299::double * red + 0.587::double * green + 0.114::double * blue) * (alpha / 255.0::double), 0), 0), 255)::int as gray from rgba""",
    "rgba",
)
cte(
    "otsu",
    """select image_id, first(t order by v desc, t)::int as threshold, any_value(n_levels) as n_levels from (
select a.image_id, a.gray as t, any_value(n_levels) as n_levels,
 case when count(*) filter (b.gray > a.gray) > 0 then
  (count(*) filter (b.gray <= a.gray))::double * count(*) filter (b.gray > a.gray) * (avg(b.gray) filter (b.gray <= a.gray) - avg(b.gray) filter (b.gray > a.gray)) ** 2 end as v
from (select distinct image_id, gray, (select count(distinct gray) from gray) as n_levels from gray) a join gray b using (image_id) group by 1, 2) where v is not null group by 1""",
    "gray",
)
cte(
    "ring0",
    """select c_custkey::int as shape_id, (c_custkey // 50)::int as layer_pos, (c_custkey // 50 % 3 <> 1)::int as burn, c_custkey as k, c_nationkey % 4 as kind,
 (-165 + c_custkey * 37 % 330)::double + 0.25 as x0, (-75 + c_custkey * 53 % 150)::double + 0.125 as y0, (2 + floor(abs(c_acctbal))::bigint % 9)::double as size from customer""",
)
CORNERS = {0: [(-1, -1), (1, -1), (1, 1), (-1, 1)], 1: [(0, -1), (1, 0), (0, 1), (-1, 0)], 2: [(-1, -1), (1, -1), (0, 1)]}
EDGE_ROWS = ", ".join(
    f"({kind}, {i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})"
    for kind, pts in CORNERS.items()
    for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1]))
)
cte(
    "pedges",
    f"""select layer_pos, burn, shape_id, ring_no::int as ring_no, x0 + ax * s as x1, y0 + ay * s as y1, x0 + bx * s as x2, y0 + by_ * s as y2
from (select *, 0 as ring_no, size as s from ring0 union all select *, 1, size / 2 from ring0 where k % 4 = 0)
join (values {EDGE_ROWS}) e(shape, i, ax, ay, bx, by_) on shape = case when kind = 3 then 0 else kind end
where not (kind = 3 and k % 8 = 3)""",
    "ring0",
)


def majority(cells: str, mask: str) -> str:
    """Brute force: every cell against every pixel center inside its bounds, the seam both ways."""
    return f"""select idx, coalesce(any_value(maj), 0)::int as truth from {cells} left join (
select idx, (2 * count(*) filter (land) > count(*))::int as maj from {cells} join {mask} m on m.lat_c between south - 1e-9 and north + 1e-9
 and (m.lon_c between west - 1e-9 and east + 1e-9 or m.lon_c + 360 between west - 1e-9 and east + 1e-9) group by 1) using (idx) group by 1"""


PX = "90 - (r + 0.5::double) * {d} as lat_c, -180 + (c + 0.5::double) * {d} as lon_c"
cte("maskpx", f"select r, c, land, {PX.format(d=1)} from mask", "mask")
cte("half", "select (r // 2)::int as r, (c // 2)::int as c, count(*) filter (land) > 2 as land from mask group by 1, 2", "mask")
cte("halfpx", f"select r, c, land, {PX.format(d=2)} from half", "half")
cte("cellbox", "select *, lon - 2 as west, lat - 2 as south, lon + 2 as east, lat + 2 as north from grid", "grid")
cte(
    "cornerbox",
    """select *, lon as west, greatest(lat - 5, -90) as south, lon + 5 as east, lat as north from (
select i::int as idx, 90.0::double - 5 * (i // 72) as lat, -180.0::double + 5 * (i % 72) as lon from (select range as i from range(2592)))""",
)
cte(
    "center",
    "select idx, land::int as truth from grid join mask on mask.r = least(floor(90 - lat + 1e-9), 179) and mask.c = floor(lon + 180 + 1e-9) % 360",
    "grid",
    "mask",
)


def binned(h: int, w: int) -> str:
    """Area majority by joining every pixel to the output pixel whose rounded edges hold it."""
    return f"""select 'mask' as mask_id, i::int as r, j::int as c from mask
join (select range as i, floor(range * 180 / {h}) as a, floor((range + 1) * 180 / {h}) as b from range({h})) on r >= a and r < b
join (select range as j, floor(range * 360 / {w}) as e, floor((range + 1) * 360 / {w}) as f from range({w})) on c >= e and c < f
group by i, j having 2 * count(*) filter (land) > count(*)"""


ORACLES = {
    "mask_source_rle": sql("select mask_id, r, c from mask where land and r between 20 and 119", "mask"),
    "mask_rle_rows": sql("select * from rle", "rle"),
    "mask_pixel_of": sql(
        'select run_id, idx, least(floor(90 - lat + 1e-9), 179)::int as "row", (floor(lon + 180 + 1e-9) % 360)::int as col from pts', "pts"
    ),
    "land_fraction": sql(
        """select 'mask' as mask_id, sum(f * w) / sum(w) as land_fraction, avg(f) as land_fraction_unweighted
from (select r, avg(land::int) as f, cos(radians(90 - (r + 0.5))) as w from mask group by 1)""",
        "mask",
        r="land_fraction land_fraction_unweighted",
    ),
    "mask_fingerprint": sql("select * from fprint", "fprint"),
    "mask_downsample_edges": sql(binned(50, 70), "mask"),
    "mask_resample_mixed": sql(
        """select 'mask' as mask_id, i::int as r, (c // 4)::int as c from mask join (select range as i, floor((range + 0.5) * 180 / 250) as r from range(250)) using (r)
group by i, c // 4 having 2 * count(*) filter (land) > count(*)""",
        "mask",
    ),
    "mask_downsample_work": sql(
        "select mask_id, (r // 2)::int as r, (c // 4)::int as c from mask group by 1, 2, 3 having 2 * count(*) filter (land) >= count(*)".replace(
            "group by 1, 2, 3", "group by mask_id, r // 2, c // 4"
        ),
        "mask",
    ),
    "mask_downsample_nearest": sql(
        """select mask_id, i::int as r, j::int as c from mask join (select range as i, floor((range + 0.5) * 1.8::double) as r from range(100)) using (r)
join (select range as j, floor((range + 0.5) * 1.8::double) as c from range(200)) using (c) where land""",
        "mask",
    ),
    "gray_luminance": sql("select * from gray", "gray"),
    "mercator_reproject": sql(
        """select image_id, i::int as r, j::int as c, gray from gray join (
select range as i, least(greatest(floor((pi() - ln(tan(pi() / 4 + radians(least(greatest(90 - (range + 0.5) * 180 / 64, -85.0511), 85.0511)) / 2))) / (2 * pi()) * 128), 0), 127)::int as r
 from range(64)) using (r) join (select range as j, range::int as c from range(128)) using (c)""",
        "gray",
    ),
    "otsu_threshold": sql("select * from otsu", "otsu"),
    "binarise": sql("select image_id, r, c, gray > threshold as land from gray join otsu using (image_id)", "gray", "otsu"),
    "polygon_edges": sql("select * from pedges", "pedges", r="x1 y1 x2 y2"),
    "rasterize_polygons": sql(
        """select 'polygons' as mask_id, r, min(c)::int as c0, max(c)::int as c1 from (select r, c, c - row_number() over (partition by r order by c) as g from (
 select r, c from (select r, c, layer_pos, any_value(burn) as burn from (
   select (i // 180)::int as r, (i % 180)::int as c, 89 - 2 * (i // 180)::double as lat, -179 + 2 * (i % 180)::double as lon from (select range as i from range(16200)))
  join pedges on (y1 <= lat) <> (y2 <= lat) and x1 + (lat - y1) * (x2 - x1) / (y2 - y1) <= lon
  group by r, c, layer_pos, shape_id having count(*) % 2 = 1) group by r, c having arg_max(burn, layer_pos) = 1)) group by r, g""",
        "pedges",
    ),
    "truth_cell_center": sql("select * from center", "center"),
    "truth_majority": sql(majority("cellbox", "maskpx"), "cellbox", "maskpx"),
    "truth_majority_corner": sql(majority("cornerbox", "halfpx"), "cornerbox", "halfpx"),
    "truth_refill": sql(
        "select run_id, idx, coalesce(pts.truth, center.truth) as truth_filled, center.truth as truth_replaced from pts join center using (idx)",
        "pts",
        "center",
    ),
    "mask_fidelity_check": sql(
        """select md5('run:' || o_orderkey) as run_id, 's1' as spec_id, case when o_orderkey % 5 = 3 then 'warn' else 'refuse resume' end as action
from orders where o_orderkey % 3 = 1"""
    ),
}
