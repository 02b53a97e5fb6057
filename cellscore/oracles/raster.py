"""Oracles of ``cellscore.plans.raster``."""

from __future__ import annotations

import re

from cellscore.functions.geo import ANCHORS, EARTH_RADIUS_KM, KM_PER_DEG, LAND_RULES, rule_case
from cellscore.oracles import masks, scoring, uncertainty  # noqa: F401  (shared expressions)
from cellscore.oracles.base import CTES, HEADS, KEPT, cte, sql
from cellscore.plans.raster import BOUNDARY, HIGHER, LOWER
from cellscore.plans.scoring import LATE_FROM, LATE_RUNS, STORED_METRICS

KEPT.update({"gridv", "bimg", "pimg", "pbnd", "tbnd", "bscore", "gseg", "tedge", "gedge", "tlab", "glab"})

cte(
    "gridv",
    """select c.run_id, (c.idx // 90)::int as r, (c.idx % 90)::int as c, coalesce(p_land, 0.0) as p, coalesce(pred_land, false) as b
from cells c left join fl on fl.run_id = c.run_id and fl.idx = c.idx
union all select 'ceiling', (idx // 90)::int, (idx % 90)::int, truth::double, truth = 1 from center""",
    "cells",
    "fl",
    "center",
)
cte(
    "bimg",
    """select run_id, pr::int as r, pc::int as c, b as pred, land as truth from (select range as pr from range(180)), (select range as pc from range(360))
join gridv on gridv.r = pr // 4 and gridv.c = pc // 4 join mask on mask.r = pr and mask.c = pc""",
    "gridv",
    "mask",
)
cte(
    "pimg",
    """select run_id, pr::int as r, pc::int as c, sum(p * wy * wx) as prob, any_value(land) as truth
from (select range as pr, k, least(greatest(floor((range + 0.5) / 4 - 0.5) + k, 0), 44)::int as gr,
   case k when 0 then 1 - ((range + 0.5) / 4 - 0.5 - floor((range + 0.5) / 4 - 0.5)) else (range + 0.5) / 4 - 0.5 - floor((range + 0.5) / 4 - 0.5) end::double as wy
  from range(180), (values (0), (1)) v(k))
join gridv on gridv.r = gr
join (select range as pc, k as kx, ((floor((range + 0.5) / 4 - 0.5) + k + 90) % 90)::int as gc,
   case k when 0 then 1 - ((range + 0.5) / 4 - 0.5 - floor((range + 0.5) / 4 - 0.5)) else (range + 0.5) / 4 - 0.5 - floor((range + 0.5) / 4 - 0.5) end::double as wx
  from range(360), (values (0), (1)) v(k)) on gc = gridv.c
join mask on mask.r = pr and mask.c = pc group by 1, 2, 3""",
    "gridv",
    "mask",
)


def boundary(src: str, key: str, val: str, w: int) -> str:
    """Cells joined to each of their four neighbours."""
    return f"""select distinct a.{key}, a.r, a.c, a.{val} from (
 select {key}, r, c, {val}, r + dr as nr, (c + dc + {w}) % {w} as nc from {src}, (values (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc)) a
join {src} b on b.{key} = a.{key} and b.r = nr and b.c = nc where b.{val} <> a.{val}"""


cte("vgrid", "select run_id, r::int as r, c::int as c, pred_land from fl where valid", "fl")
cte("kgrid", "select run_id, r::int as r, c::int as c, t_land from fl where known", "fl")
cte("gpb", boundary("vgrid", "run_id", "pred_land", 90), "vgrid")
cte("gtb", boundary("kgrid", "run_id", "t_land", 90), "kgrid")
cte("pbnd", boundary("bimg", "run_id", "pred", 360), "bimg")
cte("tbnd", boundary("mask", "mask_id", "land", 360), "mask")
NEAR = "sqrt(min(16 * ((a.r - b.r)::double ** 2 + least(abs(a.c - b.c), 90 - abs(a.c - b.c)) ** 2)))"


def separable(targets: str, queries: str, key: str) -> str:
    """Distances at one degree pixels: nearest target in every column, then the best column."""
    return f"""select q.{key}, q.r, q.c, sqrt(min(g * g + least(abs(q.c - v.c), 360 - abs(q.c - v.c)) ** 2)) as distance from {queries} q join (
 select {key}, r, c, least(coalesce(r - up, 1000), coalesce(dn - r, 1000)) as g from (
  select k.{key}, rr as r, k.c, max(t.r) over (partition by k.{key}, k.c order by rr) as up,
   min(t.r) over (partition by k.{key}, k.c order by rr desc) as dn
  from (select distinct {key}, c from {targets}) k, (select range::int as rr from range(180)) left join {targets} t on t.{key} = k.{key} and t.c = k.c and t.r = rr)) v
 on v.{key} = q.{key} and v.r = q.r group by 1, 2, 3"""


cte("tb1", "select 'x' as k, r, c from tbnd", "tbnd")
cte("pb1", "select distinct 'x' as k, r, c from pbnd", "pbnd")
cte("d_true", separable("tb1", "pb1", "k"), "tb1", "pb1")
cte("askt", "select run_id, tbnd.r, tbnd.c from (select distinct run_id from pbnd), tbnd", "pbnd", "tbnd")
cte("d_pred", separable("pbnd", "askt", "run_id"), "pbnd", "askt")
cte(
    "bscore",
    f"""select *, 2 * boundary_p_2 * boundary_r_2 / (boundary_p_2 + boundary_r_2) as boundary_f_2, 2 * boundary_p_4 * boundary_r_4 / (boundary_p_4 + boundary_r_4) as boundary_f_4,
 contour_mean_deg * {KM_PER_DEG!r} as contour_mean_km, contour_p95_deg * {KM_PER_DEG!r} as contour_p95_km
from (select run_id, avg((distance <= 2)::int) as boundary_p_2, avg((distance <= 4)::int) as boundary_p_4, avg(distance) as contour_mean_deg,
  quantile_cont(distance, 0.95) as contour_p95_deg from pbnd join d_true using (r, c) group by 1)
join (select run_id, avg((distance <= 2)::int) as boundary_r_2, avg((distance <= 4)::int) as boundary_r_4 from d_pred group by 1) using (run_id)""",
    "pbnd",
    "d_true",
    "d_pred",
)
W = "cos(radians(90 - (r + 0.5::double)))"
cte(
    "iou",
    f"""select run_id, sum({W}) filter (pred and truth) / sum({W}) filter (pred or truth) as pixel_iou,
 2 * coalesce(sum({W}) filter (pred and truth), 0) / (sum({W} * (pred::int + truth::int))) as dice from bimg group by 1""",
    "bimg",
)
WIN = "{0} as (partition by run_id, {1} order by {2} rows between 3 preceding and 3 following)"
cte(
    "ssimt",
    f"""select run_id, avg((2*x*y + 1e-4) * (2*49/48.0*(xy - x*y) + 9e-4) / ((x*x + y*y + 1e-4) * (49/48.0*(xx - x*x) + 49/48.0*(yy - y*y) + 9e-4))) as ssim from (
select run_id, r, c, {", ".join(f"avg({n}) over b as {n}" for n in ("x", "y", "xx", "yy", "xy"))} from (
 select run_id, r, c, {", ".join(f"avg({e}) over a as {n}" for n, e in (("x", "prob"), ("y", "truth::int"), ("xx", "prob*prob"), ("yy", "truth::int"), ("xy", "prob*truth::int")))}
 from pimg window {WIN.format("a", "r", "c")}) window {WIN.format("b", "c", "r")})
where r between 3 and 176 and c between 3 and 356 group by 1""",
    "pimg",
)
cte(
    "rmse",
    f"""select run_id, case when coalesce(probabilistic, true) then v end as prob_rmse from (
select run_id, sqrt(sum(e * w) / sum(w)) as v from (select run_id, r, avg((prob - truth::int) ** 2) as e, any_value({W}) as w from pimg group by 1, 2) group by 1)
left join (select run_id, probabilistic from prob) using (run_id)""",
    "pimg",
    "prob",
)
cte("imgs", "select * from iou join ssimt using (run_id) join bscore using (run_id) join rmse using (run_id)", "iou", "ssimt", "bscore", "rmse")
cte("tseg", "select r, c0, c1, r * 360 + c0 as id from rle", "rle")
TOUCH = """abs(a.r - b.r) <= 1 and a.id <> b.id and ((a.r <> b.r and a.c0 <= b.c1 + 1 and b.c0 <= a.c1 + 1)
 or (a.c1 = {last} and b.c0 = 0) or (b.c1 = {last} and a.c0 = 0))"""
cte("tedge", f"select a.id as a, b.id as b from tseg a join tseg b on {TOUCH.format(last=359)}", "tseg")
HEADS["treach"] = "treach(id, label) using key (id)"
HEADS["greach"] = "greach(run_id, id, label) using key (run_id, id)"
cte(
    "treach",
    """select id, id as label from tseg union select e.b, min(t.label) from treach t join tedge e on e.a = t.id
join recurring.treach k on k.id = e.b where t.label < k.label group by e.b""",
    "tseg",
    "tedge",
)
cte("tlab", "select tseg.*, label from tseg join treach using (id)", "tseg", "treach")
cte(
    "gseg",
    """select run_id, r, min(c)::int as c0, max(c)::int as c1, r * 90 + min(c) as id from (
select *, c - row_number() over (partition by run_id, r order by c) as g from gridv where b) group by run_id, r, g""",
    "gridv",
)
cte("gedge", f"select a.run_id, a.id as a, b.id as b from gseg a join gseg b on a.run_id = b.run_id and {TOUCH.format(last=89)}", "gseg")
cte(
    "greach",
    """select run_id, id, id as label from gseg union select e.run_id, e.b, min(t.label) from greach t join gedge e on e.run_id = t.run_id and e.a = t.id
join recurring.greach k on k.run_id = e.run_id and k.id = e.b where t.label < k.label group by e.run_id, e.b""",
    "gseg",
    "gedge",
)
cte(
    "glab",
    "select gseg.*, label from gseg join greach using (run_id, id)",
    "gseg",
    "greach",
)
AREA = f"{EARTH_RADIUS_KM}::double ** 2 * (pi() / 180) * (2 * pi() / 360) * {W}"
cte(
    "gpix",
    """select run_id, label, pr::int as r, pc::int as c from glab join (select range as pr from range(180)) on pr // 4 = glab.r
join (select range as pc from range(360)) on pc // 4 between c0 and c1""",
    "glab",
)
cte("tpix", "select label, r, unnest(range(c0, c1 + 1))::int as c from tlab", "tlab")
cte(
    "gstat",
    f"""select run_id, label, sum({AREA}) as area_km2, bool_or(land) as touches from gpix join mask using (r, c) group by 1, 2""",
    "gpix",
    "mask",
)
CELL_KM2 = (4.0 * KM_PER_DEG) ** 2
cte(
    "cstats",
    f"""select run_id, count(*) as n_components, count(*) filter (area_km2 >= {CELL_KM2!r}) as n_components_large, max(area_km2) as largest_km2,
 count(*) filter (not touches) as spurious_specks, string_agg(printf('%.1f', area_km2), ', ' order by area_km2 desc) filter (rank <= 10) as largest_pred_km2
 from (select *, row_number() over (partition by run_id order by area_km2 desc) as rank from gstat) group by 1""",
    "gstat",
)
cte(
    "tcount",
    f"""select count(*) as n_components_true, count(*) filter (a >= {CELL_KM2!r}) as n_components_true_large,
 string_agg(printf('%.1f', a), ', ' order by a desc) filter (rank <= 10) as largest_true_km2
from (select *, row_number() over (order by a desc) as rank from (select label, sum({AREA}) as a from tpix group by 1))""",
    "tpix",
)
ANCHOR = ", ".join(f"({i}, {a}, {b}, '{n}')" for i, (a, b, n) in enumerate(ANCHORS))
cte(
    "tbig",
    f"""select label, area_km2, row_number() over (order by area_km2 desc, label) as rank from (select label, sum({AREA}) as area_km2 from tpix group by 1 having sum({AREA}) >= 5e5)
order by area_km2 desc limit 12""",
    "tpix",
)
cte(
    "tcont",
    f"""select label, r, c, lat, lon, coalesce({rule_case(LAND_RULES, "lat", "lon")}, (select n from (values {ANCHOR}) a(i, alat, alon, n)
  order by sin(radians(lat))*sin(radians(alat)) + cos(radians(lat))*cos(radians(alat))*cos(radians(lon) - radians(alon)) desc, i limit 1)) as continent
from (select label, r, c, 90 - (r + 0.5::double) as lat, -180 + (c + 0.5::double) as lon from tpix join tbig using (label))""",
    "tpix",
    "tbig",
)
cte(
    "mass",
    """select label, rank, area_km2, centroid_lat, centroid_lon, name || case when row_number() over (partition by name order by rank) > 1
  then ' #' || row_number() over (partition by name order by rank) else '' end as name
from tbig join (select label, string_agg(continent, ' + ' order by n desc, continent) as name from (
   select label, continent, count(*) as n, sum(count(*)) over (partition by label) as tot from tcont group by 1, 2) where n >= 0.15 * tot group by 1) using (label)
join (select label, avg(lat) as centroid_lat, case when sqrt(avg(sin(radians(lon))) ** 2 + avg(cos(radians(lon))) ** 2) > 1e-9 then degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) end as centroid_lon from tcont group by 1) using (label)""",
    "tbig",
    "tcont",
)
cte(
    "miou",
    f"""select run_id, name, coalesce(iou, 0) as iou from (select g.run_id, mass.* from (select distinct run_id from gridv) g, mass) left join (
 select run_id, label, wi / (wt + wp - wi) as iou from (
  select g.run_id, t.label, g.label as pl, sum({W.replace('(r ', '(t.r ')}) as wi, row_number() over (partition by g.run_id, t.label order by count(*) desc, g.label) as rn
  from tpix t join gpix g on g.r = t.r and g.c = t.c group by 1, 2, 3)
 join (select label, sum({W}) as wt from tpix group by 1) using (label)
 join (select run_id, label as pl, sum({W}) as wp from gpix group by 1, 2) using (run_id, pl) where rn = 1) using (run_id, label)""",
    "mass",
    "tpix",
    "gpix",
    "gridv",
)
SHARES = ", ".join(
    [f"case when c.{n} > 0 then m.{n} / c.{n} end as share_{n}" for n in HIGHER]
    + [f"case when m.{n} is null or c.{n} is null then null when m.{n} <= 0 then 1 else c.{n} / m.{n} end as share_{n}" for n in LOWER]
)
SHARE_COLS = " ".join(f"share_{n}" for n in HIGHER + LOWER)
BF = "boundary_f_2 boundary_p_2 boundary_r_2 boundary_f_4 boundary_p_4 boundary_r_4"
CD = "contour_mean_deg contour_p95_deg contour_mean_km contour_p95_km"
COVER = "select run_id, count(*) filter (valid) / 4050 as coverage from fl group by 1"


def coast(flags: str) -> str:
    return f"""select run_id, coastline_error_deg from (select distinct run_id from fl) left join (select run_id, avg(d) as coastline_error_deg from (
select a.run_id, a.r, a.c, {NEAR} as d from {flags[0]} a join {flags[1]} b on a.run_id = b.run_id group by 1, 2, 3) group by 1) using (run_id)"""


cte("fl7", """select * replace (coalesce(p_land > 0.7, false) as pred_land, coalesce(p_land is not null and (p_land > 0.7) = (truth = 1), false) as correct) from fl""", "fl")
cte("vgrid7", "select run_id, r::int as r, c::int as c, pred_land from fl7 where valid", "fl7")
cte("gpb7", boundary("vgrid7", "run_id", "pred_land", 90), "vgrid7")
cte("blocks7", f"""select run_id, {uncertainty.BLOCK} as block, sum(case when known then w * correct::int else 0 end) as num,
 sum(case when known then w else 0 end) as den from fl7 group by 1, 2""", "fl7")
cte("ci7", uncertainty.boot("blocks7", "run_id"), "blocks7")
NAMED = "string_agg(region || ' ' || printf('%.4f', acc), '; ' order by position) as regions"
cte("regs", f"select run_id, {NAMED} from regacc group by 1", "regacc")
cte("reg7", f"""select run_id, {NAMED} from (
 select run_id, region, {scoring.POS} as position, sum(w * (case when coalesce(p_land is not null and (p_land > 0.7) = (truth = 1), false) then 1 else 0 end)) / sum(w) as acc
 from labelled where known group by 1, 2 having sum(w) > 0) group by 1""", "labelled")
#: The expressions of the images once more, at the other threshold.
AGAIN = ("gridv", "bimg", "pbnd", "pb1", "d_true", "askt", "d_pred", "bscore", "iou")
for name in AGAIN:
    body, needs = CTES[name]
    cte(f"{name}7", re.sub(rf"\b({'|'.join((*AGAIN, 'fl'))})\b(?!\()", r"\g<1>7", body), *[f"{n}7" if n in (*AGAIN, "fl") else n for n in needs])
KEPT.update(f"{name}7" for name in AGAIN if name in KEPT)
cte("coast5", coast(("gpb", "gtb")), "gpb", "gtb", "fl")
cte("coast7", coast(("gpb7", "gtb")), "gpb7", "gtb", "fl")
PLAIN = [n for n in scoring.M if n not in ("brier", "log_loss")]


def record(f: str, t: float, ci: str, reg: str, coastline: str, images: str) -> str:
    return f"""select m.*, s.* exclude (run_id), {t}::double as threshold, case when probabilistic then brier_ end as brier, case when probabilistic then log_loss_ end as log_loss,
 case when probabilistic then ece_ end as ece, probabilistic, regions, lo as acc_lo, hi as acc_hi, coastline_error_deg, mask_id, mask_hash,
 pixel_iou, dice, ssim, prob_rmse, {BF.replace(" ", ", ")}, {CD.replace(" ", ", ")}, runs.variant, runs.thinking, runs.forced_thinking, status, cost_usd,
 4050 as n_points_total, n_points < 4050 or status <> 'complete' as partial
from (select run_id, count(*) as n_points, count(p_land) as n_valid, count(*) - count(truth) as n_unknown_truth, avg((p_land is null)::int) as invalid_rate,
 {", ".join(f"{scoring.M[n]} as {n}" for n in PLAIN)} from {f} group by 1) m
join (select run_id, {scoring.M['brier']} as brier_, {scoring.M['log_loss']} as log_loss_ from fl group by 1) using (run_id)
join prob using (run_id) join speed s using (run_id)
join (select run_id, sum(weight * abs(mean_p - frac_land)) / sum(weight) as ece_ from bins group by 1) using (run_id)
join {ci} using (run_id) join {reg} using (run_id) join {coastline} using (run_id) join iou{images} using (run_id) join bscore{images} using (run_id)
join ssimt using (run_id) join rmse using (run_id) join runs using (run_id) join rstate using (run_id) join costs using (run_id), fprint"""


STORED = ", ".join(f"{scoring.M[n]} as {n}" for n in STORED_METRICS if n != "n_points")

ORACLES = {
    "rescored_runs": sql(
        " union all ".join(
            f"""select run_id, {t}::double as threshold, m.* exclude (run_id), lo as acc_lo, hi as acc_hi, exists (select 1 from att where att.run_id = m.run_id
 and m.run_id in {LATE_RUNS!r} and updated_at >= '{LATE_FROM}') as rescored
from (select run_id, {STORED}, count(*) as n_points from {f} group by 1) m join {ci} using (run_id)""" for t, f, ci in ((0.5, "fl", "ci"), (0.7, "fl7", "ci7"))
        ),
        "fl", "fl7", "ci", "ci7", "att", r="acc_area acc_unweighted skill f1 brier acc_lo acc_hi",
    ),
    "render_nearest": sql(
        "select run_id, r, count(*) as n, count(*) filter (pred) as n_land, sum(c * pred::int)::bigint as sum_c from bimg group by 1, 2", "bimg"
    ),
    "render_bilinear": sql(
        "select run_id, r, count(*) as n, avg(prob * sqrt(c + 2)) as mean_p_sqrt, avg(prob * ln(c + 2)) as mean_p_log, max(prob) * sqrt(2) as max_p_sqrt2 from pimg group by 1, 2",
        "pimg",
        r="mean_p_sqrt mean_p_log max_p_sqrt2",
    ),
    "error_overlay": sql(
        """select run_id, r, case when pred and truth then 'land' when pred then 'false_land' when truth then 'false_water' else 'water' end as pixel_class, count(*) as n
from bimg group by 1, 2, 3""",
        "bimg",
    ),
    "boundary_cells": sql("select * from gpb", "gpb"),
    "distance_transform": sql(
        f"select a.run_id, a.r::int as r, a.c::int as c, {NEAR} as distance from fl a join gpb b on a.run_id = b.run_id group by 1, 2, 3", "fl", "gpb", r="distance"
    ),
    "coastline_error": sql("select * from coast5", "coast5", r="coastline_error_deg"),
    "boundary_f": sql(f"select run_id, {BF.replace(' ', ', ')} from bscore", "bscore", r=BF),
    "contour_distance": sql(f"select run_id, {CD.replace(' ', ', ')} from bscore", "bscore", r=CD),
    "pixel_iou_dice": sql("select * from iou", "iou", r="pixel_iou dice"),
    "ssim": sql("select * from ssimt", "ssimt", r="ssim"),
    "prob_rmse": sql("select * from rmse", "rmse", r="prob_rmse"),
    "connected_components": sql(
        "select label::bigint as label, sum(c1 - c0 + 1)::bigint as n_pixels, count(*) as n_runs from tlab group by 1", "tlab"
    ),
    "component_stats": sql(
        "select * replace (round(largest_km2, 4) as largest_km2) from cstats, tcount", "cstats", "tcount"
    ),
    "top_components": sql(
        """select run_id, rank::int as rank, round(area_km2, 3) as area_km2 from (
select *, row_number() over (partition by run_id order by area_km2 desc) as rank from gstat) where rank <= 10""",
        "gstat",
    ),
    "landmass_names": sql(
        """select label::bigint as label, rank::int as rank, name, round(area_km2, 4) as area_km2, round(centroid_lat, 4) + 0.0 as centroid_lat,
 round(centroid_lon, 4) + 0.0 as centroid_lon from mass""",
        "mass",
    ),
    "landmass_iou": sql("select * from miou", "miou", r="iou"),
    "image_coverage": sql(COVER, "fl", r="coverage"),
    "resolution_ceiling": sql("select * exclude (run_id) from imgs where run_id = 'ceiling'", "imgs", r=f"pixel_iou dice ssim prob_rmse {BF} {CD}"),
    "share_of_ceiling": sql(
        f"select m.run_id, {SHARES} from imgs m, imgs c where m.run_id <> 'ceiling' and c.run_id = 'ceiling'", "imgs", r=SHARE_COLS
    ),
    "image_metrics": sql(
        f"""select m.run_id, {", ".join("m." + n for n in (*HIGHER, *LOWER, *BOUNDARY))}, {", ".join(f"c.{n} as ceil_{n}" for n in HIGHER + LOWER)}, {SHARES}, cstats.* exclude (run_id, largest_km2), tcount.*,
 coverage, landmass_iou, 180 as work_rows, 360 as work_columns
from imgs m join cstats on cstats.run_id = m.run_id join ({COVER}) v on v.run_id = m.run_id
join (select run_id, string_agg(name || ' ' || printf('%.4f', iou), '; ' order by name || ' ' || printf('%.4f', iou)) as landmass_iou from miou group by 1) l on l.run_id = m.run_id,
 tcount, imgs c where m.run_id <> 'ceiling' and c.run_id = 'ceiling'""",
        "imgs",
        "cstats",
        "tcount",
        "miou",
        "fl",
        r=" ".join((*HIGHER, *LOWER, *BOUNDARY)) + " " + " ".join(f"ceil_{n}" for n in HIGHER + LOWER) + f" {SHARE_COLS} coverage",
    ),
    "score_all": sql(
        f"{record('fl', 0.5, 'ci', 'regs', 'coast5', '')} union all by name {record('fl7', 0.7, 'ci7', 'reg7', 'coast7', '7')}",
        "fl", "fl7", "prob", "bins", "speed", "ci", "ci7", "regs", "reg7", "coast5", "coast7", "fprint", "iou", "iou7", "bscore", "bscore7", "ssimt", "rmse", "runs", "rstate", "costs",
        r="invalid_rate ece brier log_loss latency_p50 latency_p95 acc_lo acc_hi coastline_error_deg pixel_iou dice ssim prob_rmse cost_usd " + f"{BF} {CD} " + " ".join(PLAIN),
    ),
}
