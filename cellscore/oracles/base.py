"""Common table expressions of the oracles and the text that puts them together."""

from __future__ import annotations

from cellscore.sources.testbed import RUN_STATE, RUNS

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}
KEPT = {"pts", "fl", "pdiff", "ranked", "mask"}  # evaluated once per statement


HEADS: dict[str, str] = {}  # where an expression needs more than its name


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body.strip(), needs)


def sql(body: str, *needs: str, r: str | list[str] = "", extra: str = "") -> str:
    """``with`` the needed expressions (and ``extra`` ones) in order, doubles ``r`` rounded."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in CTES[name][1]:
            add(n)
        order.append(name)

    for n in needs:
        add(n)
    parts = [f"{HEADS.get(n, n)} as {'materialized ' if n in KEPT else ''}({CTES[n][0]})" for n in order]
    if extra:
        parts.append(extra.strip())
    parts.append(f"result as ({body.strip()})")
    star = "*"
    if r:
        star = "* replace (" + ", ".join(f"round({c}::double, 6) + 0.0 as {c}" for c in (r.split() if isinstance(r, str) else r)) + ")"
    return "with recursive " + ",\n".join(parts) + f"\nselect {star} from result"


def _lit(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return f"'{v}'" if isinstance(v, str) else repr(v)


cte(
    "runs",
    "select run_id::varchar as run_id, variant, extraction_mode, n_samples_set, vendor, release_date, "
    "forced_thinking, thinking, repeat_idx, price_in::double as price_in, price_out::double as price_out from (values "
    + ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in RUNS)
    + ") v(run_id, variant, extraction_mode, n_samples_set, vendor, release_date, forced_thinking, thinking, "
    "repeat_idx, price_in, price_out)",
)
cte("rstate", "select * from (values " + ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in RUN_STATE) + ") v(run_id, spec_id, status, runner_version, provider)")
cte(
    "raw",
    """
select (l_suppkey % 8)::int as k, ((l_partkey*37 + l_orderkey*11 + l_linenumber) % 4050)::int as idx,
  l_linenumber as ln, l_returnflag as rf, l_linestatus as ls, l_quantity as q, l_extendedprice as ep,
  l_shipdate as updated_at, l_orderkey as ok, l_partkey as pk,
  cast(round(l_extendedprice*100) as bigint) % 100 as cents
from lineitem""",
)
cte(
    "placed",
    """
select *, idx // 90 as r, idx % 90 as c, 88.0::double - 4.0*(idx // 90) as lat, -178.0::double + 4.0*(idx % 90) as lon
from raw""",
    "raw",
)
cte(
    "att",
    """
select 'r' || k as run_id, k, idx, r, c, lat, lon, cos(radians(lat)) as weight, updated_at, ok, pk, ln, ep,
  case when idx % 97 = 5 then null when (abs(lat) < 40 and lon > -20 and lon < 40) or lat < -65 then 1 else 0 end as truth,
  case when ls='F' and ln=1 and rf='R' then 'HTTP 500: server error ' || (q % 3)::int end as error,
  case when not ((ls='F' and ln=1 and rf='R') or (rf='N' and ln=7)) then
    round(0.5 + (2*(case when (cents < 5 + 5*k) <> ((abs(lat) < 40 and lon > -20 and lon < 40) or lat < -65)
      then 1 else 0 end)-1) * (0.05 + q*0.009), 4) end as p_land,
  case when ls='F' and ln=1 and rf='R' then 0 when k < 4 then 4 else 1 end as n_samples,
  case when (ls='F' and ln=1 and rf='R') or (rf='N' and ln=7) then 0 when k < 4 then 4 else 1 end as n_valid,
  case when k in (4,5) and not ((ls='F' and ln=1 and rf='R') or (rf='N' and ln=7)) then round(0.3 + q*0.014, 4) end as validity_mass,
  case when ln=6 then 'length' when ln=5 and rf='A' then 'MAX_TOKENS' else 'stop' end as finish_reason,
  ((cast(round(ep*100) as bigint) + 500) // 1000) / 10000 as latency_s, (50+ln)::int as input_tokens, q::int+2 as output_tokens,
  case when k in (0,1,3,7) then ln*10 else 0 end as thinking_tokens
from placed""",
    "placed",
)
cte(
    "pts",
    """
select * exclude (rn) from (
 select *, row_number() over (partition by run_id, idx order by updated_at desc, ok desc, pk desc, ln desc, ep desc) as rn,
  count(*) over (partition by run_id, idx) as attempts from att) where rn = 1""",
    "att",
)
cte(
    "fl",
    """
select *, weight as w, truth is not null as known, coalesce(truth = 1, false) as t_land, p_land is not null as valid,
  coalesce(p_land > 0.5, false) as pred_land,
  coalesce(p_land is not null and (p_land > 0.5) = (truth = 1), false) as correct
from pts""",
    "pts",
)
cte(
    "mask",
    """
select 'mask' as mask_id, r, c, ((abs(lat) < 36 + (c*7) % 9 and lon > -20 - (r % 4) and lon < 40 + (r % 3))
   or lat < -65 + (c % 3) or (r between 60 and 66 and (c < 5 or c >= 355))) <> coalesce(v > 0, false) as land
from (select (i // 360)::int as r, (i % 360)::int as c, 90 - (i // 360 + 0.5) as lat, -180 + (i % 360 + 0.5) as lon, v
  from (select range as i from range(64800)) left join (
    select (l_partkey*131 + l_orderkey*17 + l_linenumber*7) % 64800 as pix,
      sum(case when l_quantity >= 49 then 1 else -1 end) as v from lineitem group by 1) on pix = i)""",
)
cte("cells", "select run_id, i::int as idx from runs, (select range as i from range(4050))", "runs")
cte(
    "grid",
    """select i::int as idx, (i // 90)::int as r, (i % 90)::int as c, 88.0::double - 4 * (i // 90) as lat, -178.0::double + 4 * (i % 90) as lon
from (select range as i from range(4050))""",
)
