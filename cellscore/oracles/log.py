"""Oracles of ``cellscore.plans.log``."""

from __future__ import annotations

from cellscore.oracles import masks, scoring, uncertainty  # noqa: F401  (shared expressions)
from cellscore.oracles.base import cte, sql
from cellscore.plans.log import BUDGET, FIT_CHUNK
from cellscore.sources.testbed import SPECS

SPEC_ROWS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in SPECS)

cte("hits", "select idx, count(*) as n from att group by 1", "att")
cte(
    "visits",
    """select idx, lat, lon, level, row_number() over (order by level, h, idx) as visit from (
select idx, lat, lon, md5('0:' || idx) as h, (7 - least(
  case when rr = 0 then 7 else round(log2(rr & -rr))::int end, case when cc = 0 then 7 else round(log2(cc & -cc))::int end, 7))::int as level
from (select *, (r + ('0x' || substr(md5('0:row'), 1, 8))::bigint) % 45 as rr, (c + ('0x' || substr(md5('0:col'), 1, 8))::bigint) % 90 as cc from grid))""",
    "grid",
)
cte("attcost", "select att.*, (input_tokens * price_in + output_tokens * price_out) / 1e6 as cost_usd from att join runs using (run_id)", "att", "runs")
cte(
    "totals",
    """select run_id, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(thinking_tokens)::bigint as thinking_tokens,
 sum(cost_usd) as cost_usd, any_value(n_points_done) as n_points_done
from attcost join (select run_id, count(*) filter (error is null) as n_points_done from pts group by 1) using (run_id) group by 1""",
    "attcost",
    "pts",
)
cte("missing", "select c.* from cells c left join (select * from pts where error is null) p using (run_id, idx) where p.run_id is null", "cells", "pts")
cte(
    "calls",
    """select 'r' || user_id % 8 as run_id, 'p' || user_id % 3 as provider, ts, event_id as seq, event_type <> 'error' as ok,
 52 + event_id % 9 + event_id % 5 as tokens from events""",
)
BOUNDS = "lon - 2 as west, greatest(lat - 2, -90) as south, lon + 2 as east, least(lat + 2, 90) as north"

ORACLES = {
    "latest_points": sql("select run_id, idx, attempts, p_land, error from pts", "pts", r="p_land"),
    "points_scan": sql(
        "select run_id, idx, lat, lon, truth, p_land, n_samples, latency_s from pts where run_id in ('r1', 'r4', 'r6')",
        "pts",
        r="lat lon p_land latency_s",
    ),
    "points_export": sql(
        "select run_id, idx, weight, truth, p_land, finish_reason, error, output_tokens from pts", "pts", r="weight p_land"
    ),
    "points_append_log": sql(
        "select run_id, case when run_id in ('r2', 'r5') then 'rejects' else 'log' end as \"table\", count(*) as n from att group by 1, 2", "att"
    ),
    "metrics_export": sql(
        f"""select run_id, '{{"run":{{"run_id":"' || run_id || '","variant":"' || variant || '","extraction_mode":"' || extraction_mode || '","repeat_idx":' || repeat_idx || ',"status":"' || status
 || '"}},"model":{{"name":"' || split_part(variant, '@', 1) || '","provider":"' || provider || '"' || coalesce(',"vendor":"' || vendor || '"', '') || ',"forced_thinking":' || forced_thinking
 || '}},"spec":{{"spec_id":"' || spec_id || '","coord_format":"' || coord_format || '","mask_id":"mask","mask_hash":"' || mask_hash
 || '"}},"metrics":[{{"computed_at":"' || d || '","threshold":0.5,' || m || ',"n_correct":' || c5 || '}},{{"computed_at":"' || d || '","threshold":0.7,' || m || ',"n_correct":' || c7 || '}}]}}' as document
from runs join rstate using (run_id) join (values {SPEC_ROWS}) v(spec_id, coord_format, template) using (spec_id) join (
 select run_id, strftime(max(updated_at), '%Y-%m-%d') as d, '"n_points":' || count(*) || ',"n_valid":' || count(p_land) || ',"n_unknown_truth":' || (count(*) - count(truth)) as m,
  count(*) filter (p_land is not null and truth is not null and (p_land > 0.5) = (truth = 1)) as c5, count(*) filter (p_land is not null and truth is not null and (p_land > 0.7) = (truth = 1)) as c7
 from pts group by 1) using (run_id), fprint""",
        "runs",
        "rstate",
        "pts",
        "fprint",
    ),
    "points_sorted": sql("select run_id, idx, p_land from pts", "pts", r="p_land"),
    "grid_source": sql(
        "select idx, r, c, lat, lon, cos(radians(lat)) as weight, coalesce(n, 0) as n_attempts from grid left join hits using (idx)",
        "grid",
        "hits",
        r="lat lon weight",
    ),
    "grid_subset": sql(
        "select run_id, idx, p_land from pts where idx in (select idx from grid order by md5('0:' || idx), idx limit 405)",
        "pts",
        "grid",
        r="p_land",
    ),
    "stratified_order": sql(
        "select idx, level, visit, coalesce(n, 0) as n_attempts from visits left join hits using (idx)", "visits", "hits"
    ),
    "progress_by_prefix": sql(
        """select k::int as k, count(*) as n, count(distinct (lat > 0)::int * 2 + (lon > 0)::int) as n_hemispheres,
 count(distinct floor((lon + 180) / 60)) as n_sextants, count(distinct floor((lat + 90) / 45)) as n_bands
from visits join hits using (idx), (values (1), (4), (10), (40), (400), (4000)) v(k) where visit <= k group by 1""",
        "visits",
        "hits",
    ),
    "cell_bounds": sql(f"select run_id, idx, {BOUNDS} from pts", "pts", r="west south east north"),
    "cell_index": sql('select run_id, idx, r::int as "row", c::int as col from pts', "pts"),
    "block_id": sql(f"select run_id, idx, {uncertainty.BLOCK} as block from pts", "pts"),
    "missing_points": sql("select run_id, idx, visit from missing join visits using (idx)", "missing", "visits"),
    "failed_points": sql("select run_id, idx, error, attempts from pts where error is not null", "pts"),
    "retry_queue": sql(
        """select run_id, idx, (p.run_id is not null)::int as phase, visit from cells left join pts p using (run_id, idx) join visits using (idx)
where p.run_id is null or error is not null""",
        "cells",
        "pts",
        "visits",
    ),
    "points_missing_set": sql(
        "select run_id, count(*) as n_missing from cells anti join pts using (run_id, idx) group by 1", "cells", "pts"
    ),
    "run_totals": sql("select * from totals", "totals", r="cost_usd"),
    "run_completion": sql(
        """select *, case when bad then 'failed' else 'complete' end as status,
 case when bad then 'to be resumed: ' || n_failed || ' points with errors, ' || n_missing || ' without answer'
  when n_failed > 0 then 'points left with errors: ' || n_failed end as note
from (select *, n_total - n_done - n_failed as n_missing from (
 select run_id, (case when any_value(k) % 2 = 0 then 4050 else count(*) end)::bigint as n_total, count(*) filter (error is null) as n_done,
  count(error) as n_failed from pts group by 1)), lateral (select n_missing > 0 or n_failed > 0.025 * n_total as bad)""",
        "pts",
    ).replace("select * from result", "select * exclude (bad) from result"),
    "usage_per_point": sql(
        """select run_id, count(*) as n, round_even(avg(input_tokens), 0)::bigint as input_tokens, round_even(avg(output_tokens), 0)::bigint as output_tokens,
 round_even(avg(thinking_tokens), 0)::bigint as thinking_tokens from pts where error is null group by 1 having count(*) >= 10""",
        "pts",
    ),
    "cost_usd": sql("select run_id, cost_usd, cost_usd * 0.5::double as batch_cost_usd from totals", "totals", r="cost_usd batch_cost_usd"),
    "budget_cutoff": sql(
        f"""select comparison, run_id, count(*) filter (kept) as n_kept, count(*) filter (not kept) as n_cut, sum(cost_usd) filter (kept) as spent,
 bool_or(cost_usd is null) as unknown_price from (
 select *, coalesce(sum(coalesce(cost_usd, 0)) over (partition by comparison order by updated_at, ok, pk, ln, ep, run_id rows between unbounded preceding and 1 preceding), 0) + 0.1 < {BUDGET} as kept
 from attcost join members using (run_id)) group by 1, 2""",
        "attcost",
        "members",
        r="spent",
    ),
    "batch_budget_fit": sql(
        f"""select run_id, chunk::int as chunk, size::bigint as size,
 case when e is null then size else greatest(0, least(size, floor(greatest(0, room - e * chunk * {FIT_CHUNK}) / e + 1e-9))) end::bigint as submitted
from (select run_id, n, e, room, range as chunk, least({FIT_CHUNK}, n - range * {FIT_CHUNK}) as size from (
  select run_id, 4050 - n_points_done as n, cost_usd / n_points_done as e, cost_usd * 0.1 as room from totals),
  range(1000) where range * {FIT_CHUNK} < n)""",
        "totals",
    ),
    "failure_bursts": sql(
        """select run_id, min(epoch(ts)) as opened_at from (
select run_id, ts, ok, lag(ok, 1) over w as ok1, lag(ok, 2) over w as ok2, lag(ts, 2) over w as ts2 from calls
window w as (partition by run_id order by ts, seq)) where not ok and not ok1 and not ok2 and epoch(ts) - epoch(ts2) <= 7200 group by 1""",
        "calls",
        r="opened_at",
    ),
    "rate_usage": sql(
        """select provider, strftime(minute, '%Y-%m-%d %H:%M') as minute, requests, tokens, rpm::int as rpm, tpm::int as tpm,
 coalesce(requests > rpm, false) or coalesce(tokens > tpm, false) as over_limit
from (select provider, date_trunc('minute', ts) as minute, count(*) as requests, sum(tokens)::bigint as tokens from calls group by 1, 2)
left join (values ('p0', 1, 120), ('p1', 2, 60)) v(provider, rpm, tpm) using (provider)""",
        "calls",
    ),
    "run_progress": sql(
        """select run_id, variant, 4050 as n_total, n_done, n_invalid, cost_usd, n_done / 4050 as share from runs
join (select run_id, count(*) as n_done, count(*) - count(p_land) as n_invalid from pts group by 1) using (run_id) join costs using (run_id)""",
        "runs",
        "pts",
        "costs",
        r="cost_usd share",
    ),
    "run_views": sql(
        f"""select comparison, run_id, position::int as position, variant, extraction_mode, vendor, release_date, forced_thinking, thinking or forced_thinking as thinking,
 repeat_idx, lo, hi, regions, case when variant like '%@%' then '{{"effort":"' || regexp_extract(variant, 'effort=([^,]*)', 1) || '"}}' else '{{}}' end as config, split_part(variant, '@', 1) as model_key, coalesce(nullif(regexp_extract(variant, 'effort=([^,]*)', 1), ''), 'default') as effort,
 case when repeat_idx > 0 then variant || ' #' || (repeat_idx + 1) else variant end as label, m.* exclude (run_id), cost_usd
from members join runs using (run_id) join costs using (run_id) join ci using (run_id)
join (select run_id, string_agg(region || ' ' || printf('%.4f', acc), '; ' order by position) as regions from regacc group by 1) using (run_id) join (
 select run_id, {scoring.M['acc_area']} as acc_area, {scoring.M['acc_valid_only']} as acc_valid_only, {scoring.M['skill']} as skill, {scoring.M['f1']} as f1,
  avg((not valid)::int) as invalid_rate, count(*) as n_points, {scoring.M['acc_area']} as correct,
  sum(w) filter (known and valid and pred_land and not t_land) / sum(w) filter (known) as false_land,
  sum(w) filter (known and valid and not pred_land and t_land) / sum(w) filter (known) as false_water,
  sum(w) filter (known and not valid) / sum(w) filter (known) as invalid from fl group by 1) m using (run_id)""",
        "members",
        "runs",
        "costs",
        "fl",
        "ci",
        "regacc",
        r="acc_area acc_valid_only skill f1 invalid_rate correct false_land false_water invalid cost_usd lo hi",
    ),
    "report_header": sql(
        """select comparison, strftime(min(s), '%Y-%m-%d %H:%M') as first_start, strftime(max(e), '%Y-%m-%d %H:%M') as last_end, sum(cost_usd) as total_spend,
 count(*) filter (cost_usd is null) as n_without_price, count(*) as n_runs, string_agg(distinct extraction_mode, ', ' order by extraction_mode) as modes,
 string_agg(distinct runner_version, ', ' order by runner_version) as runner_versions
from members join runs using (run_id) join rstate using (run_id) join costs using (run_id) join (select run_id, min(updated_at) as s, max(updated_at) as e from att group by 1) using (run_id) group by 1""",
        "members",
        "runs",
        "costs",
        "att",
        "rstate",
        r="total_spend",
    ),
    "comparison_check": sql(
        """select * exclude (n_specs, specs, open, forced), case when n_specs > 1 then 'runs of several specs: ' || specs end as refused,
 case when mixed_modes then 'acc_area' end as rank_on, concat_ws('; ', case when mixed_modes then 'modes differ, so ranks use accuracy alone' end, 'not complete: ' || open,
 case when n_partial > 0 then 'some runs are unfinished and count with what they have' end, 'thinking forced on: ' || forced,
 case when mixed_thinking then 'only part of the runs think' end) as warnings
from (select comparison, count(distinct spec_id) as n_specs, string_agg(distinct spec_id, ', ' order by spec_id) as specs, count(distinct extraction_mode) > 1 as mixed_modes,
 count(*) filter (n_done < 4050 or status <> 'complete') as n_partial, string_agg(distinct label, ', ' order by label) filter (status <> 'complete') as open,
 count(*) filter (forced_thinking) as n_forced, string_agg(distinct label, ', ' order by label) filter (forced_thinking) as forced,
 bool_or(thinking) and not bool_and(thinking) as mixed_thinking
from members join (select *, case when repeat_idx > 0 then variant || ' #' || (repeat_idx + 1) else variant end as label from runs) using (run_id) join rstate using (run_id) join (select run_id, count(*) as n_done from pts group by 1) using (run_id) group by 1)""",
        "members",
        "runs",
        "pts",
        "rstate",
    ),
    "comparison_runs": sql(
        "select comparison, position::int as position, run_id, n_attempts from members join (select run_id, count(*) as n_attempts from att group by 1) using (run_id)",
        "members",
        "att",
    ),
    "modes_union": sql("select distinct comparison, extraction_mode from members join runs using (run_id)", "members", "runs"),
}
