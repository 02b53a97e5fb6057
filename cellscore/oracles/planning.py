"""Oracles of ``cellscore.plans.planning``."""

from __future__ import annotations

from cellscore.oracles import extraction  # noqa: F401
from cellscore.oracles.base import KEPT, cte, sql
from cellscore.oracles.extraction import SPEC_ROWS
from cellscore.plans.planning import BUDGET, RUNS_ENDED

#: Lengths of the prompts of 45 N, 45 W.
PROMPTS = ["What is at 45° N, 45° W? Keep {this}.", f"At {45.0}, {-45.0} ({45.0:+08.2f} | {-45.0:.0f} | {45.0:6.1f}): 45.0, -45.0", "Place 45°00'00\" N, 45°00'00\" W"]
PROMPT_LENGTHS = ", ".join(f"({i}, {len(p)})" for i, p in enumerate(PROMPTS))

KEPT.update({"rlog", "models", "prices", "matrix", "priced"})
cte(
    "rlog",
    """select md5('run:' || k) as run_id, md5('h:' || m || ':' || k % 4) as run_hash, md5('h:' || m || ':' || (k + 1) % 4) as plan_hash, 's' || k % 3 as spec_id, 'm' || m as model_id,
 ['logprobs', 'sample', 'greedy'][k % 3 + 1] as extraction_mode, ['queued', 'running', 'paused', 'complete', 'failed'][k % 5 + 1] as status, o_orderdate as created_at,
 case when k % 5 = 3 then o_orderdate + to_days((k % 50)::int) end as ended_at, case when k % 3 <> 0 then 'v' || k % 11 end as resolved_version,
 case when k % 13 <> 0 then o_totalprice / 100000 end as cost_usd, (k % 4)::int as repeat_idx, (k * 7 % 4051)::int as n_points_done, 'r' || k % 8 as points_of
from (select *, o_orderkey as k, o_custkey % 300 as m from orders)""",
)
cte(
    "models",
    """select 'm' || k as model_id, 'p' || k % 7 as provider, case when k % 7 = 6 then 'ollama' else 'kind' || k % 3 end as kind, name, k,
 case when k % 4 = 0 then 'rv' || k % 9 end as resolved_version, case when p_size % 10 = 0 then 'q4' end as quant, k % 50 = 3 as own,
 'p' || k % 7 || '/m' || k || '#' || left(md5(name), 8) as store_id
from (select *, p_partkey as k, lower(replace(p_brand, '#', '')) || '-' || lower(p_type) || '-' || p_size as name from part)""",
)
cte(
    "prices",
    """select key, case when over then 'override' else 'default' end as source, case when over then 1 else 2 end::int as precedence,
 min(k) % 90 / 10 + 0.1::double as input_per_m, max(k) % 90 / 2 + 0.5::double as output_per_m, 0.5::double as batch_discount
from (select k, k % 4 >= 2 as over, case k % 4 when 0 then name when 1 then split_part(name, '-', 1) || '-' || split_part(name, '-', 2)
  when 2 then provider || '/' || name else split_part(name, '-', 1) end as key from models) group by key, over""",
    "models",
)
cte(
    "priced",
    """select model_id, name, case when own then 1.5 when source is not null then input_per_m when kind = 'ollama' then 0 end::double as input_per_m,
 case when own then 6.0 when source is not null then output_per_m when kind = 'ollama' then 0 end::double as output_per_m,
 case when own or source is not null then 0.5 when kind = 'ollama' then 1 end::double as batch_discount,
 case when own then 'registry' when source is not null then source when kind = 'ollama' then 'local' end as source
from models left join (select model_id as mid, input_per_m, output_per_m, source, row_number() over (partition by model_id order by precedence,
   case key when provider || '/' || name then 1 when kind || '/' || name then 2 when name then 3 when model_id then 4 else 5 end, length(key) desc) as rn
  from models join prices on key in (provider || '/' || name, kind || '/' || name, name, model_id) or starts_with(name, key)) on mid = model_id and rn = 1""",
    "models",
    "prices",
)
cte(
    "matrix",
    """select *, c_custkey * 10 + rep as position, model_id || '#' || rep as label, md5('h:' || c_custkey % 300 || ':' || rep) as cell_hash,
 case when provider in ('p0', 'p1', 'p2') then true when provider in ('p3', 'p4') then false end as has_lp, forced or coalesce(effort <> 'off', false) as thinking
from (select *, case c_mktsegment when 'BUILDING' then 'low' when 'AUTOMOBILE' then 'high' when 'HOUSEHOLD' then 'off' when 'FURNITURE' then 'xhigh' end as effort,
  case when c_nationkey % 2 = 1 then 0.7 end::double as temperature, case when c_nationkey % 3 = 0 then 3 end::int as n_samples, case when c_nationkey = 5 then 5000 end::int as max_out,
  ['auto', 'logprobs', 'sample', 'greedy'][c_nationkey % 4 + 1] as requested, case when c_nationkey % 2 = 0 then 19 else 0 end as sys_len, c_custkey % 17 = 0 as forced
 from customer), (select range::int as rep from range(3)), models where rep <= c_nationkey % 3 and model_id = 'm' || c_custkey""",
    "models",
)
cte(
    "eff",
    """select position, mode, case when not thinking and requested = 'logprobs' and not has_lp then 'the endpoint gives no logprobs' end as refusal, thinking,
 case when mode = 'greedy' then 0 else coalesce(temperature, 1) end::double as temperature, case when mode = 'sample' then coalesce(n_samples, 4) else 1 end::int as n_samples,
 case when mode = 'logprobs' then case when provider = 'p1' then 5 else 20 end end::int as top_logprobs,
 case when thinking then greatest(coalesce(max_out, 0), case effort when 'low' then 4096 when 'high' then 16384 else 8192 end) else coalesce(max_out, 16) end::int as max_output_tokens
from (select *, case when requested = 'auto' then case when not thinking and coalesce(has_lp, false) then 'logprobs' else 'sample' end
  when requested = 'logprobs' and thinking then 'sample' else requested end as mode from matrix)""",
    "matrix",
)
cte(
    "hit",
    """select run_hash as cell_hash, run_id as cached from (select *, row_number() over (partition by run_hash order by ended_at desc, created_at desc, run_id desc) as rn
from rlog where status = 'complete') where rn = 1""",
    "rlog",
)
cte(
    "open",
    """select cell_hash, run_id as resume, n_points_done as done, points_of from (select *, row_number() over (partition by cell_hash order by created_at desc, run_id desc) as rn from (
 select run_hash as cell_hash, run_id, created_at, n_points_done, points_of from rlog where status <> 'complete' union
 select plan_hash, run_id, created_at, n_points_done, points_of from rlog where status <> 'complete')) where rn = 1""",
    "rlog",
)
cte(
    "dup",
    """select position, cell_hash, case when rn > 1 then 'duplicate of cell ' || f end as refused from (
select *, row_number() over w as rn, first_value(label) over w as f from matrix window w as (partition by cell_hash order by position))""",
    "matrix",
)
cte(
    "plan",
    f"""select position, mode, r as refused, case when r is null then cached end as cached_run_id, resume_run_id, n_points, n_calls, active, thinking, forced, quant,
 case when active and pin is not null then 'pilot' when stored then 'stored' else 'heuristic' end as est_source, (n_points * ti)::bigint as est_in, (n_points * tout)::bigint as est_out,
 case when active and n_points > 0 then (n_points * ti * input_per_m + n_points * tout * output_per_m) / 1e6 * case when provider = 'p2' then batch_discount else 1 end end as est_cost_usd
from (select *, coalesce(pin, case when stored then sin end, gi) as ti, coalesce(pout, case when stored then sout end, go) as tout
from (select *, n_points * case when mode = 'sample' then ns else 1 end as n_calls, (ceil((prompt_len + sys_len) / 4) + 8) * ns as gi, (think + 2) * ns as go,
   active and resume_run_id is not null and done >= 10 as stored
 from (select * from (values {PROMPT_LENGTHS}) v(spec_no, prompt_len) join (select *, case when active then 4050 - case when resume_run_id is not null then done else 0 end else 0 end::bigint as n_points
  from (select *, case when active then resume end as resume_run_id from (
   select m.position, m.c_custkey % 3 as spec_no, points_of, case when m.c_custkey % 5 = 2 then 'r' || m.c_custkey % 8 end as pilot_of, m.provider, m.sys_len, m.forced, m.quant, e.mode, e.thinking, e.n_samples as ns, coalesce(e.refusal, d.refused) as r, cached, resume, done,
    coalesce(e.refusal, d.refused) is null and cached is null as active, input_per_m, output_per_m, batch_discount,
    case when not e.thinking then 0 when m.effort = 'low' then 400 when m.effort = 'high' then 4000 else 1500 end as think
   from matrix m join eff e using (position) join dup d using (position) join priced using (model_id) left join hit on hit.cell_hash = m.cell_hash left join open on open.cell_hash = m.cell_hash))) using (spec_no)
 left join (select run_id as points_of, round_even(avg(input_tokens), 0)::bigint as sin, round_even(avg(output_tokens), 0)::bigint as sout from pts where error is null group by 1 having count(*) >= 10) using (points_of)
 left join (select run_id as pilot_of, round_even(avg(ti), 0)::bigint as pin, round_even(avg(tout), 0)::bigint as pout from resp where not bad group by 1) using (pilot_of))))""",
    "matrix", "eff", "dup", "priced", "hit", "open", "pts", "resp",
)
cte(
    "refs",
    """select c_custkey as k, case c_custkey % 5 when 0 then model_id when 1 then provider || '/' || model_id when 2 then provider || '/' || name when 3 then name else 'unknown-' || c_custkey end as ref
from customer join models on model_id = 'm' || c_custkey""",
    "models",
)
cte(
    "asked",
    """select distinct case when c_custkey % 11 = 0 then h when c_custkey % 13 = 0 then 'zz' || h else left(h, (3 + c_custkey % 6)::int) end as prefix
from (select *, md5('run:' || c_custkey) as h from customer)""",
)

SPEC_DOC = """'{{"mask_hash":"' || {} || '","spec":{{"coord_format":"' || coord_format || '","grid":{{"placement":"center","step_deg":4.0}},"mask":{{"source":"rle","truth_rule":"cell_center"}},"template":"' || template || '"}},"v":1}}'"""

ORACLES = {
    "cache_hit": sql("select position, cached as cached_run_id from matrix left join hit using (cell_hash)", "matrix", "hit"),
    "resumable_run": sql("select position, resume as resume_run_id, done as resume_done from matrix left join open using (cell_hash)", "matrix", "open"),
    "duplicate_cells": sql("select position, refused from dup where refused is not null", "dup"),
    "latest_version": sql(
        """select model_id, coalesce(resolved_version, v) as version from models left join (select model_id, first(resolved_version order by coalesce(ended_at, created_at) desc, run_id desc) as v
from rlog where resolved_version is not null group by 1) using (model_id)""",
        "models",
        "rlog",
    ),
    "model_ref_resolve": sql(
        """select k, ref, case k % 5 when 0 then 'm' || k when 1 then 'm' || k
 when 2 then (select case when count(*) = 1 then min(model_id) end from models where provider || '/' || name = ref)
 when 3 then (select case when count(*) = 1 then min(model_id) end from models where name = ref) end as model_id from refs""",
        "refs",
        "models",
    ),
    "run_prefix_resolve": sql(
        """select prefix, case when x = 1 then prefix when length(prefix) >= 4 and n = 1 then m end as run_id,
 case when x = 1 or (length(prefix) >= 4 and n = 1) then 'found' when length(prefix) >= 4 and n > 1 then 'ambiguous' else 'not found' end as state
from asked left join (select prefix, count(*) as n, min(run_id) as m, count(*) filter (run_id = prefix) as x from asked join rlog on starts_with(run_id, prefix) group by 1) using (prefix)""",
        "asked",
        "rlog",
    ),
    "price_table": sql("select * from prices", "prices", r="input_per_m output_per_m batch_discount"),
    "price_union": sql("select precedence, source, count(*) as n, count(distinct key) as n_keys from prices group by 1, 2", "prices"),
    "price_lookup": sql("select * from priced", "priced", r="input_per_m output_per_m batch_discount"),
    "effective_config": sql("select * from eff", "eff", r="temperature"),
    "work_plan": sql(
        "select position, mode, refused, cached_run_id, resume_run_id, n_points, n_calls, est_source, est_in, est_out, est_cost_usd from plan", "plan", r="est_cost_usd"
    ),
    "work_plan_total": sql(
        f"""select n_cells, n_active, n_known, n_refused, round(total, 4) as total_cost_usd, concat_ws('; ', case when modes > 1 then 'mixed extraction modes: ' || mode_names end,
 case when forced > 0 then 'cells of forced-thinking models: ' || forced end, case when think > 0 and plain > 0 then 'thinking and non-thinking cells: ' || think || ' and ' || plain end,
 case when quantized > 0 then 'cells of quantized models: ' || quantized end,
 case when n_refused > 0 then 'refused cells: ' || (select string_agg(w || ' (' || n || ')', ', ' order by w || ' (' || n || ')') from (
  select case when starts_with(refused, 'duplicate of cell') then 'duplicates of other cells' else refused end as w, count(*) as n from plan where refused is not null group by 1)) end, case when n_known > 0 and n_known < n_active then 'total is a lower bound' end, case when total > {BUDGET} then 'over budget' end) as warnings
from (select count(*) as n_cells, count(*) filter (active) as n_active, count(est_cost_usd) filter (active) as n_known, count(refused) as n_refused,
 case when count(*) filter (active) = 0 then 0 else sum(est_cost_usd) filter (active) end as total, count(distinct mode) filter (refused is null) as modes, string_agg(distinct mode, ', ' order by mode) filter (refused is null) as mode_names,
 count(*) filter (refused is null and forced) as forced, count(*) filter (refused is null and thinking) as think, count(*) filter (refused is null and not thinking) as plain,
 count(quant) filter (refused is null) as quantized from plan)""",
        "plan",
    ),
    "metrics_freshness": sql(
        """select run_id, metrics_id, coalesce(fresh, false) as fresh from (select distinct run_id from att) left join (
 select 'r' || o_orderkey % 8 as run_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as metrics_id, arg_max(left(o_orderpriority, 1) not in ('1', '2'), (o_orderdate, o_orderkey)) as fresh
 from orders where o_custkey % 3 = 1 and o_custkey % 2 = 1 group by 1) using (run_id)""",
        "att",
    ),
    "run_key": sql(
        f"""select run_id, sha256('{{"config":{{"headers":{{"trace":"t"}},"n_samples":' || (repeat_idx + 1) || ',"temperature":1.0}},"mode":"' || extraction_mode || '","model":"' || coalesce(name, model_id)
 || '","provider":' || coalesce('"' || provider || '"', 'null') || ',"quant":' || coalesce('"' || quant || '"', 'null') || ',"repeat_idx":' || repeat_idx || ',"spec":"' || sha256({SPEC_DOC.format("'mask'")})
 || '","v":1,"version":"' || coalesce(rlog.resolved_version, name, model_id) || '"}}') as run_key
from rlog join (values {SPEC_ROWS}) v(spec_id, coord_format, template) using (spec_id) left join models using (model_id)""",
        "rlog",
        "models",
    ),
    "config_key": sql(
        """select position, sha256('{' || concat_ws(',', '"effort":"' || m.effort || '"', '"max_output_tokens":' || e.max_output_tokens, '"n_samples":' || e.n_samples,
 case when sys_len > 0 then '"system_prompt":"Answer in one word."' end, '"temperature":' || e.temperature, '"top_logprobs":' || e.top_logprobs) || '}') as config_key
from matrix m join eff e using (position)""",
        "matrix",
        "eff",
    ),
    "spec_key": sql(
        f"""select o_orderkey as place_id, sha256({SPEC_DOC.format("md5('mask' || o_orderkey % 3)")}) as spec_key
from orders join (values {SPEC_ROWS}) v(spec_id, coord_format, template) on spec_id = 's' || o_orderkey % 4"""
    ),
    "scrub_config": sql(
        """select c_custkey, '{"nation":' || c_nationkey || ',"provider":{"auth":[{"user":"u"}],"name":"p' || c_nationkey % 7 || '"},"segment":"' || c_mktsegment || '"}' as config
from customer"""
    ),
    "variant_parts": sql(
        """select position, variant, model_id as model_key, coalesce(effort, 'default') as effort, temperature::varchar as temperature_text,
 case when rep > 0 then variant || ' #' || (rep + 1) else variant end as label
from (select *, model_id || case when o = '' then '' else '@' || o end as variant from (
 select *, concat_ws(',', 'effort=' || effort, 'n_samples=' || n_samples, 'temperature=' || temperature) as o from matrix))""",
        "matrix",
    ),
    "run_filters": sql(
        """select run_id, strftime(created_at, '%Y-%m-%d') as created_at, 'complete of p3/m17' as asked from rlog where status = 'complete' and model_id = 'm17'
union all select run_id, strftime(created_at, '%Y-%m-%d'), 's1 of m10' from rlog where spec_id = 's1' and model_id = 'm10'""",
        "rlog",
    ),
    "runs_newest": sql(
        "select run_id, strftime(d, '%Y-%m-%d') as created_at from (select run_id, created_at as d from rlog)", "rlog"
    ),
    "table_checks": sql(
        """select 'runs' as "table", run_id as key, 'cost_usd not null' as rule from rlog where cost_usd is null
union all select 'runs', run_id, 'n_points_done' from rlog where n_points_done > 4000
union all select 'configs', c_custkey::varchar, 'n_samples 1..16' from customer where c_nationkey < 1 or c_nationkey > 16
union all select 'configs', c_custkey::varchar, 'temperature 0..2' from customer where c_acctbal < 0 or c_acctbal > 8000
union all select 'configs', c_custkey::varchar, 'repeats 1..100' from customer where c_custkey % 120 < 1 or c_custkey % 120 > 100
union all select 'configs', c_custkey::varchar, 'step divides 180' from customer where 180 % (c_nationkey + 1) <> 0
union all select 'runs', run_id, 'unknown model_id' from rlog where not exists (select 1 from part where p_partkey = 32 + n_points_done)
union all select 'configs', c_custkey::varchar, 'subset 0..1' from customer where c_custkey % 13 = 0 or c_custkey % 13 > 10
union all select 'configs', c_custkey::varchar, 'max_output_tokens over 0' from customer where c_custkey % 40 = 0
union all select 'configs', c_custkey::varchar, 'truth rule' from customer where c_mktsegment = 'FURNITURE'
union all select 'places', o_orderkey::varchar, 'latitude -90..90' from orders where abs(o_orderkey * 3700 % 18201 - 9050) > 9000
union all select 'places', o_orderkey::varchar, 'longitude -180..180' from orders where abs(o_custkey * 2500 % 43000 - 21500) > 18000
union all select 'metrics', o_orderkey::varchar, 'threshold 0..1' from orders where o_custkey % 23 > 20
union all select 'metrics', o_orderkey::varchar, 'n_points' from orders where o_orderkey % 50 = 0
union all select distinct 'points', run_id || ':' || idx, 'written after its run was complete' from att join rstate using (run_id) where status = 'complete' and updated_at > '{RUNS_ENDED}'""".replace("{RUNS_ENDED}", RUNS_ENDED),
        "rlog",
        "att",
        "rstate",
    ),
}
