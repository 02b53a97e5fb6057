"""Oracles of ``cellscore.plans.extraction``."""

from __future__ import annotations

from cellscore.functions.text import PUNCTUATION, TOKEN_PREFIX
from cellscore.oracles import log  # noqa: F401  (shared expressions)
from cellscore.oracles.base import cte, sql
from cellscore.sources.testbed import ANSWERS, MODES, PIECES, SHORT_ANSWERS, SPECS, TOKENS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


P = q(PUNCTUATION)
SPACES = q("\u00a0\u2003\u2009\u3000\u2028\u0085")
cte(
    "said",
    rf"""select text, final as final_text, case when first in ('land', 'water') then first end as answer from (
select text, final, lower(list_filter(list_transform(string_split_regex(translate(final, {SPACES}, '      '), '\s+'), lambda w: trim(w, {P})), lambda w: w <> '')[1]) as first from (
 select text, case when regexp_matches(t, '(?i)</\s*(think|thinking|reasoning)\s*>') then regexp_replace(t, '(?is)^.*</\s*(think|thinking|reasoning)\s*>', '')
  when not regexp_matches(t, '(?i)<\s*(think|thinking|reasoning)\s*>') then t end as final
 from (select text, case when text like '%<|channel|>final<|message|>%'
   then regexp_replace(split_part(text, '<|channel|>final<|message|>', 2), '(?i)<\|[a-z_]+\|>', ' ', 'g') else text end as t
  from (select distinct unnest({lst(ANSWERS)}) as text))))""",
)
cte(
    "tok",
    f"""select token, case when n >= 2 and starts_with('land', t) then 'land' when n >= 2 and starts_with('water', t) then 'water'
 when starts_with(t, 'land') and trim(t[5:], {P} || ' ') = '' then 'land' when starts_with(t, 'water') and trim(t[6:], {P} || ' ') = '' then 'water' end as cls
from (select token, t, length(t) as n from (select token, lower(ltrim(token, {q(TOKEN_PREFIX)})) as t from (select unnest({lst(TOKENS)}) as token)))""",
)
cte(
    "resp",
    f"""select event_id, 'r' || user_id % 8 as run_id, ((event_id * 131 + user_id) % 4050)::int as idx, ts, event_type = 'error' as bad,
 {lst(MODES)}[user_id % 8 + 1] as mode0, user_id % 8 in (4, 5) or (user_id % 8 = 7 and event_id % 2 = 0) as has_lp,
 case event_id % 3 when 0 then 429 when 1 then 500 else 404 end as st, 50 + event_id % 9 as ti, 2 + event_id % 5 as tout from events""",
)
cte(
    "txt",
    f"""select event_id, j::int as j, {lst(ANSWERS)}[(event_id * 7 + j * 5) % 18 + 1] as text from resp, (select range as j from range(4)) where not bad""",
    "resp",
)
cte("txta", "select event_id, j, text, final_text, answer from txt join said using (text)", "txt", "said")
cte(
    "samp",
    """select event_id, count(*) filter (answer = 'land') / nullif(count(answer), 0) as p_land, count(answer)::int as n_valid, 4::int as n_samples, null::double as validity_mass
from txta group by 1""",
    "txta",
)
cte(
    "gree",
    "select event_id, case answer when 'land' then 1.0 when 'water' then 0.0 end::double as p_land, (answer is not null)::int as n_valid, 1::int as n_samples, null::double as validity_mass from txta where j = 0",
    "txta",
)
cte(
    "logp",
    f"""select event_id, land / nullif(land + water, 0) as p_land, (land + water > 0)::int as n_valid, 1::int as n_samples, least(land + water, 1) as validity_mass from (
select event_id, coalesce(sum(exp(-(0.5 + 0.25 * j))) filter (cls = 'land'), 0) as land, coalesce(sum(exp(-(0.5 + 0.25 * j))) filter (cls = 'water'), 0) as water
from resp, (select range as j from range(5)) left join tok on token = {lst(TOKENS)}[(event_id * 3 + j * 4) % 20 + 1] where not bad and has_lp group by 1)""".replace(
        "from resp, (select range as j from range(5)) left join", "from (select * from resp, (select range as j from range(5))) left join"
    ),
    "resp",
    "tok",
)
COLS = "event_id, run_id, idx, p_land, n_valid, n_samples, validity_mass"


def only(mode: str, table: str) -> str:
    return sql(f"select {COLS} from resp join {table} using (event_id) where not bad and mode0 = '{mode}'", "resp", table, r="p_land validity_mass")


def rest(n: str) -> str:
    return f"rtrim(printf('%04d', {n} % 10000), '0')"


def steps(x: str, n: int) -> str:
    return f"round_even(abs({x}) * {n}, 0)::bigint"


def signed(x: str) -> str:
    n = steps(x, 10000)
    return f"case when {x} < 0 and {n} > 0 then '-' else '' end || ({n} // 10000) || '.' || case {rest(n)} when '' then '0' else {rest(n)} end"


def lettered(x: str, style: str, plus: str, minus: str, seam: int) -> str:
    if style == "dms":
        n = steps(x, 3600)
        text, whole = f"""printf('%d°%02d''%02d"', {n} // 3600, {n} // 60 % 60, {n} % 60)""", seam * 3600
    else:
        n = steps(x, 10000)
        text, whole = f"({n} // 10000) || case {rest(n)} when '' then '' else '.' || {rest(n)} end || '°'", seam * 10000
    return f"{text} || case when {n} in (0, {whole}) then '' when {x} > 0 then ' {plus}' else ' {minus}' end"


def even(x: str, k: int) -> str:
    return f"printf('%.{k}f', abs(round_even({x}, {k})))"


def pair(style: str) -> str:
    return f"{lettered('lat', style, 'N', 'S', 0)} || ', ' || {lettered('wl', style, 'E', 'W', 180)}"


COORD = f"case coord_format when 'signed_decimal' then {signed('lat')} || ', ' || {signed('wl')} when 'dms' then {pair('dms')} else {pair('hemisphere')} end"
PLACES = {
    "{coord}": COORD, "{lat}": signed("lat"), "{lon}": signed("lon"), "{lon:.0f}": f"case when lon < 0 then '-' else '' end || {even('lon', 0)}",
    "{lat:+08.2f}": f"case when lat < 0 then '-' else '+' end || lpad({even('lat', 2)}, 7, '0')", "{lat:6.1f}": f"lpad(case when lat < 0 then '-' else '' end || {even('lat', 1)}, 6, ' ')",
}


def filled(template: str) -> str:
    for k, v in PLACES.items():
        template = f"replace({template}, '{k}', {v})"
    return template


SPEC_ROWS = ", ".join("(" + ", ".join(q(x) for x in row) + ")" for row in SPECS)
TOKS, SHORT = lst(TOKENS), lst(SHORT_ANSWERS)

ORACLES = {
    "extract_greedy": only("greedy", "gree"),
    "extract_sample": only("sample", "samp"),
    "extract_logprobs": only("logprobs", "logp"),
    "extract_auto": sql(
        f"""select resp.event_id, run_id, idx, case when mode0 <> 'auto' then mode0 when has_lp and not bad then 'logprobs' else 'sample' end as mode,
 x.p_land, coalesce(x.n_valid, 0)::int as n_valid, coalesce(x.n_samples, 0)::int as n_samples, x.validity_mass,
 case when bad then '' else left({lst(ANSWERS)}[(resp.event_id * 7) % 18 + 1], 200) end as answer_text, case when bad then 'HTTP ' || st end as error
from resp left join (select 'sample' as m, * from samp union all select 'greedy', * from gree union all select 'logprobs', * from logp) x
 on x.event_id = resp.event_id and m = case when mode0 <> 'auto' then mode0 when has_lp then 'logprobs' else 'sample' end""",
        "resp",
        "samp",
        "gree",
        "logp",
        r="p_land validity_mass",
    ),
    "strip_thinking": sql("select event_id, j, final_text, answer from txta", "txta"),
    "token_mass_merge": sql(
        f"""select event_id as response_id, translate({lst(PIECES)}[(event_id + j) % 6 + 1], 'Ġ▁Ċ', '  ' || chr(10)) as surface, ln(sum(exp(-(0.5 + 0.25 * j)))) as logprob
from events, (select range as j from range(5)) group by 1, 2""",
        r="logprob",
    ),
    "response_normalise": sql(
        f"""select event_id, case k when 3 then '' else trim({SHORT}[event_id % 4 + 1]) end as answer, case when k = 1 then null else 'hm' end as thinking, 'stop' as finish_reason,
 50 + event_id % 9 as input_tokens, 2 + event_id % 5 as output_tokens, event_id % 3 as thinking_tokens, 'v' || event_id % 3 as resolved_model,
 case when k = 3 then 1 when trim(tok) = '' then null else 5 + (not list_contains(alts, tok))::int end::int as n_alternatives,
 case when k = 3 then -0.01 when trim(tok) = '' then null else -5.0 - 0.1 * (not list_contains(alts, tok))::int end::double as sum_logprob
from (select event_id, event_id % 4 as k, {TOKS}[(event_id * 5 + 1) % 20 + 1] as tok,
  list_transform(range(5), lambda j: {TOKS}[(event_id * 3 + j * 4) % 20 + 1]) as alts from events)""",
        r="sum_logprob",
    ),
    "error_taxonomy": sql(
        """select run_id, count(*) filter (st = 429) as n_rate_limited, count(*) filter (st = 500) as n_retryable, count(*) filter (st = 404) as n_permanent,
 count(w) as n_with_retry_after, sum(w) as sum_retry_after_s from (select *, case when st = 429 then case event_id % 4 when 0 then greatest(event_id % 30 - 3, 0)
  when 1 then epoch(date_trunc('day', ts) + interval 1 day) - epoch(ts) when 2 then event_id % 5000 / 1000 end end as w from resp where bad) group by 1""",
        "resp",
        r="sum_retry_after_s",
    ),
    "batch_reconcile": sql(
        """select run_id, idx, coalesce(e, case when g.idx is null then 'no result in the batch' end) as error,
 round((ti * price_in + tout * price_out) / 1e6 * 0.5, 9) + 0.0 as cost_usd from (select distinct run_id, idx from resp) left join (
 select run_id, idx, case when arg_max(bad, event_id) then 'HTTP ' || arg_max(st, event_id) end as e, arg_max(ti, event_id) as ti, arg_max(tout, event_id) as tout
 from resp where event_id % 5 <> 4 group by 1, 2) g using (run_id, idx) join runs using (run_id)""",
        "resp",
        "runs",
    ),
    "prompt_table": sql(
        f"""select place_id, spec_id, case when lat between -90 and 90 and spec_id <> 's3' then
 {filled('template')} end as prompt
from (select o_orderkey as place_id, 's' || o_orderkey % 4 as spec_id, (o_orderkey * 3700 % 18201 - 9050)::double / 100 as lat, lon,
  case when lon between -180 and 180 then lon else (lon + 180) % 360 + case when (lon + 180) % 360 < 0 then 360 else 0 end - 180 end as wl
 from (select *, (o_custkey * 2500 % 43000 - 21500)::double / 100 as lon from orders))
join (values {SPEC_ROWS}) v(spec_id, coord_format, template) using (spec_id)"""
    ),
    "batch_scoring": sql(
        """select run_id, idx, case when abs(lat) > 80 then null when abs(lat) <= 35 then 'land' else 'water' end as answer,
 case when abs(lat) <= 80 then exp(case when abs(lat) <= 35 then -0.25 else -2 end) / (exp(-0.25) + exp(-2)) end::double as p_land,
 length(lat || ', ' || lon || '?')::int as input_tokens, (abs(lat) <= 80)::int as output_tokens, case when abs(lat) > 80 then 'out of range' end as error, true as timed
from (select run_id, idx, (88 - 4 * (idx // 90))::double as lat, (-178 + 4 * (idx % 90))::double as lon from missing)""",
        "missing",
        r="p_land",
    ),
}
