"""Oracles of ``cellscore.plans.streams``: the batch forms."""

from __future__ import annotations

from cellscore.oracles import log
from cellscore.oracles.base import sql
from cellscore.plans.log import BUDGET

OVER = "coalesce(requests > rpm, false) or coalesce(tokens > tpm, false)"
LIMITS = "(select provider, rpm::int as rpm, tpm::int as tpm from (values ('p0', 1, 120), ('p1', 2, 60)) v(provider, rpm, tpm)) using (provider)"

ORACLES = {
    "stream_points_upsert": log.ORACLES["latest_points"],
    "stream_run_totals": sql(
        """select run_id, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round(sum(cost_usd), 9) + 0.0 as cost_usd,
 count(*) filter (error is null) as n_ok, count(error) as n_failed from attcost group by 1""",
        "attcost",
    ),
    "stream_rate_usage": sql(
        f"""select *, {OVER} as over_limit from (
select provider, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') as minute, count(*) as requests, sum(tokens)::bigint as tokens from calls
where date_trunc('minute', ts) + interval 1 minute <= (select max(ts) - interval 2 minute from calls) group by 1, 2) left join {LIMITS}""",
        "calls",
    ),
    "stream_rate_usage_sliding": sql(
        f"""select *, {OVER} as over_limit from (
select provider, strftime(b, '%Y-%m-%d %H:%M:%S') as minute, count(*) as requests, sum(tokens)::bigint as tokens
from (select *, time_bucket(interval 20 second, ts) - to_seconds(20 * k) as b from calls, (select range as k from range(3)))
where b + interval 1 minute <= (select max(ts) - interval 2 minute from calls) group by 1, 2) left join {LIMITS}""",
        "calls",
    ),
    "stream_dedupe": sql("select run_id, count(*) as n, sum(seq)::bigint as sum_seq from calls group by 1", "calls"),
    "stream_failure_bursts": log.ORACLES["failure_bursts"],
    "stream_budget_guard": sql(
        f"""select comparison, run_id, idx, strftime(updated_at, '%Y-%m-%d') as day, spent from (
select *, sum(coalesce(cost_usd, 0)) over (partition by comparison order by updated_at, ok, pk, ln, ep, run_id rows between unbounded preceding and current row) as spent,
 coalesce(cost_usd, 0) as own from attcost join members using (run_id)) where spent >= {BUDGET} and spent - own < {BUDGET}""",
        "attcost",
        "members",
        r="spent",
    ),
}
