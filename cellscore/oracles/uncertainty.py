"""Oracles of ``cellscore.plans.uncertainty``."""

from __future__ import annotations

from cellscore.oracles import scoring
from cellscore.oracles.base import cte, sql
from cellscore.sources.testbed import COMPARISONS

LAST = {name: ids for name, ids, _ in COMPARISONS}
cte(
    "members",
    "select * from (values "
    + ", ".join(f"('{n}', {i}, '{r}')" for n, ids in LAST.items() for i, r in enumerate(ids))
    + ") v(comparison, position, run_id)",
)
cte(
    "acc",
    "select run_id, sum(w * correct::int) / sum(w) as acc_area from fl where known group by 1",
    "fl",
)
cte(
    "ranked",
    """select comparison, run_id, acc_area, row_number() over (partition by comparison order by acc_area desc, run_id) as pos
from members join acc using (run_id)""",
    "members",
    "acc",
)
cte("pairs", """select distinct a.run_id as run_a, b.run_id as run_b from ranked a join ranked b using (comparison)
where a.pos < b.pos""", "ranked")
cte("shown", """select distinct a.run_id as run_a, b.run_id as run_b from ranked a join ranked b using (comparison)
where a.pos < b.pos and (a.pos = 1 or b.pos = a.pos + 1)""", "ranked")
BLOCK = "(least(floor((90 - lat) / 10), 17) * 36 + floor((lon + 180) / 10)::bigint % 36)::int"
cte(
    "blocks",
    f"""select run_id, {BLOCK} as block, sum(case when known then w * correct::int else 0 end) as num,
 sum(case when known then w else 0 end) as den from fl group by 1, 2""",
    "fl",
)


def draws(src: str, key: str, reps: int = 1000) -> str:
    """Which blocks (k, of those of ``src`` in order) each resample takes: the mixing of ``uncertainty.draw`` with seed 0."""
    return f"""select {key}, rep, (h3 % nb)::bigint as k from (
   select *, xor(h2m, h2m >> 16) as h3 from (select *, (xor(h2, h2 >> 15) * 48271) % 2147483647 as h2m from (
    select *, (xor(h1, h1 >> 13) * 16807 + pos * 39373 + 977) % 2147483647 as h2 from (
     select *, (rep * 48271 + 12345) % 2147483647 as h1 from (
      select {key}, k as pos, nb, rep from (select {key}, row_number() over (partition by {key} order by block) - 1 as k,
        count(*) over (partition by {key}) as nb from {src}), (select range as rep from range({reps})))))))"""


def boot(src: str, key: str, reps: int = 1000) -> str:
    """Interval of sum(num) / sum(den) of table ``src`` (key, block, num, den) over the resamples."""
    return f"""
select {key}, quantile_cont(s, 0.025) as lo, quantile_cont(s, 0.975) as hi from (
 select {key}, rep, case when sum(den) > 0 then sum(num) / sum(den) end as s from ({draws(src, key, reps)})
 join (select {key}, num, den, row_number() over (partition by {key} order by block) - 1 as k from {src}) using ({key}, k)
 group by {key}, rep) group by {key}"""


cte("ci", boot("blocks", "run_id"), "blocks")
cte(
    "prow",
    """select run_a, run_b, a.idx, a.lat, a.lon, a.w, a.known and b.known as known, a.correct as ca, b.correct as cb,
 coalesce(a.truth, b.truth) as truth,
 case when a.valid then a.pred_land::int else -1 end as aa, case when b.valid then b.pred_land::int else -1 end as ab
from pairs join fl a on a.run_id = run_a join fl b on b.run_id = run_b and b.idx = a.idx""",
    "pairs",
    "fl",
)
cte(
    "pblocks",
    f"""select run_a || ':' || run_b as pair, {BLOCK} as block, sum(case when known then w * (ca::int - cb::int) else 0 end) as num,
 sum(case when known then w else 0 end) as den from prow group by 1, 2""",
    "prow",
)
cte("pci", boot("pblocks", "pair"), "pblocks")
cte(
    "pdiff",
    """select run_a, run_b, diff, lo, hi, lo > 0 or hi < 0 as significant, n_paired, acc_a, acc_b from (
select run_a, run_b, run_a || ':' || run_b as pair, count(*) as n_paired,
 sum(w * (ca::int - cb::int)) filter (known) / sum(w) filter (known) as diff,
 sum(w * ca::int) filter (known) / sum(w) filter (known) as acc_a,
 sum(w * cb::int) filter (known) / sum(w) filter (known) as acc_b from prow group by 1, 2) join pci using (pair)""",
    "prow",
    "pci",
)
cte(
    "fold",
    """select comparison, run_id, acc_area, pos, pos as rank, run_id as leader from ranked where pos = 1
union all
select n.comparison, n.run_id, n.acc_area, n.pos, case when p.significant then n.pos else f.rank end,
 case when p.significant then n.run_id else f.leader end
from fold f join ranked n on n.comparison = f.comparison and n.pos = f.pos + 1
join pdiff p on p.run_a = f.leader and p.run_b = n.run_id""",
    "ranked",
    "pdiff",
)
cte("ranks", "select *, count(*) over (partition by comparison, rank) > 1 as tied from fold", "fold")
cte(
    "costs",
    """select run_id, sum((input_tokens * price_in + output_tokens * price_out) / 1e6) as cost_usd
from att join runs using (run_id) group by 1""",
    "att",
    "runs",
)
cte(
    "rs",
    """select comparison, run_id, acc_area, lo, hi, cost_usd, runs.* exclude (run_id), split_part(variant, '@', 1) as model_key,
 coalesce(nullif(regexp_extract(variant, 'effort=([^,]*)', 1), ''), 'default') as effort,
 case when repeat_idx > 0 then variant || ' #' || (repeat_idx + 1) else variant end as label
from members join acc using (run_id) join ci using (run_id) join costs using (run_id) join runs using (run_id)""",
    "members",
    "acc",
    "ci",
    "costs",
    "runs",
)
cte(
    "drow",
    """select run_a, run_b, idx, lat, case when aa = ab and aa = 1 then 'agree_land' when aa = ab then 'agree_water'
 when coalesce(aa = truth, false) then 'only_a' when coalesce(ab = truth, false) then 'only_b' else 'neither' end as cell_class from prow""",
    "prow",
)
cte(
    "dis",
    """select run_a, run_b, count(*) as n_both, count(*) filter (cell_class not like 'agree%') as n_disagree,
 sum(cos(radians(lat)) * (cell_class not like 'agree%')::int) / sum(cos(radians(lat))) as share_disagree_area,
 count(*) filter (cell_class = 'only_a') as n_only_a, count(*) filter (cell_class = 'only_b') as n_only_b from drow group by 1, 2""",
    "drow",
)
FRONT = """not exists (select 1 from rs o where o.comparison = rs.comparison and o.cost_usd is not null and (
 (o.cost_usd < rs.cost_usd and o.acc_area >= rs.acc_area) or (o.cost_usd = rs.cost_usd and o.acc_area > rs.acc_area)
 or (o.cost_usd = rs.cost_usd and o.acc_area = rs.acc_area and o.run_id < rs.run_id)))"""
PD = "diff lo hi acc_a acc_b"

ORACLES = {
    "block_sums": sql("select * from blocks", "blocks", r="num den"),
    "block_bootstrap_ci": sql(
        "select run_id, sum(num) / sum(den) as est, any_value(lo) as lo, any_value(hi) as hi from blocks join ci using (run_id) group by 1",
        "blocks",
        "ci",
        r="est lo hi",
    ),
    "paired_align": sql(
        "select run_a, run_b, count(*) as n_paired, 0::bigint as n_other_place, 0::bigint as n_other_truth from prow semi join shown using (run_a, run_b) group by 1, 2",
        "prow",
        "shown",
    ),
    "bootstrap_any_stat": sql("select * from ci100", "blocks", extra=f"ci100 as ({boot('kb', 'run_id')})".replace("ci100 as (", "kb as (select * from blocks where den > 0),\nci100 as ("), r="lo hi"),
    "bootstrap_median_confidence": sql(
        f"""select run_id, quantile_cont(s, 0.025) as lo, quantile_cont(s, 0.975) as hi from (
 select run_id, rep, quantile_cont(abs(p_land - 0.5), 0.5) as s from ({draws('blocks', 'run_id')})
 join (select run_id, {BLOCK} as block, p_land from fl) f using (run_id) join (
  select run_id, block, row_number() over (partition by run_id order by block) - 1 as k from blocks) b using (run_id, block, k)
 group by run_id, rep) group by run_id""",
        "fl",
        "blocks",
        r="lo hi",
    ),
    "paired_difference": sql("select * from pdiff semi join shown using (run_a, run_b)", "pdiff", "shown", r=PD),
    "pair_matrix": sql(
        """select * from pdiff semi join shown using (run_a, run_b) union all
select run_b, run_a, -diff, -hi, -lo, significant, n_paired, acc_b, acc_a from pdiff semi join shown using (run_a, run_b)""",
        "pdiff",
        "shown",
        r=PD,
    ),
    "rank_with_ties": sql("select comparison, run_id, acc_area, rank::int as rank, tied from ranks", "ranks", r="acc_area"),
    "leaderboard": sql(
        f"""select comparison, run_id, label, vendor, rank::int as rank, case when tied then '=' else '' end || rank as rank_label,
 case when tied and leader = run_id then 'leads runs whose difference to it has an interval that includes 0' when tied then 'the interval of the difference to the leader includes 0' end as tie_note,
 case when tied and leader <> run_id then lead.lead_label end as tie_with, case when tied then -pd.diff end as tie_diff, case when tied then -pd.hi end as tie_lo, case when tied then -pd.lo end as tie_hi, acc_area, rs.lo, rs.hi,
 acc_valid_only, skill, f1, invalid_rate, case when probabilistic and not mixed then brier_ end as brier,
 case when probabilistic and not mixed then ece_ end as ece, cost_usd, latency_p50, latency_p95, n_done, 4050 as n_total
from ranks join rs using (comparison, run_id, acc_area) left join pdiff pd on pd.run_a = leader and pd.run_b = run_id
left join (select distinct run_id as lead_run, label as lead_label from rs) lead on lead_run = leader
join (select run_id, {scoring.M['acc_valid_only']} as acc_valid_only, {scoring.M['skill']} as skill, {scoring.M['f1']} as f1,
  {scoring.M['brier']} as brier_, avg((not valid)::int) as invalid_rate, count(*) as n_done from fl group by 1) using (run_id)
join (select run_id, sum(weight * abs(mean_p - frac_land)) / sum(weight) as ece_ from bins group by 1) using (run_id)
join speed using (run_id) join (select run_id, probabilistic from prob) using (run_id)
join (select comparison, count(distinct extraction_mode) > 1 as mixed from rs group by 1) using (comparison)""",
        "ranks",
        "rs",
        "bins",
        "speed",
        "prob",
        "pdiff",
        r="acc_area lo hi acc_valid_only skill f1 invalid_rate brier ece cost_usd latency_p50 latency_p95 tie_diff tie_lo tie_hi",
    ),
    "leaderboard_filters": sql(
        """select comparison, run_id, label, vendor, acc_area, cost_usd from rs where vendor in ('v0', 'v1', 'v2')
 and thinking and extraction_mode = 'sample' and not forced_thinking""",
        "rs",
        r="acc_area cost_usd",
    ),
    "diff_pairs_topk": sql(
        "select * exclude (acc_a, acc_b) from pdiff join dis using (run_a, run_b)", "pdiff", "dis", r="diff lo hi share_disagree_area"
    ),
    "disagreement": sql("select * from dis semi join shown using (run_a, run_b)", "dis", "shown", r="share_disagree_area"),
    "disagreement_map": sql("select run_a, run_b, idx, cell_class from drow semi join shown using (run_a, run_b)", "drow", "shown"),
    "points_common": sql("select run_a, run_b, idx from prow semi join shown using (run_a, run_b)", "prow", "shown"),
    "pareto_frontier": sql(
        f"select comparison, run_id, cost_usd, acc_area from rs where cost_usd is not null and {FRONT}", "rs", r="cost_usd acc_area"
    ),
    "cost_vs_accuracy": sql(
        f"""select comparison, run_id, cost_usd, acc_area, {FRONT} as on_frontier, greatest((hi - acc_area) * 100, 0) as err_up,
 greatest((acc_area - lo) * 100, 0) as err_down, max(cost_usd) over (partition by comparison) / min(cost_usd) over (partition by comparison) > 20 as log_axis
from rs where cost_usd is not null""",
        "rs",
        r="cost_usd acc_area err_up err_down",
    ),
    "lineage": sql(
        """select comparison, vendor, model_key, run_id, acc_area, release_date from (
select *, row_number() over (partition by comparison, vendor, model_key order by acc_area desc, run_id) as rn from rs) where rn = 1""",
        "rs",
        r="acc_area",
    ),
    "effort_curve": sql(
        """select comparison, model_key, effort, case effort when 'default' then 0 when 'low' then 4 when 'high' then 6 end::int as position,
 avg(acc_area) as acc, avg(lo) as lo, avg(hi) as hi, count(*) as n_runs from rs
where (comparison, model_key) in (select (comparison, model_key) from rs group by comparison, model_key having count(distinct effort) > 1) group by 1, 2, 3""",
        "rs",
        r="acc lo hi",
    ),
}
