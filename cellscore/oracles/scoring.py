"""Oracles of ``cellscore.plans.scoring``."""

from __future__ import annotations

from cellscore.functions.geo import ANCHORS, LAND_RULES, REGION_ORDER, WATER_RULES, rule_case
from cellscore.oracles.base import cte, sql
from cellscore.plans.scoring import THRESHOLDS

M = {
    "acc_area": "sum(w) filter (known and correct) / sum(w) filter (known)",
    "acc_unweighted": "avg(correct::int) filter (known)",
    "acc_valid_only": "sum(w) filter (known and valid and correct) / sum(w) filter (known and valid)",
    "baseline_area": "sum(w) filter (known and not t_land) / sum(w) filter (known)",
    "land_share_true": "sum(w) filter (known and t_land) / sum(w) filter (known)",
    "land_share_pred": "sum(w) filter (known and pred_land) / sum(w) filter (known)",
    "precision": "sum(w) filter (known and t_land and pred_land) / sum(w) filter (known and pred_land)",
    "recall": "sum(w) filter (known and t_land and pred_land) / sum(w) filter (known and t_land)",
    "f1": "2 * sum(w) filter (known and t_land and pred_land) / (sum(w) filter (known and pred_land) + sum(w) filter (known and t_land))",
    "iou": "sum(w) filter (known and t_land and pred_land) / sum(w) filter (known and (t_land or pred_land))",
    "brier": "sum(w * (p_land - t_land::int)^2) filter (known and valid) / sum(w) filter (known and valid)",
    "log_loss": "sum(-w * case when t_land then ln(greatest(p_land, 1e-6)) else ln(greatest(1 - p_land, 1e-6)) end) filter (known and valid) / sum(w) filter (known and valid)",
}
M["skill"] = f"({M['acc_area']} - {M['baseline_area']}) / (1 - {M['baseline_area']})"


def metrics(*names: str) -> str:
    cols = ", ".join(f"{M[n]} as {n}" for n in names)
    return sql(f"select run_id, {cols} from fl group by 1", "fl", r=" ".join(names))


PROB = "(extraction_mode = 'logprobs' or (extraction_mode = 'sample' and max_samples > 1))"
cte(
    "prob",
    f"""select run_id, extraction_mode, max_samples, {PROB} as probabilistic from runs
left join (select run_id, max(n_samples) as max_samples from pts group by 1) using (run_id)""",
    "runs",
    "pts",
)
cte(
    "bins",
    """select *, bin / 10 as lo, (bin + 1) / 10 as hi from (
select run_id, least(floor(p_land * 10), 9)::int as bin, sum(w * p_land) / sum(w) as mean_p,
  sum(w * t_land::int) / sum(w) as frac_land, sum(w) as weight, count(*) as n
from fl where known and valid group by 1, 2)""",
    "fl",
)
cte(
    "speed",
    """select run_id, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens,
 sum(thinking_tokens)::bigint as thinking_tokens, quantile_cont(latency_s, 0.5) as latency_p50,
 quantile_cont(latency_s, 0.95) as latency_p95 from pts group by 1""",
    "pts",
)
ANCHOR_ROWS = ", ".join(f"({i}, {a}, {b}, '{n}')" for i, (a, b, n) in enumerate(ANCHORS))
cte(
    "anchored",
    f"""select run_id, idx, label as anchor from (
select run_id, idx, label, row_number() over (partition by run_id, idx order by
  sin(radians(lat))*sin(radians(alat)) + cos(radians(lat))*cos(radians(alat))*cos(radians(lon) - radians(alon)) desc, i) as rn
from pts, (values {ANCHOR_ROWS}) a(i, alat, alon, label)) where rn = 1""",
    "pts",
)
cte(
    "labelled",
    f"""select fl.*, case when truth is null then 'Unknown' when lat >= 66.5 then 'Arctic'
 when lat < -60 and t_land then 'Antarctica' when lat < -60 then 'Southern Ocean'
 when t_land then coalesce({rule_case(LAND_RULES, "lat", "lon")}, anchor)
 else {rule_case(WATER_RULES, "lat", "lon")} end as region
from fl join anchored using (run_id, idx)""",
    "fl",
    "anchored",
)
POS = "list_position([" + ", ".join(f"'{x}'" for x in REGION_ORDER) + "], region)::int"
cte(
    "regacc",
    f"""select run_id, region, {POS} as position, sum(w * correct::int) / sum(w) as acc, sum(w) as weight, count(*) as n
from labelled where known group by 1, 2 having sum(w) > 0""",
    "labelled",
)
SWEEP = ", ".join(f"({t}::double)" for t in THRESHOLDS)
PIVOT = ", ".join(f"max(acc) filter (region = '{x}') as \"{x}\"" for x in REGION_ORDER)

ORACLES = {
    "accuracy_leaderboard": sql(
        f"select run_id, {M['acc_area']} as acc_area, {M['baseline_area']} as baseline_area, {M['skill']} as skill, "
        "count(*) as n_points from fl group by 1",
        "fl",
        r="acc_area baseline_area skill",
    ),
    "acc_area": metrics("acc_area"),
    "acc_unweighted": metrics("acc_unweighted"),
    "acc_valid_only": metrics("acc_valid_only"),
    "baseline_skill": metrics("baseline_area", "skill", "land_share_true", "land_share_pred"),
    "land_prf_iou": metrics("precision", "recall", "f1", "iou"),
    "brier_logloss": sql(
        f"""select run_id, case when probabilistic then brier end as brier, case when probabilistic then log_loss end as log_loss,
 probabilistic from (select run_id, {M['brier']} as brier, {M['log_loss']} as log_loss from fl group by 1) join prob using (run_id)""",
        "fl",
        "prob",
        r="brier log_loss",
    ),
    "calibration_bins": sql("select * from bins", "bins", r="lo hi mean_p frac_land weight"),
    "ece": sql(
        "select run_id, sum(weight * abs(mean_p - frac_land)) / sum(weight) as ece from bins group by 1", "bins", r="ece"
    ),
    "reliability_bins": sql(
        """select run_id, bin / 10 as bin_lo, (bin + 1) / 10 as bin_hi, mean_p, observed, count from (
select run_id, (select count(*) from range(1, 10) t(k) where p_land > k / 10) as bin, sum(w * p_land) / sum(w) as mean_p,
 sum(w * t_land::int) / sum(w) as observed, count(*) as count from fl where known and valid group by 1, 2)""",
        "fl",
        r="bin_lo bin_hi mean_p observed",
    ),
    "is_probabilistic": sql("select * from prob", "prob"),
    "volume_latency": sql(
        """select run_id, count(*) as n_points, count(p_land) as n_valid, count(*) - count(truth) as n_unknown_truth,
 avg((p_land is null)::int) as invalid_rate, any_value(s.input_tokens) as input_tokens, any_value(s.output_tokens) as output_tokens,
 any_value(s.thinking_tokens) as thinking_tokens, any_value(latency_p50) as latency_p50, any_value(latency_p95) as latency_p95
from pts join speed s using (run_id) group by 1""",
        "pts",
        "speed",
        r="invalid_rate latency_p50 latency_p95",
    ),
    "cell_metrics": sql(
        f"""select m.*, n_calibration_bins, s.* exclude (run_id), probabilistic, 0.5::double as threshold,
  case when probabilistic then brier_ end as brier, case when probabilistic then log_loss_ end as log_loss,
  case when probabilistic then ece_ end as ece
from (select run_id, count(*) as n_points, count(p_land) as n_valid, count(*) - count(truth) as n_unknown_truth,
  avg((p_land is null)::int) as invalid_rate, {", ".join(f"{M[n]} as {n}" for n in M if n not in ("brier", "log_loss"))} from fl group by 1) m
join (select run_id, {M['brier']} as brier_, {M['log_loss']} as log_loss_ from fl group by 1) using (run_id)
join prob using (run_id)
join speed s using (run_id)
join (select run_id, sum(weight * abs(mean_p - frac_land)) / sum(weight) as ece_, case when any_value(probabilistic) then count(*)::int end as n_calibration_bins
  from bins join prob using (run_id) group by 1) using (run_id)""",
        "fl",
        "prob",
        "bins",
        "speed",
        r="invalid_rate ece brier log_loss latency_p50 latency_p95 "
        + " ".join(n for n in M if n not in ("brier", "log_loss")),
    ),
    "threshold_sweep": sql(
        f"""select run_id, threshold, sum(w * correct::int) / sum(w) as acc_area,
 sum(w * correct::int) / sum(w) filter (valid) as acc_valid_only,
 (sum(w * correct::int) / sum(w) - sum(w * (not t_land)::int) / sum(w)) / (1 - sum(w * (not t_land)::int) / sum(w)) as skill,
 sum(w * pred::int) / sum(w) as land_share_pred,
 case when sum(w * pred::int) > 0 then sum(w * (pred and t_land)::int) / sum(w * pred::int) end as precision,
 sum(w * (pred and t_land)::int) / sum(w * t_land::int) as recall,
 2 * sum(w * (pred and t_land)::int) / (sum(w * t_land::int) + sum(w * pred::int)) as f1,
 sum(w * (pred and t_land)::int) / sum(w * (pred or t_land)::int) as iou
from (select run_id, threshold, w, valid, t_land, coalesce(p_land > threshold, false) as pred,
  coalesce((p_land > threshold) = t_land, false) as correct
  from fl, (values {SWEEP}) v(threshold) where known) group by 1, 2""",
        "fl",
        r="threshold acc_area acc_valid_only skill land_share_pred precision recall f1 iou",
    ),
    "point_flags": sql("select run_id, idx, w, known, t_land, valid, pred_land, correct from fl", "fl", r="w"),
    "error_class": sql(
        """select run_id, idx, case when truth is null then null when p_land is null then 3 when (p_land > 0.5)::int = truth then 0
 when truth = 0 then 1 else 2 end::int as error_code from pts""",
        "pts",
    ),
    "error_breakdown": sql(
        """select run_id, sum(w * correct::int) / sum(w) as correct, sum(w * (valid and pred_land and not t_land)::int) / sum(w) as false_land,
 sum(w * (valid and not pred_land and t_land)::int) / sum(w) as false_water, sum(w * (not valid)::int) / sum(w) as invalid,
 count(*) filter (valid and pred_land and not t_land) as n_false_land,
 count(*) filter (valid and not pred_land and t_land) as n_false_water, count(*) filter (not valid) as n_invalid
from fl where known group by 1""",
        "fl",
        r="correct false_land false_water invalid",
    ),
    "map_layer": sql(
        """select g.run_id, g.i::int as idx, p_land, (p_land > 0.5)::int as binary, case when truth is null then null
 when p_land is null then 3 when (p_land > 0.5)::int = truth then 0 when truth = 0 then 1 else 2 end::int as error_code,
 p.idx is not null as present
from (select run_id, range as i from runs, range(4050)) g left join pts p on g.run_id = p.run_id and g.i = p.idx""",
        "runs",
        "pts",
        r="p_land",
    ),
    "infer_grid": sql(
        """select run_id, min(gap) as step_deg, case when any_value(med) < 0.25 then 'cell_center' else 'cell_corner' end as placement
from (select run_id, v - lag(v) over (partition by run_id, axis order by v) as gap from (
  select distinct run_id, 0 as axis, lat as v from pts union all select distinct run_id, 1, lon from pts))
join (select run_id, median(abs((90 - lat) / 4 % 1 - 0.5)) as med from pts group by 1) using (run_id)
group by 1""",
        "pts",
        r="step_deg",
    ),
    "truncated_filter": sql(
        "select run_id, idx, finish_reason from pts where lower(finish_reason) in ('length', 'max_tokens', 'max_output_tokens')", "pts"
    ),
    "low_mass_filter": sql("select run_id, idx, validity_mass from pts where validity_mass < 0.5", "pts", r="validity_mass"),
    "region_label": sql(
        "select run_id, region, count(*) as n, sum(idx)::bigint as sum_idx from labelled group by 1, 2", "labelled"
    ),
    "nearest_anchor": sql("select * from anchored", "anchored"),
    "region_accuracy": sql("select * from regacc", "regacc", r="acc weight"),
    "region_heat": sql(
        """select run_id, region, case when region = 'Antarctica' then 3 when region like '%Ocean' or region like '%Sea' then 1
 when region = 'Arctic' then 2 else 0 end::int as col_group, acc, lo, hi, round_even((acc - lo) / (hi - lo) * 12, 0)::int as heat
from regacc, (select min(acc) as lo, max(acc) as hi from regacc)""",
        "regacc",
        r="acc lo hi",
    ),
    "region_table": sql(
        f"select run_id, {PIVOT} from regacc group by 1", "regacc", r=[f'"{x}"' for x in REGION_ORDER]
    ),
    "repeat_spread": sql(
        f"""select variant, count(*) as n, avg(a) as mean, coalesce(stddev_samp(a), 0) as std, min(a) as min, max(a) as max
from (select run_id, {M['acc_area']} as a from fl group by 1) join runs using (run_id) group by 1""",
        "fl",
        "runs",
        r="mean std min max",
    ),
    "run_health": sql(
        """select run_id, count(*) as done, count(*) filter (p_land is null and error is null) as n_invalid, count(error) as n_errors,
 count(*) filter (lower(finish_reason) in ('length', 'max_tokens')) as n_truncated,
 case when count(validity_mass) > 0 then count(*) filter (validity_mass < 0.5) / count(*) end as low_mass,
 quantile_cont(latency_s, 0.5) as p50, quantile_cont(latency_s, 0.95) as p95, coalesce(any_value(top), '') as top_error
from pts left join (select run_id, first(e order by n desc, e) as top from (
  select run_id, left(error, 80) as e, count(*) as n from pts where error is not null group by 1, 2) group by 1) using (run_id)
group by 1""",
        "pts",
        r="low_mass p50 p95",
    ),
    "latency_histogram": sql(
        """select run_id, bin, lo + bin * (hi - lo) / 60 as bin_lo, lo + (bin + 1) * (hi - lo) / 60 as bin_hi, n,
 (select quantile_cont(latency_s, 0.99) / greatest(quantile_cont(latency_s, 0.01), 1e-6) > 50 from pts where latency_s > 0) as log_axis
from (select run_id, any_value(lo) as lo, any_value(hi) as hi, bin, count(*) as n from (
  select run_id, lo, hi, least(floor((latency_s - lo) / ((hi - lo) / 60)), 59)::int as bin
  from pts join (select run_id, min(latency_s) as lo, max(latency_s) as hi from pts where latency_s > 0 group by 1) using (run_id)
  where latency_s > 0) group by run_id, bin)""",
        "pts",
        r="bin_lo bin_hi",
    ),
}
