"""For each query in registry, the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from kinespark.operators.evaluators import TASKS
from kinespark.operators.masks import COMPONENTS
from kinespark.operators.scoring import OVERLAPS, TOLERANCES
from kinespark.operators.sensitivity import scenarios

TR = """tr as (
  select user_id as object_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
         (epoch(ts) - min(epoch(ts)) over (partition by user_id)) / 3600.0::double as t, value as x,
         cast(json_extract_string(props, '$.k') as double) as y, value as area, event_type <> 'error' as valid, event_type
  from events)"""
W = "over (partition by object_id order by frame)"


def r6(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def r2_status(r2: str, weak: str = "0.65", valid: str = "0.85") -> str:
    return f"case when {r2} is null then 'weak_valid' when {r2} >= {valid} then 'valid' when {r2} >= {weak} then 'weak_valid' else 'invalid' end"


LINEAR = f"""with {TR} select object_id, count(*) as n, {r6("abs(regr_slope(x, t))")} as speed, {r6("regr_r2(x, t)")} as r2, {r2_status("regr_r2(x, t)")} as status,
  case when regr_r2(x, t) >= 0.85 then '' when regr_r2(x, t) >= 0.65 then 'low_fit_r2' else 'fit_failed' end as reason from tr group by object_id"""


def quadratic(s: str, value: str) -> str:
    return f"""with {TR}, c as (select object_id, t - avg(t) over (partition by object_id) as u, {s} - avg({s}) over (partition by object_id) as v from tr),
    m as (select object_id, count(*) as n, sum(u*u) as s2, sum(u*u*u) as s3, sum(u*u*u*u) as s4, sum(u*v) as uv, sum(u*u*v) as uuv, sum(v*v) as vv from c group by object_id),
    f as (select *, s4 - s2*s2/n as w, s2 * (s4 - s2*s2/n) - s3*s3 as det from m),
    g as (select *, (s2*uuv - s3*uv) / det as a, (uv*w - s3*uuv) / det as b from f),
    h as (select object_id, n, {value} as acceleration, 1 - (vv - b*uv - a*uuv) / vv as r2 from g)
    select object_id, n, {r6("acceleration")} as acceleration, {r6("r2")} as r2, {r2_status("r2")} as status from h"""


AXIS = """c as (select object_id, t, x, y, x - avg(x) over (partition by object_id) as dx, y - avg(y) over (partition by object_id) as dy from tr),
  e as (select object_id, count(*) as n, sum(dx*dx) as xx, sum(dy*dy) as yy, sum(dx*dy) as xy from c group by object_id),
  ax as (select *, atan2(2*xy, xx - yy) / 2 as angle, sqrt((xx-yy)*(xx-yy) + 4*xy*xy) as root from e)"""
GRADIENT = """coalesce(
  ((t - lag(t) {w})*(t - lag(t) {w})*lead({s}) {w} + ((lead(t) {w} - t)*(lead(t) {w} - t) - (t - lag(t) {w})*(t - lag(t) {w}))*{s} - (lead(t) {w} - t)*(lead(t) {w} - t)*lag({s}) {w})
   / ((t - lag(t) {w}) * (lead(t) {w} - t) * (lead(t) {w} - lag(t) {w})),
  (lead({s}) {w} - {s}) / (lead(t) {w} - t), ({s} - lag({s}) {w}) / (t - lag(t) {w}))"""
SMOOTH = """ma as (select *, case when n < 5 then x else (sum(x) over (partition by object_id order by frame rows between 2 preceding and 2 following)
   + greatest(2 - i, 0) * first_value(x) over (partition by object_id order by frame) + greatest(i - (n - 3), 0) * last_value(x) over (partition by object_id order by frame rows between unbounded preceding and unbounded following)) / 5 end as s
  from (select *, row_number() over (partition by object_id order by frame) - 1 as i, count(*) over (partition by object_id) as n from tr))"""
NUM = "nu as (select *, row_number() over (partition by object_id order by frame) - 1 as i, count(*) over (partition by object_id) as n from tr)"
MID = f"{NUM}, mi as (select * from nu where i >= floor(n * 0.15) and i < ceil(n * 0.85))"

DET = """det as (
  select l_orderkey as video, l_linenumber as frame, l_partkey % 1500 as x1, l_suppkey * 37 % 800 as y1, l_partkey % 1500 + floor(l_quantity * 12)::bigint as x2, l_suppkey * 37 % 800 + floor(l_extendedprice / 250)::bigint as y2,
         l_quantity as quantity, l_discount * 10 as confidence, ['air', 'rail', 'reg air', 'truck'][l_linenumber % 4 + 1] as class_name, case when l_linestatus = 'O' then 'air-standard' else 'tracking_object' end as hint, (l_returnflag = 'R')::int as pass
  from lineitem)"""
RES = """res as (
  select r_name as model, o_orderpriority as metric, o_orderkey as prompt_id, o_totalprice as target, l.measured, l.discount, l.quantity, l.tax, l.lines,
         case o_orderstatus when 'F' then 'valid' when 'O' then 'weak_valid' else 'failed' end as status, case when l.flag = 'R' then 'flagged' else 'pass' end as tracking,
         abs(l.measured - o_totalprice) / greatest(abs(o_totalprice), 1e-12) as rel_error
  from orders join (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as measured, arg_min(l_returnflag, l_linenumber::varchar || l_returnflag) as flag, avg(l_discount) as discount, avg(l_quantity) as quantity, avg(l_tax) as tax, count(*) as lines
                    from lineitem group by l_orderkey) l on o_orderkey = l.l_orderkey
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def curve(v: str, good: float, bad: float, high: bool, gamma: str = "0.35") -> str:
    p = f"({v} - {good}) / ({bad} - {good})" if high else f"({good} - {v}) / ({good} - {bad})"
    return f"(1 - pow(least(greatest({p}, 0.0::double), 1.0::double), {gamma}))"


def scored(flag: str) -> str:
    """flag: the multiplier of flagged tracking."""
    return f"""{RES}, q as (select *, {curve("quantity / 50", 0.2, 0.9, True)} as qmask from res),
    g as (select *, tracking = 'pass' as tp, status in ('valid', 'weak_valid') as pp, case when tracking = 'pass' then 1.0 else {flag} end as tm from q),
    g2 as (select *, (tp or tm > 0) as adm from g), g3 as (select *, adm and pp as both_ from g2),
    sc as (select *, case when both_ then rel_error end as relative_error, case when both_ then 100 * exp(-rel_error / 0.25) end as base_score,
      case when not adm then 0.0 when status = 'valid' then 1.0 when status = 'weak_valid' then 0.8 else 0.0 end as sm, case when both_ then qmask end as mask_score,
      case when not adm then 0.0 when both_ then tm * qmask end as mm, case when both_ then qmask >= 0.999 else false end as mask_pass,
      case when not tp and not pp then 'both_tracking_and_physics' when not tp then 'tracking_only' when not pp then 'physics_only' else 'neither' end as discard_overlap,
      case when not adm then 'tracking_quality_failed' when not both_ then 'physics_status_not_valid' else '' end as exclusion_reasons from g3),
    s as (select *, exclusion_reasons = '' as effective, case when exclusion_reasons = '' then base_score * sm * tm * mask_score else 0.0 end as adjusted_score,
      case when not adm then 'fail' when not pp then 'not_evaluated' when mm <= 0 then 'fail' when tp and mask_pass and mm >= 0.999 then 'pass' else 'weak' end as measurement_status from sc)"""


def videos(flag: str) -> str:
    return f"""with {scored(flag)} select model, metric, prompt_id, {r6("relative_error")} as relative_error, {r6("base_score")} as base_score, sm::double as status_multiplier, tm::double as tracking_multiplier,
    {r6("mask_score")} as mask_score, measurement_status, {r6("mm")} as measurement_multiplier, discard_overlap, exclusion_reasons, effective, {r6("adjusted_score")} as adjusted_score from s"""


SUM = f"""count(*) as n_total, count(*) filter (both_) as n_both_gates_pass, count(*) filter (pp) as n_physics_pass, count(*) filter (tp) as n_tracking_pass, count(*) filter (mask_pass) as n_mask_pass,
  count(*) filter (measurement_status = 'pass') as n_measurement_pass, count(*) filter (effective) as n_effective, {r6("avg(adjusted_score) filter (effective)")} as effective_score, {r6("avg(base_score) filter (effective)")} as effective_base_score,
  {r6("avg(adjusted_score)")} as end_to_end_score, {r6("avg(mask_score)")} as mean_mask_score, {r6("avg(mm)")} as mean_measurement_multiplier, {r6("quantile_cont(relative_error, 0.5) filter (effective)")} as median_error_effective,
  {r6("quantile_cont(relative_error, 0.5) filter (both_)")} as median_error_both_gates, {r6("quantile_cont(relative_error, 0.9) filter (effective)")} as p90_error_effective,
  {r6("count(*) filter (effective) / count(*)")} as effective_rate, {r6("count(*) filter (tp) / count(*)")} as tracking_pass_rate"""

LINE_SHARE = {"area_ratio_p95_p05": "l_quantity / 50", "area_cv": "l_discount * 10", "max_log_jump": "case when l_linenumber < 5 or l_linenumber > 6 then l_tax * 10 end", "translation_aligned_iou_median": "l_quantity / 60", "middle_coverage": "l_discount * 5"}


def _line_score(n: str) -> str:
    g, b, h = COMPONENTS[n]
    value = f"({g} + ({b} - {g}) * ({LINE_SHARE[n]}))"
    return f"case when {value} is not null then {curve(value, g, b, h)} end"


def _grid() -> str:
    rows = ", ".join(f"('{s['scenario']}', '{s['family']}', {s['gamma']}::double, {s['weak_weight']}::double, {s['weak_cutoff']}::double, {s['valid_cutoff']}::double)" for s in scenarios())
    ac, mj = COMPONENTS["area_cv"], COMPONENTS["max_log_jump"]
    quality = f"least({curve(f'({ac[0]} + ({ac[1]} - {ac[0]}) * discount * 8)', *ac, 'gamma')}, {curve(f'({mj[0]} + ({mj[1]} - {mj[0]}) * tax * 10)', *mj, 'gamma')})"
    return f"""{RES}, sn as (select * from (values {rows}) t(scenario, family, gamma, weak_weight, weak_cutoff, valid_cutoff)),
    b0 as (select * replace (case when metric = '1-URGENT' then 'gravity' else metric end as metric), 1.0 - discount * 5 as fit_r2, metric in ('1-URGENT', '2-HIGH') as aff, metric = '1-URGENT' and prompt_id % 3 = 0 and prompt_id % 5 = 0 as still from res),
    b1 as (select * replace (case when aff and status <> 'failed' then case when still then 'valid' else {r2_status("fit_r2")} end else status end as status) from b0),
    gr as (select *, 100 * exp(-rel_error / case metric when 'gravity' then 0.30 else 0.25 end) as raw, case when aff and status <> 'failed' then case when still then 'valid' else {r2_status("fit_r2", "weak_cutoff", "valid_cutoff")} end else status end as new_status, {quality} as qmask from b1, sn),
    g as (select *, tracking = 'pass' and new_status in ('valid', 'weak_valid') as effective, case when tracking = 'pass' and new_status in ('valid', 'weak_valid') then raw * (case when new_status = 'valid' then 1 else weak_weight end) * qmask else 0.0 end as adjusted_score from gr),
    ma as (select scenario, family, model, avg(e) as effective_macro, avg(a) as end_to_end_macro from (select scenario, family, model, metric, avg(adjusted_score) filter (effective) as e, avg(adjusted_score) as a from g group by all) group by all)"""


GRID = _grid()


def _left(rest: str, best: str, name: str) -> str:
    """The boxes that stand apart from the best one of their video."""
    w, h = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1)", "greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1)"
    return f"""{name} as (select a.* from {rest} a join {best} b using (video) where a.candidate <> b.candidate and sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) >= 10 and {w} * {h} / (2 * 21 * 21 - {w} * {h}) <= 0.2)"""


_tasks = ", ".join(f"('{m}', '{e}', '{k}')" for m, (e, k) in TASKS.items())
_names = "[" + ", ".join(f"'{m}'" for m in [*TASKS, "unknown"]) + "]"
_tols = "[" + ", ".join(f"'{m}'" for m in [*TOLERANCES, "other"]) + "]"
_tolv = "[" + ", ".join(f"{t}" for t in [*TOLERANCES.values(), 0.25]) + "]"
#: The ten motions' results in closed form, from the mean of a user's values (a) and the number of frames (n); a pixel is 0.005 m.
GOLDEN = [
    "a * 0.005", "2 * a * 0.005", "20 * a * 0.005", "2 * a / 3 * 0.005 / 9.8", "(20 + u % 17) / 60.0", "1000 / (1 - 2 * a * 0.005 / 9.8)", "2 * 0.05 * 0.05 * 1000 * 9.8 / (9 * a * 0.005)",
    "4 * pi() * pi() * 0.2 / pow(0.4 * ceil(greatest(floor(0.15 * n), 2) / 12), 2)", "a * 0.005 * pow(2 * (n - 1) / 30 - 1 / 30, 2) / (2 * 9.8 * pow((n - 1) / 30, 2))", "abs((1 + u % 5 / 10) - 1)",
]
PX = f"""{TR}, ev as (select object_id as video, frame::integer as frame, floor(x % 95)::integer as x0, y::integer as k, floor(y % 20)::integer as top from tr where valid),
  px as (select video, frame, y, x from ev, range(0, 30) c(y), range(0, 100) d(x) where y between top and top + 9 and x between x0 and x0 + 9 + k % 5),
  geo as (select video, frame, count(*) as area, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2, avg(x) as cx, avg(y) as cy from px group by video, frame)"""
# pixel by pixel; the middle window is of all frames, with a mask or not
IOU = f"""{PX}, us as (select *, row_number() over (partition by video order by frame) - 1 as i, count(*) over (partition by video) as n from geo join (select object_id as video, count(*) as fr from tr group by 1) k using (video) where frame >= floor(fr * 0.15) and frame < ceil(fr * 0.85)),
  rf as (select video, frame as ref, cx as rx, cy as ry from us where i = n // 2 and n >= 2), pr as (select us.video, frame, ref, round_even(rx - cx, 0)::integer as dx, round_even(ry - cy, 0)::integer as dy from us join rf using (video) where i % 3 = 0 and i <> n // 2),
  mv as (select pr.video, pr.frame, pr.ref, a.x + dx as x, a.y + dy as y from pr join px a on a.video = pr.video and a.frame = pr.frame where a.x + dx between 0 and 99 and a.y + dy between 0 and 29),
  rp as (select pr.video, pr.frame, pr.ref, x, y from pr join px on px.video = pr.video and px.frame = pr.ref),
  un as (select video, frame, ref, count(*) as u from (select * from mv union select * from rp) group by all), co as (select video, frame, count(*) as c from mv join rp using (video, frame, ref, x, y) group by all),
  io as (select un.video, un.frame, ref, coalesce(c, 0) / u as iou from un left join co on co.video = un.video and co.frame = un.frame)"""

EDGES = f"""with {TR}, c as (select *, object_id % 12 as k, sqrt(4 * area / pi()) as da from tr),
  p as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as way from c where valid window w as (partition by object_id order by frame)),
  s as (select object_id, any_value(k) as k, count(*) as n, median(case when k = 2 then sqrt(50) when area > 0 then da end) as gate_dia from c group by object_id),
  e as (select object_id, count(*) as nv, regr_slope(case when k = 3 then x / 1000 else x end, t) as slope, regr_r2(case when k = 3 then x / 1000 else x end, t) as r2, coalesce(sum(way), 0) as path, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) as extent,
    median(case when k = 2 then sqrt(50) when k = 7 then 40.0 when area > 0 then da end) as dia from p group by object_id),
  j as (select s.*, coalesce(nv, 0) as nv, slope, r2, path, extent, dia, coalesce(nv, 0) / n >= 0.5 as counted, k in (4, 11) as unread from s left join e using (object_id)),
  m as (select *, case when k = 9 then 'unknown_evaluator:eval_x' when k in (4, 5, 10, 11) or nv = 0 then 'failed' when nv < 4 then 'insufficient_frames' end as why from j),
  v as (select *, case when why is null then abs(slope) * 0.1 / dia end as measured, case when why is not null then 'failed' else {r2_status("r2")} end as status,
    coalesce(why, case when r2 >= 0.85 then '' when r2 >= 0.65 then 'low_fit_r2' else 'fit_failed' end) as reason,
    list_sort(list_filter([case when not counted or k = 3 then 'object_count_mismatch' end, case when counted and extent / gate_dia < 0.75 then 'no_meaningful_motion' end, case when not counted then 'no_counted_object' end], lambda q: q is not null)) as rs from m)"""


def _slope(low: str, high: str, name: str) -> str:
    return f"{name} as (select object_id, count(*) as n, regr_slope(x, t) as slope, regr_r2(x, t) as r2 from ww where i >= {low} and i < {high} group by object_id)"


ESTIMATES = f"""with {TR}, {NUM}, r as (select *, ['velocity', 'acceleration', 'gravity', 'friction_coefficient', 'restitution_coefficient', 'density_from_initial_acceleration', 'fluid_viscosity', 'mechanical_energy_conservation'][object_id % 8 + 1] as metric,
    [9.8, 1.62, 5.0][object_id % 3 + 1]::double as ga, [9.8, 9.8, 5.0][object_id % 3 + 1]::double as gp from nu),
  fi as (select *, case when metric in ('gravity', 'density_from_initial_acceleration') then y else x end as s0 from r where metric <> 'density_from_initial_acceleration' or i < greatest(6, n // 3)),
  c as (select object_id, t - avg(t) over (partition by object_id) as u, s0 - avg(s0) over (partition by object_id) as v from fi),
  k as (select object_id, count(*) as fn, sum(u*u) as s2, sum(u*u*u) as s3, sum(u*u*u*u) as s4, sum(u*v) as uv, sum(u*u*v) as uuv, sum(v*v) as vv from c group by object_id),
  k2 as (select *, s4 - s2*s2/fn as w, s2 * (s4 - s2*s2/fn) - s3*s3 as det from k), k3 as (select *, (s2*uuv - s3*uv) / det as a, (uv*w - s3*uuv) / det as b from k2),
  fit as (select object_id, fn, uv / s2 as slope, uv * uv / (s2 * vv) as lr2, case when fn >= 4 then a end as a, 1 - (vv - b*uv - a*uuv) / vv as qr2 from k3),
  d as (select object_id, x - avg(x) over (partition by object_id) as dx, y - avg(y) over (partition by object_id) as dy from r), e as (select object_id, sum(dx*dx) as xx, sum(dy*dy) as yy, sum(dx*dy) as xy from d group by object_id),
  od as (select object_id, 1 - greatest((xx + yy - sqrt((xx-yy)*(xx-yy) + 4*xy*xy)) / 2, 0) / ((xx + yy + sqrt((xx-yy)*(xx-yy) + 4*xy*xy)) / 2) as one_dim from e),
  gr as (select *, {GRADIENT.format(s="x", w=W)} as vx, {GRADIENT.format(s="y", w=W)} as vy from r), fr as (select object_id, arg_min(abs(vx), i) as v_first, arg_max(abs(vx), i) as v_last, arg_min(y, i) as y0, arg_max(i, (y, -i)) as low from gr group by object_id),
  lo as (select gr.object_id, gr.i as low_i, (gr.y - y0) * 0.01 as fall, (gr.vx * gr.vx + gr.vy * gr.vy) * 0.0001 as speed2 from gr join fr on fr.object_id = gr.object_id and fr.low = gr.i),
  z as (select *, case metric when 'fluid_viscosity' then vy else vx end as g from gr), sm as (select *, (sum(g) over (partition by object_id order by frame rows between 2 preceding and 2 following) + greatest(2 - i, 0) * first_value(g) over (partition by object_id order by frame)
    + greatest(i - (n - 3), 0) * last_value(g) over (partition by object_id order by frame rows between unbounded preceding and unbounded following)) / 5 as v from z),
  nx as (select *, lead(v) {W} as nv from sm), ev as (select object_id, arg_max(i, abs(v) + abs(nv)) + 1 as event from nx where sign(v) * sign(nv) < 0 and abs(v) > 1e-6 and abs(nv) > 1e-6 group by object_id),
  ww as (select r.*, event, greatest(4, least(10, n // 6)) as w from r join ev using (object_id)), {_slope("event - w", "event - 1", "bf")}, {_slope("event + 1", "event + w + 2", "af")},
  sa as (select object_id, list(v * 0.01 order by frame) as v, any_value(n) as n, greatest(5, any_value(n) // 5) as w from sm group by object_id having any_value(n) >= 10),
  sk as (select object_id, n, v, w, unnest(range(greatest(1, n - 2*w), n - w + 1)) as start from sa), st as (select *, list_avg(list_slice(v, start + 1, start + w)) as mean, list_stddev_pop(list_slice(v, start + 1, start + w)) as sd from sk),
  sv as (select object_id, mean, sd / abs(mean) as rel from st where abs(mean) > 1e-9 qualify row_number() over (partition by object_id order by sd / abs(mean) + 0.02 * (n - start), start) = 1),
  al as (select m.*, fit.*, one_dim, v_first, v_last, low_i, fall, speed2, event, bf.n as bn, bf.slope as bs, bf.r2 as br2, af.n as an, af.slope as as_, af.r2 as ar2, mean, rel from (select distinct object_id as oid, metric, n, ga, gp from r) m
    join fit on fit.object_id = oid join od on od.object_id = oid join fr on fr.object_id = oid join lo on lo.object_id = oid left join ev on ev.object_id = oid left join bf on bf.object_id = oid left join af on af.object_id = oid left join sv on sv.object_id = oid),
  wh as (select *, case metric when 'velocity' then case when n < 4 then 'insufficient_frames' end when 'acceleration' then case when n < 5 then 'insufficient_frames' end when 'gravity' then case when n < 5 then 'insufficient_frames' end
    when 'friction_coefficient' then case when n < 8 then 'insufficient_frames' when one_dim < 0.75 then 'motion_not_1d' end
    when 'restitution_coefficient' then case when n < 10 then 'insufficient_frames' when event is null then 'event_not_detected' when coalesce(bn, 0) < 3 or coalesce(an, 0) < 3 then 'insufficient points in fit window' end
    when 'density_from_initial_acceleration' then case when n < 8 then 'insufficient_frames' end when 'fluid_viscosity' then case when n < 12 then 'insufficient_frames' when rel is null or rel > 0.35 then 'terminal velocity segment not found' when mean <= 1e-12 then 'terminal_velocity_not_found' end
    else case when n < 10 then 'insufficient_frames' when low_i <= 1 then 'event_not_detected' when fall <= 1e-5 then 'fit_failed' end end as why from al),
  va as (select *, case metric when 'velocity' then abs(slope) * 0.01 when 'acceleration' then abs(2 * a * 0.01) when 'gravity' then abs(2 * a * 0.01) when 'friction_coefficient' then abs(2 * a * 0.01) / ga when 'restitution_coefficient' then abs(as_) / abs(bs)
      when 'density_from_initial_acceleration' then 1000 / (1 - 2 * a * 0.01 / gp) when 'fluid_viscosity' then 2 * 0.0025 * 1000 * gp / (9 * mean) else speed2 / (2 * ga * fall) end as measured,
    case metric when 'velocity' then lr2 when 'restitution_coefficient' then least(br2, ar2) when 'fluid_viscosity' then 1 - least(rel, 1.0) when 'mechanical_energy_conservation' then null else qr2 end as r2 from wh)
  select oid::varchar as video, metric, {r6("case when why is null then measured end", 5)} as measured, {r6("case when why is null then r2 end", 5)} as fit_r2,
    case when why is not null then 'failed' when metric = 'mechanical_energy_conservation' then 'valid' when metric in ('restitution_coefficient', 'fluid_viscosity') then case when r2 >= 0.75 then 'valid' else 'weak_valid' end
      when metric = 'friction_coefficient' and r2 >= 0.85 and v_last >= v_first then 'weak_valid' else {r2_status("r2")} end as status,
    case when why is not null then why when metric = 'mechanical_energy_conservation' then '' when metric = 'restitution_coefficient' then case when r2 >= 0.75 then '' else 'low_fit_r2' end when metric = 'fluid_viscosity' then case when r2 >= 0.75 then '' else 'terminal_velocity_weak' end
      when metric = 'friction_coefficient' and r2 >= 0.85 and v_last >= v_first then 'velocity_not_decreasing' when r2 >= 0.85 then '' when r2 >= 0.65 then 'low_fit_r2' else 'fit_failed' end as reason from va"""

SQL: dict[str, str] = {
    "velocity_fit": LINEAR,
    "acceleration_fit": quadratic("x", "2 * a"),
    "gravity_fit": quadratic("y", "abs(2 * a)"),
    "pca_axis_speed": f"with {TR}, {AXIS}, q as (select c.object_id, t, x * cos(angle) + y * sin(angle) as s from c join ax using (object_id)) select object_id, {r6('abs(regr_slope(s, t))')} as speed, {r6('regr_r2(s, t)')} as r2 from q group by object_id",
    "one_dim_score": f"with {TR}, {AXIS} select object_id, n, {r6('case when n < 3 then 0 else 1 - greatest((xx + yy - root) / 2, 0) / ((xx + yy + root) / 2) end')} as one_dim from ax",
    "gradient_velocity": f"with {TR} select object_id, frame, {r6(GRADIENT.format(s='x', w=W), 4)} as v from tr",
    "moving_average5": f"with {TR}, {SMOOTH} select object_id, frame, {r6('s')} as smooth from ma",
    "primary_object": f"with {TR}, c as (select event_type, object_id, count(*) as n from tr group by all) select event_type, object_id, n from c qualify row_number() over (partition by event_type order by n desc, object_id) = 1",
    "two_objects": f"with {TR}, c as (select event_type, object_id, count(*) as n from tr group by all) select event_type, object_id, row_number() over (partition by event_type order by n desc, object_id) as place, n from c qualify place <= 2",
    "size_cv": f"with {TR} select object_id, {r6('stddev_pop(area) / greatest(avg(area), 1e-12)')} as cv, {r6('quantile_cont(area, 0.5)')} as median from tr group by object_id",
    "coverage": f"with {TR} select object_id, {r6('count(*) / (max(frame) - min(frame) + 1)')} as coverage from tr where valid group by object_id",
    "middle_window_stats": f"with {TR}, {MID}, j as (select *, abs(ln(area) - ln(lag(area) {W})) as jump from mi) select object_id, count(*) as n, {r6('quantile_cont(area, 0.05)')} as p05, {r6('quantile_cont(area, 0.5)')} as p50, {r6('quantile_cont(area, 0.95)')} as p95, {r6('max(jump)')} as max_jump from j group by object_id",
    "centroid_steps": f"with {TR}, v as (select * replace (case when valid then x end as x) from tr), s as (select *, sqrt(pow(x - lag(x) {W}, 2) + pow(y - lag(y) {W}, 2)) as step from v) select object_id, count(step) as n, {r6('max(step)')} as longest, {r6('sum(step)')} as path from s group by object_id",
    "frame_details": f"""with {TR}, v as (select *, case when valid then x end as cx, case when valid then y end as cy from tr), p as (select *, last_value(cx ignore nulls) over (partition by object_id order by frame rows between unbounded preceding and 1 preceding) as px, last_value(cy ignore nulls) over (partition by object_id order by frame rows between unbounded preceding and 1 preceding) as py from v),
      s as (select *, case when cx is not null then sqrt(pow(cx - px, 2) + pow(cy - py, 2)) end as step from p) select object_id, frame, {r6('step')} as step, {r6('step / sqrt(4 * area / pi())')} as step_norm from s""",
    "scan_frame_sampling": f"with {TR}, {NUM} select object_id, frame from nu where n <= 20 or list_contains(list_transform(range(20), lambda j: cast(floor(j * (n - 1) / 19) as bigint)), i)",
    "stride_sample": f"with {TR}, {NUM} select object_id, frame from nu where i % 5 = 0 or i = n // 2",
    "densify_frames": f"with {TR}, l as (select object_id, max(frame) as m from tr where valid group by object_id), a as (select object_id, unnest(range(m + 1)) as frame from l) select a.object_id, a.frame, t.x, t.x is not null as there from a left join (select * from tr where valid) t on a.object_id = t.object_id and a.frame = t.frame",
    "steady_velocity": f"""with {TR}, {SMOOTH}, a as (select object_id, list(s order by frame) as v, any_value(n) as n, greatest(5, any_value(n) // 5) as w from ma group by object_id having any_value(n) >= 10),
      k as (select object_id, n, v, w, unnest(range(greatest(1, n - 2*w), n - w + 1)) as start from a), m as (select *, list_avg(list_slice(v, start + 1, start + w)) as mean, list_stddev_pop(list_slice(v, start + 1, start + w)) as sd from k),
      b as (select *, sd / abs(mean) as rel, sd / abs(mean) + 0.02 * (n - start) as score from m where abs(mean) > 1e-9) select object_id, start, {r6('mean')} as mean, {r6('rel')} as rel from b qualify row_number() over (partition by object_id order by score, start) = 1""",
    "golden_estimates": f"""with {TR}, g as (select object_id as u, count(*) as n, avg(x) as a from tr group by object_id)
      select u::varchar as video, [{", ".join(f"'{m}'" for m in TASKS)}][u % 10 + 1] as metric, {r6("case u % 10 " + " ".join(f"when {k} then {v}" for k, v in enumerate(GOLDEN)) + " end")} as measured,
        case when u % 10 = 7 then 'weak_valid' else 'valid' end as status, case when u % 10 = 7 then 'period_detection_weak' else '' end as reason from g""",
    "event_estimates": ESTIMATES,
    "track_normalize": f"with {TR} select object_id, frame, {r6('t')} as t, {r6('x')} as cx, {r6('y')} as cy, {r6('sqrt(4 * area / pi())')} as diameter from tr where valid",
    "scale_modes": f"""with {TR}, z as (select object_id, median(sqrt(4 * area / pi())) filter (area > 0) as dia, (median(x) filter (x > 0) + median(y) filter (y > 0)) / 2 as side, ['none', 'object_diameter', 'explicit_object_size', 'explicit_height', 'other'][cast(object_id % 5 + 1 as integer)] as scale_mode from tr group by object_id)
      select object_id, scale_mode, {r6("case scale_mode when 'object_diameter' then 0.5 / dia when 'explicit_object_size' then 0.5 / side end", 9)} as scale, case scale_mode when 'explicit_height' then 'explicit_height_not_implemented' when 'other' then 'unknown_scale_mode:other' else '' end as reason from z""",
    "tracking_gate": f"""with {TR}, r as (select object_id % 25 as video, object_id, frame, x, y, x > 50 as ok, sqrt(area) as dia from tr), fr as (select video, count(distinct frame) as frames from r group by video),
      p as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as way from r where ok window w as (partition by video, object_id order by frame)),
      o as (select video, object_id, count(*) as nv, coalesce(sum(way), 0) as path, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) as extent from p group by all),
      dd as (select video, object_id, quantile_cont(dia, 0.5) filter (dia > 0) as dia, min(frame) as ff from r group by all), j as (select dd.*, coalesce(nv, 0) as nv, path, extent, frames, coalesce(nv, 0) / greatest(frames, 1) >= 0.5 as counted from dd left join o using (video, object_id) join fr using (video)),
      c as (select video, any_value(frames) as frames, count(*) filter (counted) as counted from j group by video), b as (select * exclude (counted, frames) from j where counted qualify row_number() over (partition by video order by nv desc, ff, object_id) = 1),
      z as (select c.video, frames, counted, coalesce(object_id, -1) as primary_object, path / dia as pn, extent / dia as en, list_sort(list_filter([case when counted <> 1 then 'object_count_mismatch' end, case when extent / dia < 0.75 then 'no_meaningful_motion' end, case when counted = 0 then 'no_counted_object' end], lambda q: q is not null)) as rs from c left join b on b.video = c.video)
      select video, frames, counted, primary_object, {r6('pn')} as path_norm, {r6('en')} as extent_norm, array_to_string(rs, ';') as reasons, case when len(rs) = 0 then 'pass' else 'flagged' end as status from z""",
    "mask_reasons_decision": f"""with {TR}, {NUM}, mi as (select object_id, frame, case when ok then area end as a, case when ok then x end as w, case when ok then y + 1 end as h, case when ok then y end as cy, case when ok then x end as cx from (select *, valid and (object_id % 10 <> 0 or frame % 9 = 0) as ok from nu) where i >= floor(n * 0.15) and i < ceil(n * 0.85)),
      st as (select *, sqrt(pow(cx - lag(cx) {W}, 2) + pow(cy - lag(cy) {W}, 2)) as step, greatest(w / h, h / w) as asp from mi),
      sh as (select object_id, count(*) as n_middle, count(a) as n_valid, quantile_cont(a, 0.05) as p05, quantile_cont(a, 0.95) as p95, stddev_pop(a) / avg(a) as area_cv, stddev_pop(w) / avg(w) as wcv, stddev_pop(h) / avg(h) as hcv, stddev_pop(asp) / avg(asp) as acv, max(step) as ms, median(sqrt(4 * a / pi())) as dia from st group by object_id),
      va as (select *, row_number() {W} - 1 as k, count(*) over (partition by object_id) as m, abs(ln(a) - ln(lag(a) {W})) as jump from mi where a is not null),
      ju as (select object_id, max(jump) as mj, exp(abs(arg_max(ln(a), k) - arg_min(ln(a), k))) as tsr, regr_r2(ln(a), k / greatest(m - 1, 1)) as tr2 from va group by object_id),
      z as (select object_id, n_middle, n_valid, n_valid / n_middle as mc, case when n_valid >= 6 and p05 > 0 then p95 / p05 end as ratio, case when n_valid >= 6 then area_cv end as area_cv, case when n_valid >= 2 then wcv end as wcv, case when n_valid >= 2 then hcv end as hcv, case when n_valid >= 2 then acv end as acv, mj, case when n_valid >= 6 then tsr end as tsr, case when n_valid >= 6 then coalesce(tr2, 0) end as tr2, ms / dia as cs from sh left join ju using (object_id)),
      y as (select *, list_filter([case when n_valid < 6 then 'insufficient_valid_middle_frames' end, case when mc < 0.7 then 'low_middle_coverage' end, case when ratio > 2 then 'large_area_ratio' end, case when area_cv > 0.25 then 'large_area_cv' end, case when mj > 0.45 then 'sudden_area_jump' end,
        case when wcv > 0.2 then 'large_bbox_width_cv' end, case when hcv > 0.2 then 'large_bbox_height_cv' end, case when acv > 0.2 then 'large_bbox_aspect_cv' end, case when cs > 2.5 then 'large_centroid_jump' end, case when tsr >= 1.6 and tr2 >= 0.65 and not coalesce(mj > 0.45, false) then 'smooth_scale_change_possible_depth_motion' end], lambda q: q is not null) as rs from z)
      select object_id, n_middle, n_valid, {r6('mc')} as middle_coverage, {r6('ratio')} as area_ratio_p95_p05, {r6('area_cv')} as area_cv, {r6('wcv')} as bbox_width_cv, {r6('mj')} as max_log_jump, {r6('tsr')} as trend_scale_ratio, {r6('tr2')} as trend_r2, {r6('cs')} as max_centroid_step_norm_by_diameter, array_to_string(rs, ';') as reasons,
        case when len(rs) = 0 then 'keep' when list_contains(rs, 'large_centroid_jump') then 'rerun_tracking' when list_contains(rs, 'sudden_area_jump') then 'rerun_tracking_or_reject' when list_contains(rs, 'smooth_scale_change_possible_depth_motion') then 'reject_or_verify_plane_motion'
          when list_has_any(rs, ['large_area_ratio', 'large_area_cv', 'large_bbox_width_cv', 'large_bbox_height_cv', 'large_bbox_aspect_cv']) then 'review_or_reject_plane_motion' else 'rerun_tracking' end as decision,
        case when len(rs) = 0 then 'pass' when list_has_any(rs, ['insufficient_valid_middle_frames', 'low_middle_coverage']) then 'fail' else 'warn' end as status from y""",
    "mask_geometry": f"with {PX} select video, frame, area, x1, y1, x2, y2, {r6('cx')} as cx, {r6('cy')} as cy from geo",
    "mask_run_iou": f"with {IOU} select video, frame, ref, {r6('iou')} as iou from io",
    "mask_iou_stats": f"with {IOU} select video, {r6('median(iou)')} as iou_median, {r6('min(iou)')} as iou_min, count(*) as iou_n, any_value(ref) as iou_frame from io group by video",
    "component_scores": " union all ".join(f"select '{n}' as component, count(*) as n, {r6('avg(s)')} as mean, {r6('min(s)')} as least, count(*) filter (s >= 1) as perfect from (select {_line_score(n)} as s from lineitem) where s is not null" for n in LINE_SHARE),
    "qmask_min": f"""with o as (select l_orderkey, least({', '.join(map(_line_score, LINE_SHARE))}) as s, l_quantity > 45 as big from lineitem), v as (select l_orderkey, count(*) as objects, min(s) as score, bool_or(big) as flagged from o group by l_orderkey)
      select l_orderkey, objects, {r6('score')} as score, case when score <= 0 then 'fail' when score >= 0.999 and not flagged then 'pass' else 'weak' end as status, case when flagged then 'large_area_ratio' else '' end as reasons from v""",
    "relative_error_rules": f"""with {RES} select prompt_id, {r6('''coalesce(case when lines = 7 then 0.5 end, case when lines % 3 = 0 then abs(measured) else
        abs(measured - coalesce(case when lines % 4 <> 0 then target end, case when lines % 2 = 0 then 1.0 end)) / greatest(abs(coalesce(case when lines % 4 <> 0 then target end, case when lines % 2 = 0 then 1.0 end)), 1e-12) end)''', 4)} as scoring_error, {r6('abs(measured - target) / abs(target)', 4)} as estimate_error from res""",
    "video_scores": videos("0.0"),
    "policy_penalty": videos("0.5"),
    "policy_ignore": videos("1.0"),
    "metric_summary": f"with {scored('0.0')} select model, metric, {SUM} from s group by model, metric",
    "selected_percentiles": f"""select l_returnflag, l_linestatus, {r6('quantile_cont(l_extendedprice, 0.05)')} as p05, {r6('quantile_cont(l_extendedprice, 0.5)')} as p50, {r6('quantile_cont(l_extendedprice, 0.95)')} as p95,
      {r6('quantile_cont(l_extendedprice * (l_discount - 0.05), 0.5)')} as net_p50 from lineitem group by all""",
    "model_macro_summary": f"""with {scored('0.0')}, m as (select model, metric, avg(adjusted_score) filter (effective) as e, avg(adjusted_score) as a from s group by all)
      select s.model, count(*) as n_total, count(*) filter (effective) as n_effective, {r6('count(*) filter (effective) / count(*)')} as effective_rate, {r6('avg(mask_score)')} as mean_mask_score, {r6('any_value(k.e)')} as overall_effective_score, {r6('any_value(k.a)')} as overall_end_to_end_score
      from s join (select model, avg(e) as e, avg(a) as a from m group by model) k on k.model = s.model group by s.model""",
    "reason_token_counts": f"with {scored('0.0')}, t as (select unnest(string_split(case when exclusion_reasons = '' then '' else exclusion_reasons || ';excluded;' end, ';')) as reason from s) select reason, count(*) as n from t where reason <> '' group by reason",
    "discard_overlap": f"with {scored('0.0')} select model, " + ", ".join(f"count(*) filter (discard_overlap = '{o}') as {o}, {r6(f'''count(*) filter (discard_overlap = '{o}') / count(*)''')} as {o}_rate" for o in OVERLAPS) + " from s group by model",
    "status_histogram": f"with {RES} select metric, status as value, count(*) as n from res group by all",
    "completeness_problems": """with g as (select o_custkey::varchar as id, count(*) as n from orders group by 1), w as (select c_custkey::varchar as id, count(*) as n from customer group by 1)
      select 'missing' as problem, id, n from w where id not in (select id from g) union all select 'unexpected', id, n from g where id not in (select id from w) union all select 'repeated_result', id, n from g where n > 1 union all select 'repeated_metadata', id, n from w where n > 1""",
    "task_defaults_lookup": f"""with t as (select * from (values {_tasks}) t(Metric, Evaluator, Measurement_Method)), m as (select {_names}[o_orderkey % 11 + 1] as Metric from orders)
      select m.Metric as "Metric", t.Evaluator as "Evaluator", t.Measurement_Method as "Measurement_Method", count(*) as n from m left join t on t.Metric = m.Metric group by 1, 2, 3""",
    "tolerance_lookup": f"select p_partkey, {_tols}[p_partkey % 20 + 1] as metric, {_tolv}[p_partkey % 20 + 1]::double as tau from part",
    "known_params_json": "select event_id, cast(json_extract_string(props, '$.k') as double) as k from events",
    "g_lookup": """with p as (select *, ['earth', 'Moon', 'mars', 'zero_gravity', 'on the Moon', 'nonzero', 'zero', 'zero_g'][p_size % 8 + 1] as env from part)
      select p_partkey, coalesce(case when p_partkey % 7 = 0 then p_size::double end, case lower(env) when 'moon' then 1.62 when 'mars' then 3.71 when 'zero' then 0.0 when 'zero_gravity' then 0.0 else 9.8 end::double) as g from p""",
    "canonical_ids": "with c as (select c_custkey, 'model-' || upper(substr(c_mktsegment, 1, 3)) || lpad((c_custkey % 1000)::varchar, 3, '0') as name from customer) select c_custkey, nullif(regexp_extract(name, '(?:^|[_-])([A-Z]+\\d{3})$', 1), '') as id, name as slug from c",
    "pair_alignment": f"""with {TR}, b as (select object_id // 2 as pair, frame, max(x) filter (object_id % 2 = 0) as x0, max(x) filter (object_id % 2 = 1) as x1, max(y) filter (object_id % 2 = 0) as y0, max(y) filter (object_id % 2 = 1) as y1 from tr group by all),
      d as (select pair, frame, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) as d from b where x0 is not null and x1 is not null and y0 is not null and y1 is not null), n as (select pair, count(*) as n from d group by pair)
      select d.pair, n, frame, {r6('d')} as d from d join n using (pair) qualify row_number() over (partition by d.pair order by d, frame) = 1""",
    "sensitivity_grid": f"with {GRID} select scenario, family, model, {r6('effective_macro')} as effective_macro, {r6('end_to_end_macro')} as end_to_end_macro from ma",
    "sensitivity_changes": f"""with {GRID}, b as (select model, metric, prompt_id, effective as be, new_status as bs from g where family = 'baseline')
      select scenario, family, count(*) filter (effective) as n_effective, count(*) filter (new_status <> bs) as status_changed, count(*) filter (effective and not be) as newly_effective, count(*) filter (not effective and be) as no_longer_effective from g join b using (model, metric, prompt_id) group by all""",
    "rank_stability": f"""with {GRID}, r as (select *, row_number() over (partition by scenario order by end_to_end_macro desc, model) as rk from ma), b as (select model, rk as brk from r where family = 'baseline'), j as (select * from r join b using (model)),
      rho as (select scenario, 1 - 6 * sum((rk - brk) * (rk - brk)) / (count(*) * (count(*) * count(*) - 1)) as rho from j group by scenario), rev as (select a.scenario, count(*) filter (a.rk > c.rk) as reversed_pairs from j a join j c on a.scenario = c.scenario and a.brk < c.brk group by 1)
      select scenario, {r6('rho')} as rho, reversed_pairs from rho left join rev using (scenario)""",
    "weight_crossings": f"""with {GRID}, l as (select model, max(end_to_end_macro) filter (scenario = 'weight_0') as a0, max(end_to_end_macro) filter (scenario = 'weight_1') as a1 from ma group by model), k as (select *, a1 - a0 as sl from l)
      select a.model as model_a, b.model as model_b, {r6('(b.a0 - a.a0) / (a.sl - b.sl)')} as weight from k a join k b on a.model < b.model where abs(a.sl - b.sl) > 1e-12 and (b.a0 - a.a0) / (a.sl - b.sl) between 0 and 1""",
    "common_cohort": f"""with {GRID}, r as (select * from g where family = 'r2'), c as (select model, metric, prompt_id from r group by all having bool_and(effective)), m as (select scenario, model, metric, count(*) as n, avg(adjusted_score) as s from r join c using (model, metric, prompt_id) group by all)
      select scenario, model, sum(n)::bigint as n_common, {r6('avg(s)')} as common_effective_macro from m group by all""",
    "sensitivity_problems": f"""with {RES}, r as (select *, case when lines > 1 then 1.0 - discount * 5 end as fit_r2, metric in ('1-URGENT', '2-HIGH') as aff, metric = '5-LOW' as spring from res), t as (
      select 'no R2' as problem, count(*) filter (aff and status <> 'failed' and fit_r2 is null) as n from r
      union all select 'status is not the baseline''s', count(*) filter (aff and status <> 'failed' and fit_r2 is not null and status <> {r2_status("fit_r2")}) from r
      union all select 'spring without confidence', count(*) filter (spring and status <> 'failed' and fit_r2 is null) from r
      union all select 'spring status is not its confidence''s', count(*) filter (spring and status <> 'failed' and status <> case when fit_r2 >= 0.2 then 'valid' else 'weak_valid' end) from r
      union all select 'number of models', abs(count(distinct model) - 6) from r) select problem, n from t where n > 0""",
    "summary_counts": f"""with {scored('0.0')}, e as (select model, 'status_counts' as map, status as value from s union all select model, 'mask_qc_counts', case when qmask >= 0.999 then 'pass' when qmask <= 0 then 'fail' else 'weak' end from s
      union all select model, 'tracking_quality_counts', tracking from s union all select model, 'measurement_quality_counts', measurement_status from s union all select model, 'score_exclusion_counts', exclusion_reasons from s where exclusion_reasons <> '')
      select model, map, value, count(*) as n from e group by all""",
    "nms_topk": f"""with {TR}, b as (select object_id as video, frame as candidate, x as score, y as x1, t as y1, y + 20 as x2, t + 20 as y2, y + 10 as px, t + 10 as py from tr),
      c1 as (select * from b qualify row_number() over (partition by video order by score desc, candidate) = 1), {_left('b', 'c1', 'r1')}, c2 as (select * from r1 qualify row_number() over (partition by video order by score desc, candidate) = 1),
      {_left('r1', 'c2', 'r2')}, c3 as (select * from r2 qualify row_number() over (partition by video order by score desc, candidate) = 1)
      select video, candidate, 1 as rank from c1 union all select video, candidate, 2 from c2 union all select video, candidate, 3 from c3""",
    "end_to_end_scores": f"""with {TR}, v as (select * from tr where valid), p as (select *, sqrt(pow(x - lag(x) {W}, 2) + pow(y - lag(y) {W}, 2)) as way from v),
      n as (select object_id, count(*) as fr, median(sqrt(4 * area / pi())) filter (area > 0) as dia from tr group by object_id), nv as (select object_id, median(sqrt(4 * area / pi())) filter (area > 0) as dv from v group by object_id),
      g as (select object_id, count(*) as nv, regr_slope(x, t) as slope, regr_r2(x, t) as r2, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) as extent from p group by object_id),
      j as (select n.object_id, fr, dia, dv, coalesce(nv, 0) as nv, slope, r2, extent, coalesce(nv, 0) / fr >= 0.5 as counted from n left join g using (object_id) left join nv using (object_id)),
      k as (select *, list_sort(list_filter([case when not counted then 'object_count_mismatch' end, case when counted and extent / dia < 0.75 then 'no_meaningful_motion' end, case when not counted then 'no_counted_object' end], lambda q: q is not null)) as rs,
        case when nv >= 4 then abs(slope) * 0.1 / dv end as measured, case when nv = 0 then 'failed' when nv < 4 then 'failed' else {r2_status("r2")} end as status from j),
      e as (select *, abs(measured - 0.02) / 0.02 as rel, status in ('valid', 'weak_valid') as ok from k)
      select 'm' || object_id % 3 as model, object_id::varchar as prompt_id, {r6("measured", 5)} as measured, status, case when len(rs) = 0 then 'pass' else 'flagged' end as tracking, array_to_string(rs, ';') as tracking_reasons, {r6("rel", 5)} as rel_error,
        {r6("case when ok then 100 * exp(-rel / 0.30) end", 5)} as base_score, ok as effective from e""",
    "document_edges": f"""{EDGES} select object_id::varchar as prompt_id, case when k = 8 then 'speed' else 'velocity' end as metric, {r6("measured", 5)} as measured, status, reason as failure_reason,
        {r6("case when k = 6 then abs(measured) else abs(measured - 0.02) / 0.02 end", 5)} as rel_error, case when unread or len(rs) > 0 then 'flagged' else 'pass' end as tracking,
        case when k = 4 then 'tracking_json_unreadable:JSONDecodeError' when k = 11 then 'tracking_json_unreadable:ValueError' else array_to_string(rs, ';') end as tracking_reasons,
        {r6("case when counted and not unread then path / gate_dia end", 5)} as path_norm, {r6("case when counted and not unread then extent / gate_dia end", 5)} as extent_norm from v""",
    "strict_reasons": f"""{EDGES} select object_id::varchar as prompt_id, case when status in ('weak_valid', 'invalid') then 'invalid' else status end as status, case when status in ('weak_valid', 'invalid') and reason = '' then 'strict_quality_check' else reason end as failure_reason from v""",
    "own_evaluator": f"""with {TR} select object_id, {r6("abs(regr_slope(x, t))")} as speed, {r6("regr_r2(x, t)")} as r2, case when regr_r2(x, t) >= 0.85 then 'valid' when regr_r2(x, t) >= 0.65 then 'weak_valid' else 'invalid' end as status from tr group by object_id""",
    "own_table_function": f"""with {TR} select object_id, count(*) as n, {r6("abs(regr_slope(x, t))")} as speed, {r6("regr_r2(x, t)")} as r2 from tr group by object_id""",
    "frame_stream_gate": f"""with {TR}, p as (select *, sqrt(pow(x - lag(x) {W}, 2) + pow(y - lag(y) {W}, 2)) as way from tr where valid), s as (select object_id, count(*) as frames, median(sqrt(area)) filter (area > 0) as dia from tr group by object_id),
      e as (select object_id, count(*) as nv, coalesce(sum(way), 0) as path, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) as extent from p group by object_id), j as (select s.*, path, extent, coalesce(nv, 0) / frames >= 0.5 as counted from s left join e using (object_id)),
      z as (select *, list_sort(list_filter([case when not counted then 'object_count_mismatch' end, case when counted and extent / dia < 0.75 then 'no_meaningful_motion' end, case when not counted then 'no_counted_object' end], lambda q: q is not null)) as rs from j)
      select object_id as video, frames, counted::bigint as counted, {r6("case when counted then path / dia end")} as path_norm, {r6("case when counted then extent / dia end")} as extent_norm, array_to_string(rs, ';') as reasons, case when len(rs) = 0 then 'pass' else 'flagged' end as status from z""",
    "near_best": f"with {TR} select object_id as video, frame as candidate, x as score from tr qualify x >= 0.6 * max(x) over (partition by object_id)",
    "init_fallback": f"""with {TR}, e as (select object_id as video, 8 + object_id % 5 as expected from (select distinct object_id from tr)), a as (select object_id as video, count(*) as n from tr where event_type = 'view' group by 1), b as (select object_id as video, count(*) as n from tr where event_type = 'click' group by 1),
      c as (select e.video, case when a.n = expected then 'first' when b.n = expected then 'second' else 'none' end as source, case when a.n = expected then a.n when b.n = expected then b.n else 0 end as n from e left join a using (video) left join b using (video)) select source, count(*) as videos, sum(n)::bigint as prompts from c group by source""",
    "detector_boxes": f"""with {DET}, s as (select *, greatest(x2 - x1, 1.0) as w, greatest(y2 - y1, 1.0) as h from det where hint = 'tracking_object' or contains(class_name, 'air') or contains('air', class_name)),
      t as (select *, w * h as area, greatest(w / h, h / w) as aspect, 1 - least(1.0, sqrt(pow((x1 + x2) / 2.0 - 960, 2) + pow((y1 + y2) / 2.0 - 540, 2)) / (sqrt(1920 * 1920 + 1080 * 1080) / 2)) as central from s)
      select video, frame, class_name, area, {r6("aspect")} as aspect, {r6("confidence * (0.75 + 0.25 * central) * (0.7 + 0.3 * least(1.0, area / (0.18 * 1920 * 1080)))")} as score
      from t where area > 4 and area <= 0.7 * 1920 * 1080 and aspect <= 8""",
    "spread_penalties": f"""with {DET}, s as (select *, (x2 - x1) * (y2 - y1) as box, (x2 - x1)::double / (y2 - y1) as aspect from det), t as (select *, confidence * box / 400000 as share from s)
      select video, frame, {r6("""least(0.95, case when share > 0.45 then least(0.85, (share - 0.45) / 0.35) else 0 end + case when box / 400000.0 > 0.55 and confidence < 0.55 then 0.35 else 0 end
        + case when aspect > 3 and share > 0.2 then 0.25 else 0 end)::double""")} as penalty from t""",
    "negative_points": f"""with {DET}, b as (select row_number() over () as id, * from det), p as (select id, video, frame, x1, y1, x2, y2, unnest([{{'x': (x1 + x2) / 2.0, 'y': y1 - 12.0}}, {{'x': (x1 + x2) / 2.0, 'y': y2 + 12.0}}, {{'x': x1 - 12.0, 'y': (y1 + y2) / 2.0}}, {{'x': x2 + 12.0, 'y': (y1 + y2) / 2.0}}]) as p from b),
      q as (select *, least(greatest(p.x, 0), 1919)::double as px, least(greatest(p.y, 0), 1079)::double as py from p), k as (select *, not (px between x1 and x2 and py between y1 and y2) as out from q)
      select video, frame, count(*) filter (out) as n, coalesce(sum(px) filter (out), 0) as x, coalesce(sum(py) filter (out), 0) as y from k group by id, video, frame""",
    "scan_frames": f"""with {TR}, k as (select object_id, frame, frame as i, count(*) over (partition by object_id) as n from tr),
      m as (select *, greatest(least(greatest(n // 2 - 4, 0) + 8, n) - 8, 0) as lo from k)
      select object_id, frame, 'start' as mode from m where i < 8 union all select object_id, frame, 'middle' from m where n <= 8 or (i >= lo and i < lo + 8)
      union all select object_id, frame, 'uniform' from m where n <= 8 or list_contains([floor(j * (n - 1) / 7)::bigint for j in range(8)], i)""",
    "first_eligible": f"""with {DET} select video, frame, x1 as cx, y1 as cy, greatest(0, x1 - 30) as x1, greatest(0, y1 - 30) as y1, least(1919, x2 + 30) as x2, least(1079, y2 + 30) as y2
      from det where quantity >= 10 and least(x2 - x1, y2 - y1) + 1 >= 60 and least(x1, y1, 1919 - x2, 1079 - y2) >= 20 qualify row_number() over (partition by video order by frame, det.x1, det.y1, det.x2, det.y2) = 1""",
    "first_pass": f"""with {DET}, p as (select video % 1000 as video, frame, pass from det), f as (select video, frame, min(pass) as pass from p group by video, frame)
      select p.video, p.frame, count(*) as n, max(p.pass) as pass from p join f on p.video = f.video and p.frame = f.frame and p.pass = f.pass group by p.video, p.frame""",
    "tracking_overrides": """with o as (select o_orderkey, o_custkey % 4 as scan, (o_orderkey % 13) / 10.0 as conf, o_orderstatus = 'P' as flag, o_orderpriority = '5-LOW' as other from orders),
      e as (select *, list_sort(list_filter([case when scan < 1 then 'auto_init_scan_frames must be a positive integer' end, case when conf > 1 then 'yolo_conf must be in [0, 1]' end,
        case when flag then 'no_auto_init_box must be a boolean' end, case when other then 'unsupported setting colour' end], lambda x: x is not null)) as errors from o)
      select o_orderkey, array_to_string(errors, '; ') as errors, case when len(errors) = 0 then scan::varchar end as scan, case when len(errors) = 0 then conf::double end as conf, case when len(errors) = 0 then 'true' end as no_box from e""",
    "mask_controls": f"""with {TR}, c(k, s0, w0, s1, w1) as (values (0, 0, 10, 0, 10), (1, 30, 10, 30, 10), (2, 0, 28, 0, 3), (3, 0, 10, 15, 10)),
      f as (select object_id, case when frame % 2 = 1 then s1 else s0 end as s, case when frame % 2 = 1 then w1 else w0 end as w from tr join c on k = object_id % 4),
      g as (select object_id, s + (w - 1) / 2.0 - 4.5 as dx, greatest(0, least(s + w, 10) - s)::double as held, w from f)
      select object_id, {r6("sqrt(avg(dx * dx))")} as centroid_rmse_px, {r6("avg(held / (w + 10 - held))")} as ground_truth_mask_iou from g group by object_id""",
    "mask_regions": f"""with recursive {TR}, px as (select distinct object_id as video, frame // 12 as frame, floor(y % 12)::bigint as y, unnest(range(floor(x % 40)::bigint, floor(x % 40 + y % 7)::bigint + 1)) as x from tr),
      ed as (select a.video, a.frame, a.y * 1000 + a.x as p, b.y * 1000 + b.x as q from px a join px b on a.video = b.video and a.frame = b.frame and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
      re as (select video, frame, y * 1000 + x as p, y * 1000 + x as q from px union select re.video, re.frame, re.p, ed.q from re join ed on ed.video = re.video and ed.frame = re.frame and ed.p = re.q),
      la as (select video, frame, p, min(q) as l from re group by all)
      select video, frame, dense_rank() over (partition by video, frame order by l) - 1 as region, count(*) as area, min(p % 1000) as x1, min(p // 1000) as y1, max(p % 1000) as x2, max(p // 1000) as y2, {r6("avg(p % 1000)")} as cx, {r6("avg(p // 1000)")} as cy from la group by video, frame, l""",
    "moving_regions": f"""with recursive {TR}, pr as (select distinct object_id // 6 as video, frame // 8 as frame, object_id % 6 as y from tr), im as (select pr.video, pr.frame, pr.y, i as x, coalesce(floor(tr.x), 0)::bigint as v from pr, range(8) c(i) left join tr on tr.object_id = pr.video * 6 + pr.y and tr.frame = pr.frame * 8 + i),
      bg as (select video, y, x, floor(quantile_cont(v, 0.5)) as b from im group by all), df as (select im.*, abs(v - b) as d, abs(v - lag(v) over (partition by video, y, x order by frame)) as e from im join bg using (video, y, x)),
      on_ as (select 'median_background' as method, video, frame, y * 8 + x as p, y, x from df where d > 110 union all select 'pairwise_frame_difference', video, frame, y * 8 + x, y, x from df where e > 110),
      ed as (select a.method, a.video, a.frame, a.p, b.p as q from on_ a join on_ b on a.method = b.method and a.video = b.video and a.frame = b.frame and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
      re as (select method, video, frame, p, p as q from on_ union select re.method, re.video, re.frame, re.p, ed.q from re join ed on ed.method = re.method and ed.video = re.video and ed.frame = re.frame and ed.p = re.q),
      la as (select method, video, frame, p, min(q) as l from re group by all), rg as (select method, video, frame, count(*) as area, min(p % 8) as x1, min(p // 8) as y1, max(p % 8) as x2, max(p // 8) as y2, {r6("avg(p % 8)")} as cx, {r6("avg(p // 8)")} as cy from la group by method, video, frame, l having count(*) >= 4)
      select * from rg where method = 'median_background' or video not in (select video from rg where method = 'median_background')""",
    "result_tree_metrics": f"""with {RES}, g as (select metric, 'c' || o_custkey % 20 as prompt_id, round(sum(measured), 2) as m, round(sum(target), 2) as t, count(*) filter (tracking = 'flagged') as f from res join orders on o_orderkey = prompt_id where metric in ('1-URGENT', '4-NOT SPECIFIED') group by all)
      select metric, prompt_id, 'valid' as status, {r6("m", 1)} as measured, {r6("t", 1)} as target, {r6("abs(m - t) / t", 5)} as rel_error, case when f > 0 then 'flagged' else 'pass' end as tracking, case when f > 0 then 'no_meaningful_motion' else '' end as tracking_reasons from g""",
    "cluster_candidates": f"""with recursive {TR}, o as (select object_id as video, frame as candidate, area as score, greatest(area, 1e-6) as w, x, y, row_number() over (partition by object_id order by area desc, frame) as i from tr),
      st as (select video, i, candidate, score, 0::bigint as cluster, [{{'sx': x * w, 'sy': y * w, 'sw': w}}] as s from o where i = 1
        union all select video, i, candidate, score, c, case when c = len(s) then list_append(s, {{'sx': x * w, 'sy': y * w, 'sw': w}}) else list_concat(list_append(s[:c], {{'sx': s[c + 1].sx + x * w, 'sy': s[c + 1].sy + y * w, 'sw': s[c + 1].sw + w}}), s[c + 2:]) end
        from (select o.*, st.s, coalesce(list_position(list_transform(st.s, lambda q: sqrt(pow(q.sx / q.sw - o.x, 2) + pow(q.sy / q.sw - o.y, 2)) <= 40), true), len(st.s) + 1)::bigint - 1 as c from st join o on o.video = st.video and o.i = st.i + 1) n),
      b as (select *, score >= 0.65 * max(score) over (partition by video, cluster) as stable from st)
      select video, cluster::integer as cluster, count(distinct candidate) as n_frames, count(*) as n_candidates, first(candidate order by abs(candidate - 10), score desc, candidate) filter (stable) as candidate, {r6("median(score) * ln(1 + count(distinct candidate))")} as cluster_score from b group by video, cluster""",
    "changed_inputs": """select case when n = 4 then -o_orderkey else o_orderkey end as o_orderkey, ['changed', 'lost', 'repeated', 'new'][n] as change, [1, 1, 1, 0][n]::bigint as n_before, [1, 0, 2, 1][n]::bigint as n_after from (select o_orderkey, o_orderkey % 1000 as n from orders) q where n between 1 and 4""",
    "dq_preflight": r"""with r as (select 'documents' as source, case when text is null or trim(text) = '' then 'empty text' when length(text) < 20 then 'short text' when not regexp_matches(source, '^[A-Za-z0-9_-]+$') then 'source name' end as rule from documents
      union all select 'documents', case when count(*) > 1 then 'repeated id' end from documents group by doc_id union all select 'pages', case when url is null or not regexp_matches(url, '^https?://') then 'not a URL' end from pages) select source, rule, count(*) as n from r where rule is not null group by all""",
    "container_tables": f"""with u as (select user_id as object_id, count(*) as n, count(*) filter (event_type = 'error') as few, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as span from events group by 1)
      select object_id, true as header_ok, 2 as tracks, 'vide' as handler, n as samples, few as sounds, case when span > 0 then {r6("n * 600 / span::double")} end as rate, array_to_string(list_filter([n, few], lambda v: v > 0), ',') as counts from u""",
    "metadata_preflight": r"""with m as (select case when k % 50 = 1 then -(w % 20) when k % 50 <> 2 then k end as ix, case when k % 40 = 3 then 'P' || w || ['.', '_', '/', ''][k % 4 + 1] when k % 40 <> 5 then 'Q' || k end as id,
        case when k % 9 = 4 then ['eval_speed', 'eval_oracle_tracking'][k % 2 + 1] else 'known' end as ev, (k % 7)::int as par, (k % 6)::int as num, case when k % 8 = 6 then (k % 5)::int end as bad, case when k % 5 <> 0 then k % 4 end as fr, w from (select o_orderkey as k, o_custkey as w from orders)),
      v as (select o_custkey as w, count(*) as n, o_custkey * 100 >= 1024 and o_custkey % 13 <> 0 as fine, o_custkey % 7 <> 0 as listed from orders where o_custkey % 10 <> 0 group by 1),
      j as (select m.*, v.n, v.w is not null and bad is null as found, coalesce(v.fine, false) and bad is null as fine, listed from m left join v using (w)),
      r as (select 'index_given' as rule, 'error' as severity, id as subject, 'no index' as detail from j where ix is null
        union all select 'id_given', 'error', id, 'no id' from j where id is null
        union all select 'id_safe', 'error', id, 'id is not safe in paths' from j where id is null or contains(id, '.') or contains(id, '/')
        union all select 'evaluator_known', 'error', id, 'unknown evaluator ' || ev from j where ev <> 'known'
        union all select 'parameters', 'error', id, 'parameters are no JSON object' from j where par in (3, 4)
        union all select 'objects_positive', 'error', id, 'number of objects is not positive' from j where num in (4, 5)
        union all select 'video_path', 'error', id, ['path is empty', 'path has backslashes', 'path is not relative', 'path is not relative', 'path leaves its folder'][bad + 1] from j where bad is not null
        union all select 'video_there', 'error', id, 'video missing' from j where bad is null and not found
        union all select 'video_plausible', 'error', id, 'no plausible MP4' from j where found and not fine
        union all select 'frames_match', 'error', id, 'expected ' || fr || ' frames, declared ' || n from j where fine and listed and fr <> n
        union all select 'frames_declared', 'warning', id, 'no frame count declared' from j where fine and not listed and fr is not null
        union all select 'renderer', 'error', id, case when par in (0, 1, 3, 4, 5) then 'mask pattern has no frame' else 'colour is not of bytes' end from j where fine and ev = 'eval_oracle_tracking' and par <> 6
        union all select 'videos_verified', 'ok', null, 'plausible MP4' from j where fine union all select 'frames_verified', 'ok', null, 'frame count declared' from j where fine and listed and fr = n),
      g as (select 'index_unique' as rule, 'error' as severity, ix::varchar as subject, coalesce(id, '') as value from m where ix is not null union all select 'id_unique', 'error', id, id from m where id is not null
        union all select 'folder_unique', 'error', regexp_replace(regexp_replace(coalesce(id, ''), '[./]', '_'), '_+$', ''), coalesce(id, '') from m union all select 'video_once', 'warning', 'v/' || w || '.mp4', coalesce(id, '') from m where bad is null)
      select rule, severity, 'row' as scope, subject, detail, count(*) as n from r group by all union all
      select rule, severity, 'table', subject, nullif(case when min(value) = max(value) then min(value) else min(value) || ' and ' || max(value) end, ''), count(*) from g group by rule, severity, subject having case when rule = 'folder_unique' then min(value) <> max(value) else count(*) > 1 end""",
    "exact_colours": f"""with {TR}, px as (select distinct object_id as video, frame // 10 as frame, floor(y)::bigint % 16 as y, floor(x)::bigint % 24 as x from tr)
      select video, frame, 24 as image_w, 16 as image_h, count(*) as area, min(x)::int as x1, min(y)::int as y1, max(x)::int as x2, max(y)::int as y2, {r6("avg(x)")} as cx, {r6("avg(y)")} as cy from px group by video, frame""",
    "tracking_initialisation": f"""with {TR}, v as (select object_id as v, count(*) as n, floor(arg_min(x, frame))::bigint as fx, floor(arg_min(y, frame))::bigint as fy from tr group by 1),
      px as (select distinct object_id as v, frame // 10 as f, floor(y)::bigint % 16 as y, floor(x)::bigint % 24 as x from tr where object_id % 4 = 2),
      sh as (select v, f, count(*) as area, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2, avg(x) as cx, avg(y) as cy from px group by v, f),
      el as (select *, row_number() over (partition by v order by f) as i, case when v % 8 = 2 then 0 else 2 end as pad from sh where v % 8 = 2 or area >= 9),
      e as (select v.*, el.*, coalesce(case when v.v % 20 = 9 then 2 end, 1) as expected, case when v.v % 12 = 3 then 'unsupported setting conf' when v.v % 4 = 1 and v.v % 20 = 9 then 'prompt count differs from the number of objects'
        when v.v % 4 = 2 and el.v is null then 'no visible mask passes the gates' end as err from v left join el on el.v = v.v and el.i = 1)
      select v as video, err as init_error, case when err is null then expected else 0 end as expected, case when err is null then case v % 4 when 1 then case when v % 8 = 1 and v % 12 <> 5 then 'one_frame_manual_point_box' else 'one_frame_manual_point' end
          when 2 then case when v % 8 = 2 then 'renderer_first_visible_gt_point_box' else 'renderer_first_eligible_gt_point_box' end else 'video_only_auto' end end as protocol,
        coalesce(case when err is null then case v % 4 when 1 then 0 when 2 then f end end, -1) as frame_idx, case when err is null then case v % 4 when 1 then fx + 0.0 when 2 then {r6("cx")} end end as px, case when err is null then case v % 4 when 1 then fy + 0.0 when 2 then {r6("cy")} end end as py,
        case when err is null then case when v % 8 = 1 then '0,0,100000,100000' when v % 4 = 2 then greatest(0, x1 - pad) || ',' || greatest(0, y1 - pad) || ',' || least(23, x2 + pad) || ',' || least(15, y2 + pad) end end as box from e""",
    "event_windows": f"select cast(epoch(date_trunc('hour', ts)) as bigint) as start, event_type, count(*) as n, {r6('sum(value)')} as total from events group by 1, 2",
}
