"""Queries of daily features over the prepared views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import primitives
from gapline.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The primitives of the study.
NAMES = (
    "screen_load_24h", "screen_active_minutes_24h", "usage_load_24h", "screen_disengagement_p90", "usage_disengagement_p90", "phone_activity_load_24h", "step_load_24h", "phone_activity_disengagement_p90",
    "step_disengagement_p90", "mobile_light_exposure_24h", "wearable_light_exposure_24h", "mobile_low_light_onset", "wearable_low_light_onset", "heart_rate_settling_delta", "heart_rate_settling_slope", "charging_onset",
)


def query(sql: str | None = None, name: str | None = None, into: tuple[dict, dict] = (QUERIES, ORACLES)):
    """Register a query, and its SQL, under ``name`` or the function's name."""

    def add(f):
        into[0][name or f.__name__] = f
        if sql:
            into[1][name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


#: Frames of views, and their readings with the minute of the day, the epoch, and whether they count (``ok``).
FRAMED = """fr as (select distinct v.view_id, v.subject_id, v.sensor_day_id, v.primitive, v.window_start, d.cadence_minutes as cad, d.expected_epochs as n_epochs, d.coverage_mode as mode, d.operation as op, d.unit_scale as sc,
  coalesce(d.operation_params['minimum']::double, 0) as p_min, d.operation_params['validity_equals']::double as p_eq, coalesce(d.operation_params['epoch_minutes']::double, 1) as p_epoch, coalesce(d.operation_params['low_threshold']::double, 10) as p_low,
  coalesce(d.operation_params['min_observations']::double, 1) as p_obs, d.operation_params['component'] as p_comp from phase_views v join primitive_definitions d on d.primitive = v.primitive),
 rec as (select distinct record_id, view_id, effective_timestamp as t, support_start as s0, support_end as s1, case when isnan(raw_value) then null else raw_value end as v, case when isnan(raw_validity) then null else raw_validity end as u from phase_records),
 x0 as (select r.record_id, r.t, r.s0, r.s1, r.v, r.u, fr.*, (epoch_us(r.t) - epoch_us(date_trunc('day', window_start))) / 60000000.0::double as minute, (epoch_us(r.t) - epoch_us(window_start)) as off_us from rec r join fr on fr.view_id = r.view_id),
 x as (select *, floor(off_us / (cad * 60000000.0))::int as epoch, coalesce(off_us >= 0 and off_us < n_epochs * cad * 60000000.0 and (p_eq is null or coalesce(u = p_eq, false)) and case when op in ('binary_load', 'binary_active_minutes', 'charging_onset', 'activity_load') then v in (0, 1)
  when op in ('additive_load', 'exposure_mean', 'evening_p90') then isfinite(v) and v >= p_min when op = 'low_light_onset' then isfinite(v) and v >= 0 else isfinite(v) end, false) as ok from x0)"""


def values_sql(source: str, by: str) -> str:
    """The values of ``source`` (like x, with the columns ``by``), as tables sv, pv, lv, cv, hv and their union val."""
    using = f"using ({by})"
    return f"""sv as (select {by}, case when any_value(op) in ('binary_load', 'activity_load') then avg(v) when any_value(op) = 'binary_active_minutes' then sum(v) * any_value(p_epoch) when any_value(op) = 'additive_load' then sum(v) * any_value(sc) else avg(ln(1 + v)) end as value, 'none' as censoring
  from {source} where ok and op in ('binary_load', 'binary_active_minutes', 'activity_load', 'additive_load', 'exposure_mean') group by {by}),
 pm as (select {by}, minute, sum(v) as w from {source} where ok and op = 'evening_p90' and v > 0 group by {by}, minute), pc as (select *, sum(w) over (partition by {by} order by minute) as upto, sum(w) over (partition by {by}) as total from pm),
 pv as (select {by}, min(minute) as value, 'none' as censoring from pc where upto >= total * (0.9 * (1 - 1e-12)) group by {by}),
 lg as (select distinct {by}, unnest(range(0, 12))::int as b from {source} where ok and op = 'low_light_onset' and minute >= 1080 and minute < 1440),
 lb as (select {by}, floor((minute - 1080) / 30)::int as b, case when count(*) >= max(p_obs) then case when avg((v <= p_low)::int) >= 0.75 then 1 else 0 end end as c from {source} where ok and op = 'low_light_onset' and minute >= 1080 and minute < 1440 group by all),
 lx as (select {by}, coalesce(min(case when c = 1 then b end), 12) as f, coalesce(min(case when c is null then b end), 12) as m, coalesce(max(case when c is not null then b end), -1) as last_seen from lg left join lb using ({by}, b) group by {by}),
 lv as (select {by}, case when f < 12 and f > 0 and m > f then 1080.0 + 30 * f end as value, case when f = 0 or m = 0 then 'left' when f < 12 and m < f then 'gap' when f < 12 then 'none' when m = 12 then 'none' when last_seen < m then 'right' else 'gap' end as censoring from lx),
 cg as (select distinct {by}, unnest(range(0, 360))::int as b from {source} where ok and op = 'charging_onset' and minute >= 1080 and minute < 1440),
 cb as (select {by}, floor(minute - 1080)::int as b, max(v)::int as c from {source} where ok and op = 'charging_onset' and minute >= 1080 and minute < 1440 group by all),
 cl as (select *, lag(c) over w as p, sum(c) over (partition by {by} order by b rows between current row and 9 following) as ten from cg left join cb using ({by}, b) window w as (partition by {by} order by b)),
 cm as (select {by}, coalesce(min(case when c is null then b end), 360) as m, coalesce(max(case when c is not null then b end), -1) as last_seen, max(case when b = 0 then c end) as c0, max(case when b = 359 then c end) as c359 from cl group by {by}),
 cf as (select {by}, min(b) as f from cl join cm {using} where cl.p = 0 and cl.c = 1 and cl.ten = 10 and cl.b + 10 <= cm.m group by {by}),
 cx as (select cm.*, coalesce(cf.f, 360) as f from cm left join cf {using}),
 cv as (select {by}, case when f < 360 and not (m > 0 and coalesce(c0, 0) = 1) then 1080.0 + f end as value, case when m > 0 and c0 = 1 then 'left' when f < 360 then 'none' when m = 0 then 'left' when m < 360 and last_seen < m then 'right' when m < 360 then 'gap' when c359 = 1 then 'right' else 'none' end as censoring from cx),
 hs as (select {by}, any_value(p_comp) as comp, count(distinct case when minute >= 1080 and minute < 1200 then floor(minute) end) as e, count(distinct case when minute >= 1320 and minute < 1440 then floor(minute) end) as l,
  avg(case when minute >= 1320 and minute < 1440 then v end) - avg(case when minute >= 1080 and minute < 1200 then v end) as delta from {source} where ok and op = 'heart_rate_settling' group by {by}),
 hh as (select {by}, floor(minute / 30) * 0.5 as h, median(v) as m from {source} where ok and op = 'heart_rate_settling' group by all), hr as (select {by}, case when count(*) >= 2 then regr_slope(m, h) end as slope from hh group by {by}),
 hv as (select {by}, case when e >= 30 and l >= 30 then case when comp = 'delta' then delta else slope end end as value, 'none' as censoring from hs join hr {using}),
 val as (select {by}, value, censoring from sv union all select {by}, value, censoring from pv union all select {by}, value, censoring from lv union all select {by}, value, censoring from cv union all select {by}, value, censoring from hv)"""


#: What coverage makes of ``source``, as table cov.
def coverage_sql(source: str, by: str) -> str:
    return f"""eb as (select distinct {by}, epoch from {source} where ok), eg as (select *, epoch - coalesce(lag(epoch) over (partition by {by} order by epoch), -1) - 1 as gap from eb),
 ec as (select {by}, count(*)::int as seen, max(gap) as gap, max(epoch) as last from eg group by {by}),
 en as (select {by}, any_value(n_epochs) as n_epochs, any_value(cad) as cad, any_value(mode) as mode, count(*)::bigint as n_records, count(case when ok then 1 end)::bigint as n_valid from {source} group by {by}),
 cov as (select {by}, n_records, n_valid, coalesce(seen, 0)::int as observed_epochs, n_epochs::int as expected_epochs, case when mode <> 'event_support' then least(coalesce(seen, 0) / n_epochs::double, 1) end as coverage,
  case when mode <> 'event_support' then (case when seen is null then n_epochs else greatest(gap, n_epochs - last - 1) end * cad)::double end as longest_gap_minutes, case when mode = 'event_support' then least(coalesce(seen, 0) / n_epochs::double, 1) end as support_density,
  case when mode = 'event_support' then 'unknown' when seen > 0 then 'observed' else 'missing' end as coverage_status, case when seen > 0 then 'observed' else 'insufficient' end as status from en left join ec using ({by}))"""


BY = "view_id"
DAILY = f"""{FRAMED}, {values_sql("x", BY)}, {coverage_sql("x", BY)},
 daily as (select fr.view_id, fr.subject_id, fr.sensor_day_id, fr.primitive, val.value, coalesce(n_records, 0)::bigint as n_records, coalesce(n_valid, 0)::bigint as n_valid, coalesce(observed_epochs, 0)::int as observed_epochs, fr.n_epochs::int as expected_epochs, coverage, longest_gap_minutes,
  coalesce(support_density, case when fr.mode = 'event_support' then 0.0 end)::double as support_density, coalesce(coverage_status, case when fr.mode = 'event_support' then 'unknown' else 'missing' end) as coverage_status, coalesce(status, 'insufficient') as status, coalesce(censoring, 'unknown') as censoring
  from fr left join cov using (view_id) left join val using (view_id))"""
_ROUNDED = "view_id, subject_id, sensor_day_id, primitive, round(value, 6)::double as value, n_records, n_valid, observed_epochs, expected_epochs, round(coverage, 6)::double as coverage, longest_gap_minutes, round(support_density, 6)::double as support_density, coverage_status, status, censoring"


def daily(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    definitions = read(spark, folder, "primitive_definitions").where(F.col("primitive").isin(*names))
    return primitives.daily_primitives(read(spark, folder, "phase_records"), read(spark, folder, "phase_views"), definitions)


def _one(name: str) -> None:
    @query(f"with {DAILY} select {_ROUNDED} from daily where primitive = '{name}'", f"op080_{name}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(daily(spark, folder, (name,)), 6, "value", "coverage", "support_density")


for _name in NAMES:
    _one(_name)


@query(f"""with {DAILY} select subject_id, sensor_day_id, {', '.join(f"round(max(case when primitive = '{n}' then value end), 6)::double as {n}, max(case when primitive = '{n}' then status end) as {n}__status" for n in NAMES)} from daily group by subject_id, sensor_day_id""")
def op081_daily_table(spark: SparkSession, folder: str) -> DataFrame:
    """All primitives of a participant-day in one row."""
    wide = primitives.wide_primitives(daily(spark, folder), list(NAMES), ("value", "status"))
    return rounded(wide, 6, *NAMES)
