"""Queries of baselines, scores and composed indicators over the daily primitives, with their SQL."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import representations as rep
from gapline.plans.phase_queries import wmedian_sql
from gapline.plans.primitive_queries import DAILY, query as _query, rounded
from gapline.plans.replay_queries import AUDIT, MASKS, PLAYED, Parts
from gapline.sources.tables import each_once, read
from gapline.staging import join_bounded, materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = partial(_query, into=(QUERIES, ORACLES))
_USAGE = "primitive in ('usage_load_24h', 'usage_disengagement_p90')"
CONF = f"""cal as (select sensor_day_id, max(elapsed_day_index) as elapsed, max(lifelog_date) as lifelog_date from calendar_days group by 1),
 cf0 as (select d.*, dd.expected_epochs * dd.cadence_minutes as minutes, cal.elapsed, cal.lifelog_date, (value is not null and status = 'observed')::int::double as valid, (censoring = 'none')::int::double as unc from daily d join primitive_definitions dd on dd.primitive = d.primitive left join cal using (sensor_day_id)),
 cf1 as (select *, greatest(least(coalesce(coverage, 0), 1), 0) as cov1, greatest(least(1 - coalesce(longest_gap_minutes, minutes) / minutes::double, 1), 0) as gap1 from cf0),
 cq as (select *, case when {_USAGE} then valid else cov1 * gap1 * valid * unc end as confidence, case when {_USAGE} then valid else cov1 * valid end as coverage_only, valid as value_only, valid * unc as unweighted from cf1)"""
GRID = f"""pk as (select cq.*, k from cq, (values (3), (7), (14), (21)) kk(k) where elapsed between 1 and k), {wmedian_sql("kc", "pk", "subject_id, primitive, k", "value", "confidence", "pc")},
 ko as (select pk.*, abs(value - pc) as off from pk join kc using (subject_id, primitive, k)), {wmedian_sql("km", "ko", "subject_id, primitive, k", "off", "confidence", "pm")},
 kn as (select subject_id, primitive, k, sum(confidence) as n_eff, count(*)::bigint as n_rows from pk where confidence > 0 and value is not null group by 1, 2, 3), own as (select kc.subject_id, kc.primitive, kc.k, pc, pm * 1.4826 as ps, n_eff, n_rows from kc join km using (subject_id, primitive, k) join kn using (subject_id, primitive, k)),
 tr as (select f.held_out, cq.* from cq join (select distinct primitive, subject_id as held_out from cq) f on f.primitive = cq.primitive and f.held_out <> cq.subject_id), {wmedian_sql("tc", "tr", "held_out, primitive", "value", "confidence", "oc")},
 toff as (select tr.*, abs(value - oc) as off from tr join tc using (held_out, primitive)), {wmedian_sql("tm", "toff", "held_out, primitive", "off", "confidence", "om")},
 oth as (select held_out as subject_id, primitive, oc, om * 1.4826 as os from tc join tm using (held_out, primitive)),
 don as (select *, coalesce(lead(pc) over w, first(pc) over w) as d_c, coalesce(lead(ps) over w, first(ps) over w) as d_s, coalesce(lead(subject_id) over w, first(subject_id) over w) as d_id from own window w as (partition by primitive, k order by subject_id)),
 gb as (select oth.*, kk.k, pc, ps, n_eff, d_c, d_s, d_id, coalesce(n_eff >= 3 - 1e-9 and ps > 0, false) as able, coalesce(d_id <> oth.subject_id, false) as other, coalesce(n_eff, 0) as n from oth cross join (values (3), (7), (14), (21)) kk(k) left join don on don.subject_id = oth.subject_id and don.primitive = oth.primitive and don.k = kk.k),
 grid as (select subject_id, primitive, k, 'population' as method, oc as center, os as scale, 'population' as basis from gb union all select subject_id, primitive, k, 'personal', case when able then pc else oc end, case when able then ps else os end, case when able then 'personal' else 'population_fallback' end from gb
  union all select subject_id, primitive, k, 'shrinkage', coalesce(n / (n + 7) * pc + (1 - n / (n + 7)) * oc, oc), greatest(case when n >= 3 then n / (n + 7) * coalesce(ps, os) + (1 - n / (n + 7)) * os else os end, 0.1 * os), case when n > 0 then 'shrinkage' else 'population_fallback' end from gb
  union all select subject_id, primitive, k, 'placebo', case when other then d_c end, case when other then d_s end, case when other then 'placebo' else 'no_donor' end from gb)"""
_CUT = "greatest(least({0}, 5), -5)"
_G = f"with {DAILY}, {CONF}, {GRID}"
SCORED = "sc as (select cq.*, grid.center, grid.scale, case when scale > 0 and value is not null then greatest(least((value - center) / scale, 5), -5) end as z from cq join grid using (subject_id, primitive) where k = 14 and method = 'shrinkage')"


class RepParts(Parts):
    """What the queries of representations share."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self.folder = folder

    def make_rows(self):
        days = each_once(read(self.records.sparkSession, self.folder, "calendar_days"), ["sensor_day_id", "elapsed_day_index", "lifelog_date"]).groupBy("sensor_day_id").agg(F.max("elapsed_day_index").alias("elapsed"), F.max("lifelog_date").alias("lifelog_date"))
        return materialize(join_bounded(rep.confidences(self.daily, self.definitions), days, ["sensor_day_id"], "left"), "rows")

    def make_grid(self):
        return materialize(rep.baseline_grid(self.rows_), "grid")

    def make_rows_(self):
        return self.make_rows()

    def make_scored(self):
        return rep.scored(self.rows_, self.grid.where("k = 14 and method = 'shrinkage'"))


_FOUR = ("confidence", "coverage_only", "value_only", "unweighted")


@query(f"with {DAILY}, {CONF} select view_id, primitive, " + ", ".join(f"round({c}, 6)::double as {c}" for c in _FOUR) + " from cq")
def op192_confidence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(RepParts(spark, folder).rows_.select("view_id", "primitive", *_FOUR), 6, *_FOUR)


@query(f"with {DAILY}, {CONF}, pr as (select subject_id, sensor_day_id, case when primitive like '%p90' then 'p90' else 'load' end as kind, max(case when primitive in ('screen_load_24h', 'screen_disengagement_p90') then cov1 * gap1 end) as proxy from cf1 group by 1, 2, 3) select view_id, primitive, round(case when {_USAGE} then coalesce(proxy, 0) * valid * unc else confidence end, 6)::double as confidence from cq left join pr on pr.subject_id = cq.subject_id and pr.sensor_day_id = cq.sensor_day_id and pr.kind = case when primitive like '%p90' then 'p90' else 'load' end")
def op192_screen_proxy(spark: SparkSession, folder: str) -> DataFrame:
    p = RepParts(spark, folder)
    return rounded(rep.confidences(p.daily, p.definitions, "screen").select("view_id", "primitive", "confidence"), 6, "confidence")


@query(f"{_G} select subject_id, primitive, k, round(pc, 7)::double as pc, round(ps, 7)::double as ps, round(n_eff, 6)::double as n_eff, n_rows from own")
def op198_personal_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(rep.personal_estimates(RepParts(spark, folder).rows_), 7, "pc", "ps"), 6, "n_eff")


@query(f"{_G} select subject_id, primitive, k, method, round(center, 6)::double as center, round(scale, 6)::double as scale, basis from grid")
def op197_baseline_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Four methods for four calibration lengths, one participant held out at a time."""
    return rounded(RepParts(spark, folder).grid, 6, "center", "scale")


@query(f"{_G} select view_id, k, method, round(case when scale > 0 then {_CUT.format('(value - center) / scale')} end, 5)::double as z from cq join grid using (subject_id, primitive) where value is not null")
def op199_scores(spark: SparkSession, folder: str) -> DataFrame:
    p = RepParts(spark, folder)
    return rounded(rep.scored(p.rows_.where("value is not null"), p.grid).select("view_id", "k", "method", "z"), 5, "z")


@query(f"{_G} select subject_id, sensor_day_id, primitive, round(case when b.scale > 0 then {_CUT.format('(value - a.center) / b.scale')} end, 5)::double as reference_z, round(case when a.scale > 0 then {_CUT.format('(value - a.center) / a.scale')} end, 5)::double as self_z from cq join grid a using (subject_id, primitive) join grid b using (subject_id, primitive) where a.k = 14 and b.k = 14 and a.method = 'shrinkage' and b.method = 'population' and value is not null")
def op203_dual_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    p = RepParts(spark, folder)
    return rounded(rep.dual_coordinates(p.rows_.where("value is not null"), p.grid), 5, "reference_z", "self_z")


def _listed(names) -> str:
    return ", ".join(f"('{n}', '{how}', '{part}', {e}, '{p}', {s}.0)" for n, how, part, e, sources in names for p, s in sources)


def indicators_sql(source: str, by: str, tag: str = "") -> str:
    """The ten indicators of ``source`` (by, primitive, value, z, confidence) as table ind."""
    t = tag
    return f"""lst{t}(indicator, how, part, expected, primitive, sign) as (values {_listed((*rep.INDICATORS, *rep.TIMING_SCORES))}),
 pa{t} as (select {by}, indicator, how, expected, case when part = 'z' then z else value end * sign as x, confidence as w from {source} join lst{t} using (primitive)), pa2{t} as (select * from pa{t} where x is not null and isfinite(x) and w > 0),
 {wmedian_sql(f"pw{t}", f"(select * from pa2{t} where how = 'median')", f"{by}, indicator", "x", "w", "middle")},
 fi{t} as (select s.*, case s.how when 'mean' then mean else middle end as value from (select {by}, indicator, any_value(how) as how, sum(x * w) / sum(w) as mean, least(sum(w) / any_value(expected), 1)::double as confidence, count(*)::bigint as n_sources from pa2{t} group by {by}, indicator) s left join pw{t} using ({by}, indicator)),
 ti{t} as (select {by}, 'c' as indicator, value as x, confidence as w from fi{t} where indicator in ('digital_disengagement_time', 'physical_disengagement_time', 'low_light_onset') union all select {by}, 'c', value, confidence from {source} where primitive = 'charging_onset'), ti2{t} as (select * from ti{t} where x is not null and w > 0),
 {wmedian_sql(f"wc{t}", f"ti2{t}", by, "x", "w", "center")}, wo{t} as (select ti2{t}.*, abs(x - center) as off from ti2{t} join wc{t} using ({by})), {wmedian_sql(f"ws{t}", f"wo{t}", by, "off", "w", "spread")}, wn{t} as (select {by}, least(sum(w) / 4, 1)::double as confidence, count(*)::bigint as n_sources from ti2{t} group by {by}),
 ro{t} as (select {by}, sqrt(sum(value * value * confidence) / sum(confidence)) as value, least(sum(confidence) / 8, 1)::double as confidence, count(*)::bigint as n_sources from fi{t} where indicator in ({', '.join(repr(r) for r in rep.ROUTINE)}) and confidence > 0 group by {by}),
 ind{t} as (select {by}, indicator, value, confidence, n_sources from fi{t} where indicator in ({', '.join(repr(i[0]) for i in rep.INDICATORS)}) union all select {by}, 'winddown_center', center, confidence, n_sources from wc{t} join wn{t} using ({by})
  union all select {by}, 'winddown_spread', spread, confidence, n_sources from ws{t} join wn{t} using ({by}) where n_sources >= 2 union all select {by}, 'routine_deviation', value, confidence, n_sources from ro{t})"""


_DAY = "subject_id, sensor_day_id"


@query(f"{_G}, {SCORED}, {indicators_sql('sc', _DAY)} select subject_id, sensor_day_id, indicator, round(value, 5)::double as value, round(confidence, 5)::double as confidence, n_sources from ind")
def op193_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """The ten composed indicators of each day."""
    return rounded(rep.composed_indicators(RepParts(spark, folder).scored), 5, "value", "confidence")


@query(f"""{_G}, {SCORED}, {indicators_sql('sc', _DAY)}, dl(indicator, how, part, primitive, sign, dropped) as (values {', '.join(f"('{n}', '{how}', '{part}', '{p}', {s}.0, '{q}')" for n, how, part, e, src in rep.INDICATORS for p, s in src for q, _ in src if q != p)})
 select i.subject_id, i.sensor_day_id, i.indicator, dl.dropped, round(i.value, 5)::double as value, round(case when part = 'z' then z else sc.value end * sign, 5)::double as value_without from ind i join dl using (indicator) join sc on sc.subject_id = i.subject_id and sc.sensor_day_id = i.sensor_day_id and sc.primitive = dl.primitive where i.n_sources = 2""")
def op221_modality_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rep.without_each_source(RepParts(spark, folder).scored), 5, "value", "value_without")


_ORACLE = f"""lt as (select * from cq where elapsed >= 22), {wmedian_sql("oc1", "lt", "subject_id, primitive", "value", "confidence", "later_center")}, oo as (select lt.*, abs(value - later_center) as off from lt join oc1 using (subject_id, primitive)), {wmedian_sql("oc2", "oo", "subject_id, primitive", "off", "confidence", "later_mad")},
 orc as (select oc1.subject_id, oc1.primitive, later_center, later_mad * 1.4826 as later_scale, (select count(*) from lt where lt.subject_id = oc1.subject_id and lt.primitive = oc1.primitive and value is not null and confidence > 0)::bigint as n_rows from oc1 join oc2 using (subject_id, primitive))"""
_ERRORS = "te as (select g.subject_id, g.primitive, g.k, g.method, case when p.scale > 0 and g.scale > 0 and later_scale > 0 then 0.5 * abs(g.center - later_center) / p.scale + 0.5 * abs(ln(g.scale / later_scale)) end as transfer_error from grid g join orc using (subject_id, primitive) join grid p on p.subject_id = g.subject_id and p.primitive = g.primitive and p.k = g.k and p.method = 'population')"


@query(f"{_G}, {_ORACLE} select subject_id, primitive, round(later_center, 6)::double as later_center, round(later_scale, 6)::double as later_scale, n_rows from orc")
def op200_future_oracles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rep.future_oracles(RepParts(spark, folder).rows_), 6, "later_center", "later_scale")


@query(f"{_G}, {_ORACLE}, {_ERRORS} select subject_id, primitive, k, method, round(transfer_error, 5)::double as transfer_error from te")
def op222_transfer_errors(spark: SparkSession, folder: str) -> DataFrame:
    p = RepParts(spark, folder)
    return rounded(rep.transfer_errors(p.grid, rep.future_oracles(p.rows_)), 5, "transfer_error")


_DOMAIN_SQL = "case when primitive like 'screen%' or primitive like 'usage%' then 'digital' when primitive like 'phone%' or primitive like 'step%' then 'physical' when primitive like '%light%' then 'light' else 'other' end"


def _domain():
    p = F.col("primitive")
    return F.when(p.startswith("screen") | p.startswith("usage"), "digital").when(p.startswith("phone") | p.startswith("step"), "physical").when(p.contains("light"), "light").otherwise("other")


@query(f"{_G}, {_ORACLE}, {_ERRORS}, dm as (select subject_id, k, method, {_DOMAIN_SQL} as domain, avg(transfer_error) as v from te where transfer_error is not null group by all), pe as (select subject_id, k, method, avg(v) as v from dm group by all) select k, method, count(*)::bigint as n_participants, round(avg(v), 5)::double as mean_error from pe group by 1, 2")
def op051_transfer_summary(spark: SparkSession, folder: str) -> DataFrame:
    p = RepParts(spark, folder)
    return rounded(rep.rolled_up(rep.transfer_errors(p.grid, rep.future_oracles(p.rows_)), _domain()), 5, "mean_error")


_PATCH = """pt as (select p.view_id, p.seed, sc.subject_id, sc.sensor_day_id, sc.primitive, p.masked_value, sc.z, case when sc.scale > 0 and p.masked_value is not null then greatest(least((p.masked_value - sc.center) / sc.scale, 5), -5) end as z_masked, sc.confidence from played p join sc using (view_id))"""
_PP = f"with {DAILY}, {CONF}, {GRID}, {SCORED}, {MASKS}, {AUDIT}, {PLAYED}, {_PATCH}"


@query(f"{_PP} select view_id, seed, primitive, round(z, 5)::double as z, round(z_masked, 5)::double as z_masked from pt")
def op215_feature_patches(spark: SparkSession, folder: str) -> DataFrame:
    p = RepParts(spark, folder)
    return rounded(rep.feature_patches(p.rows_, p.played.select("view_id", "seed", "masked_value"), p.grid).select("view_id", "seed", "primitive", "z", "z_masked"), 5, "z", "z_masked")


@query(f"""{_PP}, la as (select s.seed, r.subject_id, r.sensor_day_id, r.primitive, case when pt.seed is not null then pt.masked_value else r.value end as value, case when pt.seed is not null then pt.z_masked else r.z end as z, r.confidence from (select distinct seed, subject_id, sensor_day_id from pt) s join sc r using (subject_id, sensor_day_id) left join pt on pt.seed = s.seed and pt.primitive = r.primitive),
 {indicators_sql('la', 'seed, subject_id, sensor_day_id', '_n')}, lo as (select s.seed, r.subject_id, r.sensor_day_id, r.primitive, r.value, r.z, r.confidence from (select distinct seed, subject_id, sensor_day_id from pt) s join sc r using (subject_id, sensor_day_id)), {indicators_sql('lo', 'seed, subject_id, sensor_day_id', '_o')}
 select seed, subject_id, sensor_day_id, indicator, round(o.value, 5)::double as value, round(n.value, 5)::double as patched_value from ind_o o full join ind_n n using (seed, subject_id, sensor_day_id, indicator) where round(o.value, 5) is distinct from round(n.value, 5)""")
def op216_patched_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators that a masked primitive changes, laid over the reference row."""
    p = RepParts(spark, folder)
    played = materialize(p.played.select("view_id", "seed", "masked_value"), "played")
    out = rep.patched_indicators(p.scored, rep.feature_patches(p.rows_, played, p.grid))
    return rounded(out, 5, "value", "patched_value").where(~F.col("value").eqNullSafe(F.col("patched_value"))).select("seed", "subject_id", "sensor_day_id", "indicator", "value", "patched_value")


_BLOCKS = f"""bl as (select subject_id, sensor_day_id, 'calendar__' || f as feature, x from (select distinct subject_id, sensor_day_id, lifelog_date, elapsed from cq), lateral (values ('weekday_sin', sin((isodow(lifelog_date) - 1) * (2 * 3.141592653589793 / 7))), ('weekday_cos', cos((isodow(lifelog_date) - 1) * (2 * 3.141592653589793 / 7))), ('trend', elapsed / 30.0)) v(f, x)
 union all select subject_id, sensor_day_id, 'quality__' || primitive || '_' || f, x from cq, lateral (values ('confidence', confidence), ('coverage', coverage), ('observed', valid)) v(f, x)
 union all select subject_id, sensor_day_id, 'raw__' || primitive, value from cq union all select cq.subject_id, sensor_day_id, m || '__' || cq.primitive, case when scale > 0 and value is not null then {_CUT.format('(value - center) / scale')} end from cq join (select *, method as m from grid where k = 14 and method in ('population', 'shrinkage')) g on g.subject_id = cq.subject_id and g.primitive = cq.primitive
 union all select subject_id, sensor_day_id, 'composed__' || indicator, value from ind)"""


def _arm_rows(p: RepParts) -> dict[str, DataFrame]:
    rows = p.rows_
    long = lambda df, items: df.select(*rep.DAY, F.explode(F.array(*(F.struct(n.alias("feature"), x.cast("double").alias("x")) for n, x in items))).alias("f")).select(*rep.DAY, "f.*")
    angle = F.weekday("lifelog_date") * (2 * 3.141592653589793 / 7)
    calendar = long(rows.select(*rep.DAY, "lifelog_date", "elapsed").distinct(), [(F.lit("weekday_sin"), F.sin(angle)), (F.lit("weekday_cos"), F.cos(angle)), (F.lit("trend"), F.col("elapsed") / 30.0)])
    name = lambda part: F.concat_ws("_", "primitive", F.lit(part))
    quality = long(rows, [(name("confidence"), F.col("confidence")), (name("coverage"), F.col("coverage")), (name("observed"), F.col("value_only"))])
    z = lambda m: rep.scored(rows, p.grid.where(f"k = 14 and method = '{m}'")).select(*rep.DAY, F.col("primitive").alias("feature"), F.col("z").alias("x"))
    composed = rep.composed_indicators(p.scored).select(*rep.DAY, F.col("indicator").alias("feature"), F.col("value").alias("x"))
    return {"calendar": calendar, "quality": quality, "raw": rows.select(*rep.DAY, F.col("primitive").alias("feature"), F.col("value").alias("x")), "population": z("population"), "shrinkage": z("shrinkage"), "composed": composed}


_ARM = {a: ", ".join(repr(b) for b in blocks) for a, blocks in rep.ARMS.items()}


@query(f"{_G}, {SCORED}, {indicators_sql('sc', _DAY)}, {_BLOCKS} " + " union all ".join(f"select '{a}' as arm, feature, count(*)::bigint as n_days, count(x)::bigint as n_known, round(sum(x), 4)::double + 0.0 as total from bl where split_part(feature, '__', 1) in ({b}) group by feature" for a, b in _ARM.items()))
def op213_outcome_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Six sets of features of each day: how often each is known, and its sum."""
    blocks, out = _arm_rows(RepParts(spark, folder)), None
    for arm in rep.ARMS:
        got = rep.arm_features(blocks, arm).groupBy("feature").agg(F.count(F.lit(1)).alias("n_days"), F.count("x").alias("n_known"), F.sum("x").alias("total")).select(F.lit(arm).alias("arm"), "*")
        out = got if out is None else out.unionByName(got)
    return rounded(out, 4, "total").withColumn("total", F.col("total") + 0.0)


_CALIBRATION = f"""cd as (select view_id, subject_id, primitive, value, confidence from cq where elapsed between 1 and 14 and value is not null and confidence > 0), on1 as (select cd.view_id, cd.subject_id, cd.primitive, p.scenario, p.draw, max(p.masked_value) as masked_value from cd join played p using (view_id) group by all),
 ru as (select subject_id, primitive, scenario, draw, count(*)::bigint as n_masked from on1 group by all), ea as (select ru.scenario, ru.draw, cd.subject_id, cd.primitive, cd.confidence, case when o.view_id is not null then o.masked_value else cd.value end as value from ru join cd on cd.subject_id = ru.subject_id and cd.primitive = ru.primitive left join on1 o on o.view_id = cd.view_id and o.scenario = ru.scenario and o.draw = ru.draw),
 {wmedian_sql("nc", "ea", "subject_id, primitive, scenario, draw", "value", "confidence", "masked_center")}, {wmedian_sql("oc0", "cd", "subject_id, primitive", "value", "confidence", "center")}"""


@query(f"with {DAILY}, {CONF}, {MASKS}, {AUDIT}, {PLAYED}, {_CALIBRATION} select subject_id, primitive, scenario, draw, round(center, 6)::double as center, round(masked_center, 6)::double as masked_center, n_masked from ru join oc0 using (subject_id, primitive) left join nc using (subject_id, primitive, scenario, draw)")
def op220_calibration_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrations estimated anew under each scenario and draw that masks one of their days."""
    p = RepParts(spark, folder)
    return rounded(rep.calibration_under_masks(p.rows_, materialize(p.played, "played")), 6, "center", "masked_center")


_DUAL = f"du as (select subject_id, sensor_day_id, primitive, case when b.scale > 0 then {_CUT.format('(value - a.center) / b.scale')} end as rz from cq join grid a using (subject_id, primitive) join grid b using (subject_id, primitive) where a.k = 14 and b.k = 14 and a.method = 'shrinkage' and b.method = 'population' and value is not null)"


@query(f"{_G}, {_DUAL}, pp(l, r) as (values {', '.join(f'({a!r}, {b!r})' for a, b in rep.PAIRS)}) select a.subject_id, a.sensor_day_id, pp.l as left, pp.r as right, round(abs(a.rz - b.rz), 5)::double as discrepancy, sign(a.rz) = sign(b.rz) as same_sign from pp join du a on a.primitive = pp.l join du b on b.primitive = pp.r and b.subject_id = a.subject_id and b.sensor_day_id = a.sensor_day_id where a.rz is not null and b.rz is not null".replace("as left", 'as "left"').replace("as right", 'as "right"'))
def op053_pair_days(spark: SparkSession, folder: str) -> DataFrame:
    """Both sensors of a behaviour on one day, on the reference scale."""
    p = RepParts(spark, folder)
    return rounded(rep.pair_days(rep.dual_coordinates(p.rows_.where("value is not null"), p.grid)), 5, "discrepancy")


_INNER = GRID.replace("cq", "cqi")
for _name in ("pk", "kc", "ko", "km", "kn", "own", "tr", "tc", "toff", "tm", "oth", "don", "gb", "grid"):
    _INNER = re.sub(rf"\b{_name}(?=\b|_[gc]\b)", f"{_name}i", _INNER)


@query(f"{_G}, cqi as (select * from cq where subject_id <> (select min(subject_id) from cq)), {_INNER} select subject_id, primitive, k, method, round(center, 6)::double as center, round(scale, 6)::double as scale, basis from gridi union all select subject_id, primitive, k, method, round(center, 6)::double, round(scale, 6)::double, basis from grid where subject_id = (select min(subject_id) from cq)")
def op208_fold_safe_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Baselines with the first participant held out of everything that the others are compared with."""
    p = RepParts(spark, folder)
    outer = p.rows_.agg(F.min("subject_id")).first()[0]
    return rounded(rep.fold_safe_grid(p.rows_, outer), 6, "center", "scale")
