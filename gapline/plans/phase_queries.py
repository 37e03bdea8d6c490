"""Queries of half-hour phases over the prepared views: bins, templates, and repair of masked days, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import phases, primitives
from gapline.plans.primitive_queries import DAILY, FRAMED, query as _query, rounded
from gapline.plans.replay_queries import MASKS, Parts
from gapline.sources.tables import each_once, read
from gapline.staging import join_bounded, materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = partial(_query, into=(QUERIES, ORACLES))
KEYS = ["view_id", "subject_id", "sensor_day_id", "primitive", "elapsed"]


def wmedian_sql(name: str, source: str, keys: str, value: str, weight: str, out: str) -> str:
    return f"""{name}_g as (select {keys}, {value} as v, sum({weight}) as w from {source} where {weight} > 0 and {value} is not null group by all),
 {name}_c as (select *, sum(w) over (partition by {keys} order by v) as upto, sum(w) over (partition by {keys}) / 2 as half, lead(v) over (partition by {keys} order by v) as nxt from {name}_g),
 {name} as (select {keys}, arg_min(case when abs(upto - half) <= 1e-12 and nxt is not null then (v + nxt) / 2 else v end, v) as {out} from {name}_c where upto >= half - 1e-12 group by {keys})"""


PHASES = """cal as (select sensor_day_id, max(elapsed_day_index) as elapsed from calendar_days group by 1),
 ph as (select x.*, cal.elapsed, floor(minute / 30)::int as phase_bin, 30.0 / cad as expected_units, case when op in ('additive_load', 'binary_active_minutes') then 'additive' when op in ('binary_load', 'activity_load', 'exposure_mean') then 'rate' else 'timing' end as kind,
  case when op in ('additive_load', 'evening_p90') then v * sc when op = 'binary_active_minutes' then v * p_epoch when op = 'exposure_mean' then ln(1 + v) else v end as c from x left join cal using (sensor_day_id) where ok and op in ('additive_load', 'binary_active_minutes', 'binary_load', 'activity_load', 'exposure_mean', 'evening_p90')),
 pb0 as (select view_id, subject_id, sensor_day_id, primitive, elapsed, phase_bin, any_value(kind) as kind, count(*)::bigint as units, sum(c) as numerator, least(count(*) / any_value(expected_units), 1)::double as support, count(case when c > 0 then 1 end)::bigint as n_events, sum(case when c > 0 then c else 0 end) as event_mass from ph group by all),
 pbm as (select view_id, phase_bin, minute, sum(c) as w from ph where kind = 'timing' and c > 0 group by all), pbc as (select *, sum(w) over (partition by view_id, phase_bin order by minute) as upto, sum(w) over (partition by view_id, phase_bin) as total from pbm),
 pbl as (select view_id, phase_bin, min(minute) as late from pbc where upto >= total * (0.9 * (1 - 1e-12)) group by 1, 2),
 pb as (select pb0.*, case kind when 'additive' then numerator when 'rate' then numerator / units else late end as bin_value from pb0 left join pbl using (view_id, phase_bin))"""
_PER = f"""pd as (select subject_id, primitive, phase_bin, bin_value, support, unnest(range(elapsed + 1, 16))::int as target from pb where bin_value is not null and elapsed between 1 and 14 and support > 0),
 {wmedian_sql("pcen", "pd", "subject_id, primitive, phase_bin, target", "bin_value", "support", "personal")}, psz as (select subject_id, primitive, phase_bin, target, sum(support) as n from pd group by all),
 poff as (select pd.*, abs(bin_value - personal) as off from pd join pcen using (subject_id, primitive, phase_bin, target)), {wmedian_sql("pmad", "poff", "subject_id, primitive, phase_bin, target", "off", "support", "mad")},
 per as (select * from pcen join psz using (subject_id, primitive, phase_bin, target) join pmad using (subject_id, primitive, phase_bin, target)),
 pop as (select a.subject_id, a.primitive, a.phase_bin, median(b.personal) as population from per a left join per b on b.primitive = a.primitive and b.phase_bin = a.phase_bin and b.subject_id <> a.subject_id and b.target = 15 where a.target = 15 group by 1, 2, 3),
 tp0 as (select per.subject_id, per.primitive, per.phase_bin, per.target, n, mad, case when n >= 3 - 1e-9 then personal end as personal_phase, population as population_phase from per left join pop using (subject_id, primitive, phase_bin)),
 glo as (select subject_id, primitive, target, median(personal) as personal_global from per where n >= 3 - 1e-9 group by 1, 2, 3),
 tp as (select tp0.*, coalesce(n / (n + 7) * personal_phase + (1 - n / (n + 7)) * population_phase, personal_phase, population_phase) as phaseguard, personal_global from tp0 left join glo using (subject_id, primitive, target))"""
BINS = f"with {FRAMED}, {PHASES}"


class PhaseParts(Parts):
    """What the queries of phases share."""

    def make_readings(self):
        days = each_once(read(self.records.sparkSession, self.folder, "calendar_days"), ["sensor_day_id", "elapsed_day_index"]).groupBy("sensor_day_id").agg(F.max("elapsed_day_index").alias("elapsed"))
        return join_bounded(phases.phase_readings(self.framed), days, ["sensor_day_id"], "left")

    def make_bins(self):
        return materialize(phases.view_bins(self.readings, KEYS), "bins")

    def make_personal(self):
        return materialize(phases.personal_templates(self.bins), "personal")

    def make_templates(self):
        return phases.templates(self.personal, phases.population_templates(self.personal))

    def make_cut(self):
        rows = self.readings.select("view_id", "record_id", "phase_bin", "contribution")
        return self.gone.join(rows, ["view_id", "record_id"]).groupBy("view_id", "seed", "phase_bin").agg(F.count(F.lit(1)).alias("deleted_units"), F.sum("contribution").alias("deleted_sum"))

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self.folder = folder


@query(f"{BINS} select view_id, subject_id, sensor_day_id, primitive, elapsed, phase_bin, kind, units, round(numerator, 7)::double as numerator, round(support, 6)::double as support, n_events, round(event_mass, 7)::double as event_mass, round(bin_value, 7)::double as bin_value from pb")
def op108_view_bins(spark: SparkSession, folder: str) -> DataFrame:
    out = rounded(rounded(PhaseParts(spark, folder).bins, 7, "numerator", "event_mass", "bin_value"), 6, "support")
    return out.select(*KEYS, "phase_bin", "kind", "units", "numerator", "support", "n_events", "event_mass", "bin_value")


_AUDIT = f"""with {DAILY}, {PHASES}, s as (select view_id, any_value(kind) as kind, sum(numerator) as s, sum(units) as n from pb group by 1), dm as (select view_id, minute, sum(c) as w from ph where kind = 'timing' and c > 0 group by all), dc as (select *, sum(w) over (partition by view_id order by minute) as upto, sum(w) over (partition by view_id) as total from dm),
 dl as (select view_id, min(minute) as late from dc where upto >= total * (0.9 * (1 - 1e-12)) group by 1), dv as (select s.view_id, case kind when 'additive' then s when 'rate' then s / n else late end as day_value from s left join dl using (view_id))"""


@query(f"{_AUDIT} select d.primitive, count(*)::bigint as n_days, count(case when day_value is not distinct from value or abs(day_value - value) <= 1e-6 * greatest(abs(value), 1) then 1 end)::bigint as n_equal from daily d join dv using (view_id) group by 1")
def op187_phase_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each day put together from its half hours is the day's feature."""
    p = PhaseParts(spark, folder)
    days = phases.days_of_bins(p.bins, p.readings, ["view_id"]).join(p.daily.select("view_id", "primitive", "value"), "view_id")
    same = F.col("day_value").eqNullSafe(F.col("value")) | (F.abs(F.col("day_value") - F.col("value")) <= 1e-6 * F.greatest(F.abs("value"), F.lit(1.0)))
    return days.groupBy("primitive").agg(F.count(F.lit(1)).alias("n_days"), F.count_if(same).alias("n_equal"))


@query(f"{BINS}, {_PER} select subject_id, primitive, phase_bin, target, round(n, 6)::double as n, round(personal, 7)::double as personal, round(mad, 7)::double as mad from per")
def op174_personal_templates(spark: SparkSession, folder: str) -> DataFrame:
    out = PhaseParts(spark, folder).personal
    return rounded(rounded(out, 6, "n"), 7, "personal", "mad").select("subject_id", "primitive", "phase_bin", "target", "n", "personal", "mad")


@query(f"{BINS}, {_PER} select subject_id, primitive, phase_bin, target, round(personal_phase, 7)::double as personal_phase, round(population_phase, 7)::double as population_phase, round(phaseguard, 7)::double as phaseguard, round(personal_global, 7)::double as personal_global from tp")
def op177_template_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """The four comparators of each half hour."""
    names = ["personal_phase", "population_phase", "phaseguard", "personal_global"]
    return rounded(PhaseParts(spark, folder).templates, 7, *names).select("subject_id", "primitive", "phase_bin", "target", *names)


_EVENTS = """em as (select subject_id, primitive, phase_bin, sum(c) as m from ph where kind = 'timing' and c > 0 group by all), et as (select subject_id, primitive, sum(m) as total from em group by all), ed as (select subject_id, primitive, count(distinct view_id) as days from ph where kind = 'timing' group by all),
 eo as (select subject_id, primitive, phase_bin, m / total as personal from em join et using (subject_id, primitive)), es as (select et.subject_id, primitive, phase_bin from et join (select distinct primitive, phase_bin from eo) using (primitive)),
 ef as (select es.*, coalesce(eo.personal, 0) as personal from es left join eo using (subject_id, primitive, phase_bin)),
 ep as (select a.subject_id, a.primitive, a.phase_bin, any_value(a.personal) as personal, avg(b.personal) as population from ef a left join ef b on b.primitive = a.primitive and b.phase_bin = a.phase_bin and b.subject_id <> a.subject_id group by 1, 2, 3),
 ev2 as (select ep.*, case when population is null then personal else days / (days + 7.0) * personal + (1 - days / (days + 7.0)) * population end as blend from ep join ed using (subject_id, primitive))"""


@query(f"{BINS}, {_EVENTS} select subject_id, primitive, phase_bin, round(personal, 6)::double as personal, round(population, 6)::double as population, round(blend, 6)::double as blend from ev2")
def op181_event_distributions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(phases.event_distributions(PhaseParts(spark, folder).readings), 6, "personal", "population", "blend")


_CUT = """cut as (select g.view_id, g.seed, ph.phase_bin, count(*)::bigint as deleted_units, sum(ph.c) as deleted_sum from gone g join ph using (view_id, record_id) group by 1, 2, 3)"""


@query(f"with {FRAMED}, {MASKS}, {PHASES}, {_CUT} select view_id, seed, phase_bin, deleted_units, round(deleted_sum, 7)::double as deleted_sum, units, round(numerator, 7)::double as numerator from cut join pb using (view_id, phase_bin)")
def op182_phase_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What each mask takes out of the half hours that it meets."""
    p = PhaseParts(spark, folder)
    out = p.cut.join(p.bins.select("view_id", "phase_bin", "units", "numerator"), ["view_id", "phase_bin"])
    return rounded(out, 7, "deleted_sum", "numerator")


_REPAIR = """re as (select s.seed, pb.*, coalesce(cut.deleted_units, 0) as du, coalesce(cut.deleted_sum, 0) as ds, least(elapsed, 15) as target from (select distinct view_id, seed from cut) s join pb using (view_id) left join cut using (view_id, seed, phase_bin)),
 rt as (select re.*, tp.phaseguard as template from re left join tp using (subject_id, primitive, phase_bin, target)),
 rs as (select view_id, seed, subject_id, primitive, any_value(kind) as kind, sum(numerator - ds) as s, sum(units - du) as n, count(case when du > 0 and template is null then 1 end) as without, sum(case when du > 0 then template * du / units end) as added, sum(case when du > 0 then template * du end) as rated, sum(du) as filled from rt group by 1, 2, 3, 4)"""


@query(f"""with {FRAMED}, {MASKS}, {PHASES}, {_PER}, {_CUT}, {_REPAIR} select view_id, seed, subject_id, primitive, round(case when kind = 'additive' then s when kind = 'rate' and n > 0 then s / n end, 7)::double as observed_value,
 round(case when kind <> 'timing' and without = 0 then case when kind = 'additive' then s + added else (s + rated) / (n + filled) end end, 7)::double as repaired_value, case when kind = 'timing' then 'timing_needs_events' when without > 0 then 'missing_template' end as abstention from rs""")
def op184_phase_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Masked days of sums and rates repaired from blended templates, with the reason where that isn't possible."""
    p = PhaseParts(spark, folder)
    return rounded(phases.repaired_days(p.bins, p.cut, p.templates), 7, "observed_value", "repaired_value")


@query(f"""with {FRAMED}, {MASKS}, {PHASES}, {_EVENTS}, {_CUT}, rb as (select s.seed, pb.view_id, pb.phase_bin, numerator - coalesce(deleted_sum, 0) as kept, coalesce(deleted_sum, 0) as ds, case when coalesce(deleted_units, 0) > 0 then coalesce(blend, 0) else 0 end as hit
  from (select distinct view_id, seed from cut) s join pb using (view_id) left join cut using (view_id, seed, phase_bin) left join ev2 on ev2.subject_id = pb.subject_id and ev2.primitive = pb.primitive and ev2.phase_bin = pb.phase_bin where pb.kind = 'timing'),
 rm as (select *, kept + case when sum(hit) over w > 0 then sum(ds) over w * hit / sum(hit) over w else 0 end as mass from rb window w as (partition by view_id, seed)), rc as (select *, sum(mass) over (partition by view_id, seed order by phase_bin) as upto, sum(mass) over (partition by view_id, seed) as total from rm where mass > 0)
 select view_id, seed, (min(phase_bin) * 30 + 15.0)::double as repaired_time from rc where upto >= total * (0.9 * (1 - 1e-9)) group by 1, 2""")
def op184_timing_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Masked times of day repaired from where the participant's and the others' events lie."""
    p = PhaseParts(spark, folder)
    return phases.repaired_times(p.bins, p.cut, phases.event_distributions(p.readings))
