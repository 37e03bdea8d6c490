"""Queries of reports over masks, replays and labelled windows, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import reporting as rp
from gapline.operators import inference, replays
from gapline.plans.contract_queries import WINDOWS, windows
from gapline.plans.phase_queries import _CUT, _PER, _REPAIR, PHASES, PhaseParts
from gapline.plans.primitive_queries import DAILY, FRAMED, query as _query, rounded
from gapline.plans.replay_queries import _P, _SCALES, _SCATTER, AUDIT, MASKS, PLAYED, TARGETS, _scales
from gapline.plans.representation_queries import _PP, RepParts
from gapline.operators import phases, representations as rep
from gapline.sources.tables import each_once, read
from gapline.staging import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = partial(_query, into=(QUERIES, ORACLES))

#: Labels with what others' labels of the same hour (p) and sensor (q) foretell.
LABELLED = f"""{WINDOWS}, lb0 as (select window_id, dataset, subject_id, sensor_file, hour(label_time)::int as hour, label from win where label is not null and label_time is not null and subject_id is not null),
 ph1 as (select subject_id, sensor_file, hour, count(*) as n, sum(label) as s from lb0 group by all), ph2 as (select *, (sum(s) over w - s + 1) / (sum(n) over w - n + 2)::double as p from ph1 window w as (partition by sensor_file, hour)),
 qh1 as (select subject_id, sensor_file, count(*) as n, sum(label) as s from lb0 group by all), qh2 as (select *, (sum(s) over w - s + 1) / (sum(n) over w - n + 2)::double as q from qh1 window w as (partition by sensor_file)),
 pr as (select l.*, ph2.p, qh2.q from lb0 l join ph2 on ph2.subject_id = l.subject_id and ph2.sensor_file is not distinct from l.sensor_file and ph2.hour = l.hour join qh2 on qh2.subject_id = l.subject_id and qh2.sensor_file is not distinct from l.sensor_file)"""
_LOSS = "case when label = 1 then -ln(greatest(least({0}, 1 - 1e-6), 1e-6)) else -ln(1 - greatest(least({0}, 1 - 1e-6), 1e-6)) end"
SCORED = f"rs as (select *, {_LOSS.format('p')} as log_loss, (p - label) * (p - label) as brier, {_LOSS.format('q')} as log_loss_q from pr)"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of windows with what all other participants' labels foretell: by sensor and hour (``p``), and by sensor (``q``)."""
    rows = windows(spark, folder).where("label is not null and label_time is not null and subject_id is not null").select("window_id", "dataset", "subject_id", "sensor_file", F.hour("label_time").alias("hour"), "label")
    return rp.others_prevalence(rp.others_prevalence(rows, "subject_id", "label", ["sensor_file", "hour"], "p"), "subject_id", "label", ["sensor_file"], "q")


@query(f"""with {LABELLED}, {SCORED}, pt as (select subject_id, dataset, count(*)::bigint as n, avg(log_loss) as a, avg(brier) as b from rs group by 1, 2), pp as (select subject_id, count(*)::bigint as n, avg(a) as a, avg(b) as b from pt group by 1)
 select level, name, n, round(a, 6)::double as log_loss, round(b, 6)::double as brier from (select 'participant_target' as level, subject_id || '/' || dataset as name, n, a, b from pt union all select 'participant', subject_id, n, a, b from pp union all select 'target', dataset, count(*), avg(a), avg(b) from pt group by dataset
  union all select 'macro', 'all', count(*), avg(a), avg(b) from pp union all select 'row', 'all', count(*), avg(log_loss), avg(brier) from rs)""")
def op099_score_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = rp.row_scores(predictions(spark, folder), "label", "p")
    return rounded(rp.score_levels(rows, "subject_id", "dataset"), 6, "log_loss", "brier")


@query(f"with {LABELLED}, {SCORED}, d as (select subject_id, dataset, avg(log_loss_q - log_loss) as delta from rs group by 1, 2), s as (select dataset, count(*)::bigint as n, sum(delta) as s, median(delta) as median, count(case when delta > 0 then 1 end)::bigint as n_positive, max(abs(delta)) as top, sum(abs(delta)) as whole, stddev_samp(delta) as sd, max(delta) as largest from d group by 1) select dataset, n, round(s / n, 6)::double as mean, round(median, 6)::double as median, n_positive, round(case when n > 1 then (s - largest) / (n - 1) end, 6)::double as least_without_one, round(case when whole > 0 then top / whole end, 6)::double as concentration, round(case when n > 1 and sd > 0 then (s / n) / (sd / sqrt(n)) end, 5)::double as studentized from s")
def op257_delta_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How much the hour helps over the sensor's prevalence, by participant."""
    rows = rp.row_scores(predictions(spark, folder), "label", "p")
    both = rp.row_scores(rows.withColumnRenamed("log_loss", "a").drop("brier"), "label", "q")
    own = both.groupBy("subject_id", "dataset").agg(F.avg(F.col("log_loss") - F.col("a")).alias("delta"))
    out = rp.delta_summary(own, ["dataset"], "subject_id", "delta")
    return rounded(rounded(out, 6, "mean", "median", "least_without_one", "concentration"), 5, "studentized")


@query(f"with {LABELLED}, {SCORED}, e as (select subject_id, abs(p - label) as err, -abs(p - 0.5) as risk, row_number() over (partition by subject_id order by -abs(p - 0.5), abs(p - label)) as r, count(*) over (partition by subject_id) as n from rs) select subject_id, count(*)::bigint as kept, round(median(err), 6)::double as retained_error from e where r <= greatest(1, floor(n * 0.7 + 1e-9)) group by 1")
def op134_retained_error(spark: SparkSession, folder: str) -> DataFrame:
    rows = predictions(spark, folder).withColumns({"err": F.abs(F.col("p") - F.col("label")), "risk": -F.abs(F.col("p") - 0.5)})
    return rounded(rp.retained_error(rows, "subject_id", "risk", "err"), 6, "retained_error")


@query(f"with {LABELLED}, {SCORED}, o as (select subject_id, dataset, avg(log_loss) as log_loss, avg(brier) as brier, avg(((p >= 0.5) = (label = 1))::int) as accuracy from rs group by 1, 2), l as (select dataset, 'log_loss' as metric, log_loss as x from o union all select dataset, 'brier', brier from o union all select dataset, 'accuracy', accuracy from o) select dataset, metric, count(*)::bigint as n, round(avg(x), 6)::double as mean, round(median(x), 6)::double as median, round(min(x), 6)::double as least, round(max(x), 6)::double as greatest from l group by 1, 2")
def op276_metric_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = rp.row_scores(predictions(spark, folder), "label", "p")
    own = rows.groupBy("subject_id", "dataset").agg(F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy"))
    return rounded(rp.metric_summary(own, ["dataset"], ["log_loss", "brier", "accuracy"]), 6, "mean", "median", "least", "greatest")


_ERR = f"{_P}, {_SCALES}, er as (select p.*, case when replay_status = 'finite' and standardizer > 0 then abs(masked_value - original_value) / standardizer end as error from played p left join scl using (subject_id, primitive))"


class ReportParts(RepParts):
    def make_errors(self):
        self.daily = materialize(self.daily, "daily")
        return materialize(replays.standardized_errors(self.played, _scales(self.daily)), "errors")


@query(f"""{_ERR}, rost as (select distinct primitive, scenario, subject_id from er), drw as (select distinct primitive, scenario, draw from er), pdr as (select primitive, scenario, subject_id, draw, count(*) as n, count(error) as k, avg(error) as e from er group by all),
 ful as (select r.primitive, r.scenario, r.subject_id, d.draw, n, k, e from rost r join drw d on d.primitive = r.primitive and d.scenario = r.scenario left join pdr p on p.primitive = r.primitive and p.scenario = r.scenario and p.subject_id = r.subject_id and p.draw = d.draw),
 per as (select primitive, scenario, subject_id, count(*) as nd, count(e) as kd, avg(e) as m, sum(n) as n, sum(k) as k from ful group by 1, 2, 3)
 select primitive, scenario, count(*)::bigint as n_participants, count(case when nd = kd then 1 end)::bigint as n_complete, round(avg(m), 5)::double as mean_error, round(sum(k) / sum(n), 6)::double as retention, round(case when count(*) = count(case when nd = kd then 1 end) then avg(case when nd = kd then m end) end, 5)::double as macro_error from per group by 1, 2""")
def op096_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Errors from masks to draws to participants to all, with every participant's every draw in the denominator."""
    errors = ReportParts(spark, folder).errors
    out = rp.hierarchy(errors, ["primitive", "scenario"], "subject_id", "draw", "error", errors)
    return rounded(rounded(out, 5, "mean_error", "macro_error"), 6, "retention").select("primitive", "scenario", "n_participants", "n_complete", "mean_error", "retention", "macro_error")


@query(f"{_P}, c as (select primitive, replay_status, count(*) as n from played group by 1, 2) select primitive, sum(n)::bigint as n, string_agg(replay_status || '=' || n::varchar, '|' order by replay_status || '=' || n::varchar) as reasons from c group by 1")
def op098_reason_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rp.reason_histogram(RepParts(spark, folder).played, ["primitive"], "replay_status")


_SCENARIOS = ("contiguous_10pct", "contiguous_20pct", "contiguous_40pct", "outage_1h", "outage_3h", "outage_6h", "evening_critical", "empirical_gap")


@query(f"{_ERR}, o as (select primitive, scenario, subject_id, median(error) as m from er where error is not null group by 1, 2, 3) select primitive, " + ", ".join(f"round(median(case when scenario = '{s}' then m end), 5)::double as {s}" for s in _SCENARIOS) + " from o group by 1")
def op103_error_report(spark: SparkSession, folder: str) -> DataFrame:
    """Median errors by primitive and scenario."""
    return rounded(rp.pivoted_medians(ReportParts(spark, folder).errors, "primitive", "scenario", list(_SCENARIOS), "subject_id", "error"), 5, *_SCENARIOS)


@query(f"{_PP}, cr as (select p.primitive, p.scenario, 1 / (1 + exp(-pt.z)) as p, 1 / (1 + exp(-pt.z_masked)) as m from played p left join pt on pt.seed = p.seed and pt.view_id = p.view_id), s as (select primitive, scenario, count(*)::bigint as n_rows, count(case when p is not null and m is not null then 1 end)::bigint as n_finite, count(case when p is not null and m is null then 1 end)::bigint as n_abstained, count(case when p is null then 1 end)::bigint as n_unavailable, avg(abs(m - p)) as drift, avg(case when p is not null and m is not null then ((p >= 0.5) <> (m >= 0.5))::int end) as flip_rate, avg(case when m is not null and p is not null then abs(m - p) when p is not null then 1 end) as burden from cr group by 1, 2) select primitive, scenario, n_rows, n_finite, n_abstained, n_unavailable, round(drift, 5)::double as drift, round(flip_rate, 5)::double as flip_rate, round(burden, 5)::double as burden, round(case when n_rows > n_unavailable then n_finite / (n_rows - n_unavailable) end, 5)::double as coverage, round(case when n_rows > n_unavailable then n_abstained / (n_rows - n_unavailable) end, 5)::double as abstention from s")
def op101_condition_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What masks do to a decision on the score (its logistic against 0.5)."""
    p = RepParts(spark, folder)
    played = materialize(p.played, "played")
    patches = rep.feature_patches(p.rows_, played.select("view_id", "seed", "masked_value"), p.grid).select("view_id", "seed", "z", "z_masked")
    rows = played.join(patches, ["view_id", "seed"], "left").select("primitive", "scenario", (1 / (1 + F.exp(-F.col("z")))).alias("p"), (1 / (1 + F.exp(-F.col("z_masked")))).alias("p_masked"))
    out = rp.condition_rows(rows, ["primitive", "scenario"])
    return rounded(out, 5, "drift", "flip_rate", "burden", "coverage", "abstention")


@query("select (select count(distinct subject_id) from phase_views)::bigint as n_participants, (select count(distinct sensor_day_id) from phase_views)::bigint as n_days, (select count(distinct view_id) from phase_views)::bigint as n_views, (select count(distinct record_id) from phase_records)::bigint as n_records, (select count(distinct seed) from mask_intervals)::bigint as n_masks, (select count(distinct window_id) from prediction_windows)::bigint as n_windows")
def op104_study_design(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda table, **columns: read(spark, folder, table).agg(*(F.countDistinct(c).alias(n) for n, c in columns.items()))
    out = count("phase_views", n_participants="subject_id", n_days="sensor_day_id", n_views="view_id")
    for other in (count("phase_records", n_records="record_id"), count("mask_intervals", n_masks="seed"), count("prediction_windows", n_windows="window_id")):
        out = out.join(other)  # one row each
    return out


@query(f"with {FRAMED}, {MASKS}, {PHASES}, {_PER}, {_CUT}, {_REPAIR}, rr as (select primitive, case when kind <> 'timing' and without = 0 then case when kind = 'additive' then s + added else (s + rated) / (n + filled) end end as v, case when kind = 'timing' then 'timing_needs_events' when without > 0 then 'missing_template' end as why from rs) select primitive, count(*)::bigint as attempted, count(v)::bigint as imputed, count(why)::bigint as abstained, round(count(v) / count(*), 6)::double as imputed_share from rr group by 1")
def op105_fallback_table(spark: SparkSession, folder: str) -> DataFrame:
    p = PhaseParts(spark, folder)
    return rounded(rp.fallback_table(phases.repaired_days(p.bins, p.cut, p.templates), ["primitive"], "repaired_value", "abstention"), 6, "imputed_share")


@query(f"with {FRAMED}, {PHASES}, {_PER} select subject_id, primitive, count(*)::bigint as n_rows, count(distinct phase_bin)::bigint as n_units, round(min(n), 6)::double as least, round(median(n), 6)::double as median, round(max(n), 6)::double as greatest from tp group by grouping sets ((subject_id, primitive), (primitive))")
def op106_donor_tables(spark: SparkSession, folder: str) -> DataFrame:
    """How much support stands behind templates, by participant and in all."""
    return rounded(rp.donor_tables(PhaseParts(spark, folder).templates, "subject_id", "primitive", "n", "phase_bin"), 6, "least", "median", "greatest")


@query(f"with {DAILY} select primitive, count(*)::bigint as n_views, count(value)::bigint as n_valued, round(quantile_cont(coalesce(coverage, support_density), 0.25), 6)::double as coverage_25, round(quantile_cont(coalesce(coverage, support_density), 0.5), 6)::double as coverage_50, round(quantile_cont(coalesce(coverage, support_density), 0.75), 6)::double as coverage_75, sum(n_records)::bigint as n_records from daily group by 1")
def op107_support_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rp.support_table(RepParts(spark, folder).daily, ["primitive"]), 6, "coverage_25", "coverage_50", "coverage_75")


_CAND = f"""with {DAILY}, c0 as (select d.*, dd.expected_epochs * dd.cadence_minutes as minutes, coalesce(coverage, support_density) as cov_, 1 - coalesce(longest_gap_minutes, 0) / (dd.expected_epochs * dd.cadence_minutes)::double as whole from daily d join primitive_definitions dd on dd.primitive = d.primitive),
 c1 as (select *, concat_ws('|', case when value is null then 'primitive_nonfinite' end, case when status <> 'observed' then 'primitive_status_not_observed' end, case when censoring <> 'none' then 'censored' end, case when cov_ is null then 'availability_missing' end, case when cov_ = 0 then 'availability_zero' end, case when longest_gap_minutes is null and coverage is not null then 'gap_missing' end, case when whole <= 0 then 'gap_zero' end) as reasons from c0),
 c2 as (select *, row_number() over (partition by subject_id, primitive, reasons = '' order by cov_ desc nulls last, whole desc nulls last, sensor_day_id, view_id) as r from c1)"""


@query(f"{_CAND} select view_id, subject_id, sensor_day_id, primitive, reasons, reasons = '' and r <= 10 as selected, case when reasons = '' and r <= 10 then r end::int as rank from c2")
def op114_day_candidates(spark: SparkSession, folder: str) -> DataFrame:
    p = RepParts(spark, folder)
    sizes = p.definitions.select("primitive", (F.col("expected_epochs") * F.col("cadence_minutes")).alias("minutes"))
    return rp.day_candidates(p.daily.join(F.broadcast(sizes), "primitive"))  # a fixed table of 16 rows


@query(f"{_P}, e as (select distinct subject_id, primitive, scenario from played), d as (select primitive, scenario, max(draw) as m from played group by 1, 2), xg as (select e.*, unnest(range(0, m + 1))::int as draw from e join d using (primitive, scenario)) select subject_id, primitive, scenario, draw from xg where not exists (select 1 from played p where p.subject_id = xg.subject_id and p.primitive = xg.primitive and p.scenario = xg.scenario and p.draw = xg.draw)")
def op166_missing_replays(spark: SparkSession, folder: str) -> DataFrame:
    """Draws of a participant's scenario that no mask has: the gaps of the grid."""
    played = RepParts(spark, folder).masks.select("subject_id", "primitive", "scenario", "draw")
    last = played.groupBy("primitive", "scenario").agg(F.max("draw").alias("m"))
    grid = played.drop("draw").distinct().join(last, ["primitive", "scenario"]).select("subject_id", "primitive", "scenario", F.explode(F.sequence(F.lit(0), "m")).alias("draw"))
    return grid.join(played.distinct(), ["subject_id", "primitive", "scenario", "draw"], "left_anti")


_EFFECT = f"""with {DAILY}, {MASKS}, {AUDIT}, {PLAYED}, {PHASES}, {_PER}, {_CUT}, {_REPAIR}, rv as (select view_id, seed, case when kind <> 'timing' and without = 0 then case when kind = 'additive' then s + added else (s + rated) / (n + filled) end end as repaired from rs),
 gn as (select p.primitive, p.scenario, p.subject_id, abs(p.masked_value - p.original_value) - abs(rv.repaired - p.original_value) as gain from played p join rv using (view_id, seed) where p.masked_value is not null and rv.repaired is not null and p.original_value is not null), go as (select primitive, scenario, subject_id, median(gain) as m from gn group by all)"""


@query(_EFFECT + " select primitive, " + ", ".join(f"round(median(case when scenario = '{s}' then m end), 5)::double + 0.0 as {s}" for s in _SCENARIOS) + " from go group by 1")
def op272_effect_table(spark: SparkSession, folder: str) -> DataFrame:
    """How much nearer the repair from templates comes to the original than the masked value, by primitive and scenario."""
    p = PhaseParts(spark, folder)
    fixed = phases.repaired_days(p.bins, p.cut, p.templates).select("view_id", "seed", "repaired_value")
    both = p.played.join(fixed, ["view_id", "seed"]).withColumn("gain", F.abs(F.col("masked_value") - F.col("original_value")) - F.abs(F.col("repaired_value") - F.col("original_value")))
    out = rounded(rp.pivoted_medians(both, "primitive", "scenario", list(_SCENARIOS), "subject_id", "gain"), 5, *_SCENARIOS)
    wanted = out.select("primitive", *((F.col(c) + 0.0).alias(c) for c in _SCENARIOS))
    return wanted.where(F.coalesce(*_SCENARIOS).isNotNull())


_SIMPLE = "('binary_load', 'binary_active_minutes', 'activity_load', 'additive_load', 'exposure_mean')"
_GEO = f"""with {DAILY}, {MASKS}, {AUDIT}, {TARGETS}, {PLAYED}, {_SCATTER}, sl as (select x.view_id, pick.seed, any_value(op) as op, any_value(p_epoch) as p_epoch, any_value(sc) as sc, count(*) as n, sum(v) as s, sum(ln(1 + v)) as l from pick join x using (view_id, record_id) group by 1, 2),
 st as (select view_id, count(*) as n, sum(v) as s, sum(ln(1 + v)) as l from x where ok and op in {_SIMPLE} group by 1), sv2_ as (select sl.view_id, sl.seed, case when op in ('binary_load', 'activity_load') then (st.s - sl.s) / (st.n - sl.n) when op = 'binary_active_minutes' then (st.s - sl.s) * p_epoch when op = 'additive_load' then (st.s - sl.s) * sc else (st.l - sl.l) / (st.n - sl.n) end as v from sl join st using (view_id) where op in {_SIMPLE}),
 gd as (select p.primitive, p.scenario, p.subject_id, abs(p.masked_value - p.original_value) - abs(sv2_.v - p.original_value) as delta from played p join sv2_ using (view_id, seed) where p.masked_value is not null), gm as (select primitive, scenario, subject_id, median(delta) as m from gd where delta is not null group by all)"""


@query(_GEO + " select primitive, scenario, count(*)::bigint as n_participants, round(median(m), 5)::double + 0.0 as median_delta from gm group by 1, 2")
def op273_geometry_table(spark: SparkSession, folder: str) -> DataFrame:
    """At an equal number of deleted readings, how much further a mask moves a sum or mean than scattered deletion does."""
    p = RepParts(spark, folder)
    picked = replays.scattered_records(p.framed, p.targets, "gapline")
    counted = picked.join(p.framed.where("ok"), ["view_id", "record_id"]).groupBy("view_id", "seed").agg(F.count("v").alias("k"), F.sum("v").alias("d"), F.sum(F.log1p("v")).alias("dl"))
    spread = replays.block_values(p.framed, p.masks.join(counted.select("seed"), "seed", "left_semi"), counted).select("view_id", "seed", F.col("masked_value").alias("spread_value"))
    both = p.played.join(spread, ["view_id", "seed"]).withColumn("delta", F.abs(F.col("masked_value") - F.col("original_value")) - F.abs(F.col("spread_value") - F.col("original_value"))).where("delta is not null")
    own = both.groupBy("primitive", "scenario", "subject_id").agg(F.median("delta").alias("m"))
    out = own.groupBy("primitive", "scenario").agg(F.count(F.lit(1)).alias("n_participants"), F.median("m").alias("median_delta"))
    return rounded(out, 5, "median_delta").withColumn("median_delta", F.col("median_delta") + 0.0)


_NEWTON = f"""with recursive {LABELLED}, lz as (select label::double as y, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) as z from pr), st as (select count(*) as n, sum(y) as ones from lz),
 it(i, a, b) as (select 0, ln(ones / (n - ones)), 0.0::double from st union all select i + 1, a + (g4 * g0 - g3 * g1) / (g2 * g4 - g3 * g3), b + (g2 * g1 - g3 * g0) / (g2 * g4 - g3 * g3) from (select i, a, b, sum(y - m) as g0, sum((y - m) * z) as g1, sum(m * (1 - m)) as g2, sum(m * (1 - m) * z) as g3, sum(m * (1 - m) * z * z) as g4
  from (select it.i, it.a, it.b, lz.y, lz.z, 1 / (1 + exp(-(it.a + it.b * lz.z))) as m from it, lz where it.i < 12) group by i, a, b))"""


@query(f"{_NEWTON} select (select n from st)::bigint as n, round(a, 5)::double as intercept, round(b, 5)::double as slope from it where i = 12")
def op260_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How the labels' log odds follow from those foretold: intercept and slope."""
    return rounded(inference.calibration(predictions(spark, folder), "label", "p"), 5, "intercept", "slope")
