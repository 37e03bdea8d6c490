"""Queries of masks and replays over the prepared views and the study's mask intervals, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import primitives, replays
from gapline.plans import core_queries
from gapline.plans.primitive_queries import DAILY, FRAMED, coverage_sql, query as _query, rounded, values_sql
from gapline.sources.tables import read
from gapline.staging import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = partial(_query, into=(QUERIES, ORACLES))
ROOT = "gapline"

MASKS = f"""mk as (select distinct mask_row_id, seed, {core_queries._REAL_SUBJECT} as subject_id, {core_queries._REAL_DAY} as sensor_day_id, primitive, scenario, draw from mask_intervals),
 mkey as (select seed, max(subject_id) as subject_id, max(sensor_day_id) as sensor_day_id, max(primitive) as primitive, max(scenario) as scenario, max(draw)::int as draw from mk where seed is not null group by seed),
 mi as (select distinct seed, mask_start as s, mask_end as e from mask_intervals where seed is not null and mask_start < mask_end), mr as (select *, max(e) over (partition by seed order by s, e rows between unbounded preceding and 1 preceding) as reach from mi),
 ms as (select *, sum(case when reach >= s then 0 else 1 end) over (partition by seed order by s, e rows unbounded preceding) as island from mr), sp as (select seed, min(s) as m0, max(e) as m1 from ms group by seed, island),
 mv as (select fr.*, k.seed, k.scenario, k.draw from mkey k join fr on fr.subject_id = k.subject_id and fr.sensor_day_id = k.sensor_day_id and fr.primitive = k.primitive),
 gone as (select distinct mv.view_id, mv.seed, x.record_id from mv join sp using (seed) join x on x.view_id = mv.view_id and case when x.s1 <= x.s0 then x.t >= sp.m0 and x.t < sp.m1 else x.s0 < sp.m1 and x.s1 > sp.m0 end)"""
AUDIT = """tot as (select view_id, count(*)::bigint as n_records, count(case when ok then 1 end)::bigint as n_valid from x group by 1),
 hit as (select g.view_id, g.seed, count(*)::bigint as n_deleted, count(case when x.ok then 1 end)::bigint as n_valid_deleted, min(x.t) as first_deleted, max(x.t) as last_deleted from gone g join x using (view_id, record_id) group by 1, 2),
 audit as (select mv.view_id, mv.subject_id, mv.sensor_day_id, mv.primitive, mv.seed, mv.scenario, mv.draw, coalesce(n_records, 0)::bigint as n_records, coalesce(n_valid, 0)::bigint as n_valid, coalesce(n_deleted, 0)::bigint as n_deleted, coalesce(n_valid_deleted, 0)::bigint as n_valid_deleted, first_deleted, last_deleted
  from mv left join tot using (view_id) left join hit using (view_id, seed))"""
TARGETS = """target as (select a.view_id, a.subject_id, a.sensor_day_id, a.primitive, a.seed, a.scenario, a.draw, a.n_valid_deleted as k, a.n_valid, case when d.value is null then 'invalid_reference' when a.n_valid = 0 then 'no_valid_source_contribution' when a.n_valid_deleted = 0 then 'zero_valid_deleted_count'
  when a.n_valid_deleted >= a.n_valid then 'infeasible_valid_deleted_count' else 'eligible' end as reason, coalesce(coalesce(d.coverage, d.support_density) >= 0.8, false) as high_support from audit a left join daily d using (view_id))"""
_NAMES = "view_id, subject_id, sensor_day_id, primitive, seed, scenario, draw"
_BY = "view_id, seed"
REPLAY = f"""left_ as (select x.*, mv.seed, mv.scenario, mv.draw from mv join x using (view_id) left join gone g on g.view_id = x.view_id and g.seed = mv.seed and g.record_id = x.record_id where g.record_id is null)"""


def _after(text: str) -> str:
    """The same tables under names of their own, so that they can stand beside those of the whole views."""
    import re

    for name in ("sv", "pm", "pc", "pv", "lg", "lb", "lx", "lv", "cg", "cb", "cl", "cm", "cf", "cx", "cv", "hs", "hh", "hr", "hv", "val", "eb", "eg", "ec", "en", "cov"):
        text = re.sub(rf"\b{name}\b", f"{name}2", text)
    return text


PLAYED = f"""{REPLAY}, {_after(values_sql("left_", _BY))}, {_after(coverage_sql("left_", _BY))},
 played as (select mv.view_id, mv.subject_id, mv.sensor_day_id, mv.primitive, mv.seed, mv.scenario, mv.draw, d.value as original_value, v.value as masked_value, coalesce(h.n_deleted, 0)::bigint as n_deleted, coalesce(c.observed_epochs, 0)::int as observed_epochs, c.coverage, c.longest_gap_minutes, coalesce(v.censoring, 'unknown') as censoring,
  case when d.value is null then 'structurally_unavailable' when v.value is not null then 'finite' when mv.op = 'evening_p90' then 'abstained_no_event_support' else 'abstained_insufficient_support' end as replay_status
  from mv left join daily d using (view_id) left join val2 v using (view_id, seed) left join cov2 c using (view_id, seed) left join hit h using (view_id, seed))"""
_M = f"with {FRAMED}, {MASKS}"
_T = f"with {DAILY}, {MASKS}, {AUDIT}, {TARGETS}"
_P = f"with {DAILY}, {MASKS}, {AUDIT}, {PLAYED}"


class Parts:
    """What the queries of masks share, each made when first asked for.

    With ``shared`` set to a dictionary, the queries of one application over one
    folder also share it among each other: for tests, whose tables don't change.
    """

    shared: dict | None = None

    def __new__(cls, spark: SparkSession, folder: str):
        if Parts.shared is None:
            return super().__new__(cls)
        key = (cls, spark.sparkContext.applicationId, folder)
        return Parts.shared.setdefault(key, super().__new__(cls))

    def __init__(self, spark: SparkSession, folder: str):
        tables = {n: read(spark, folder, n) for n in ("phase_records", "phase_views", "primitive_definitions", "mask_intervals")}
        self.records, self.views, self.definitions, self.rows = tables.values()

    def __getattr__(self, name: str):
        if name.startswith(("make_", "__")):
            raise AttributeError(name)
        made = getattr(self, f"make_{name}")()
        if Parts.shared is not None:
            made = materialize(made, "shared")
        setattr(self, name, made)
        return made

    def make_framed(self):
        return materialize(primitives.framed(self.records, self.views, self.definitions), "framed")

    def make_masks(self):
        return materialize(replays.view_masks(self.rows, primitives.frames(self.views, self.definitions)), "masks")

    def make_spans(self):
        return replays.mask_spans(self.rows)

    def make_gone(self):
        return replays.deleted_records(self.framed, self.masks, self.spans)

    def make_daily(self):
        return primitives.daily_primitives(self.records, self.views, self.definitions)

    def make_audit(self):
        return replays.deletion_audit(self.framed, self.masks, self.gone)

    def make_targets(self):
        return replays.matched_targets(self.audit, self.daily)

    def make_played(self):
        return replays.replay(self.framed, self.masks, self.spans, self.daily)


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def _sql_text(*columns: str) -> str:
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') as {c}" for c in columns)


@query(f"{_M} select view_id, seed, record_id from gone")
def op058_deleted_records(spark: SparkSession, folder: str) -> DataFrame:
    return Parts(spark, folder).gone


@query(f"{_M}, {AUDIT} select {_NAMES}, n_records, n_valid, n_deleted, n_valid_deleted, {_sql_text('first_deleted', 'last_deleted')} from audit")
def op142_deletion_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _text(Parts(spark, folder).audit, "first_deleted", "last_deleted")


@query(f"""{_M}, hit as (select g.view_id, g.seed, count(*)::bigint as k, sum(v) as d, sum(ln(1 + v)) as dl from gone g join x using (view_id, record_id) where ok group by 1, 2), st as (select view_id, count(*) as n, sum(v) as s, sum(ln(1 + v)) as ls from x where ok and op in ('binary_load', 'binary_active_minutes', 'activity_load', 'additive_load', 'exposure_mean') group by 1)
 select mv.view_id, mv.seed, coalesce(k, 0)::bigint as n_valid_deleted, round(case when n > coalesce(k, 0) then case when op in ('binary_load', 'activity_load') then (s - coalesce(d, 0)) / (n - coalesce(k, 0)) when op = 'binary_active_minutes' then (s - coalesce(d, 0)) * p_epoch when op = 'additive_load' then (s - coalesce(d, 0)) * sc else (ls - coalesce(dl, 0)) / (n - coalesce(k, 0)) end end, 5)::double as masked_value
 from mv join st using (view_id) left join hit using (view_id, seed) where op in ('binary_load', 'binary_active_minutes', 'activity_load', 'additive_load', 'exposure_mean')""")
def op147_block_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Sums and means after each mask, by prefix sums."""
    p = Parts(spark, folder)
    return rounded(replays.block_values(p.framed, p.masks, replays.block_replay(p.framed, p.masks, p.spans)), 5, "masked_value")


@query(f"{_P} select {_NAMES}, round(original_value, 6)::double as original_value, round(masked_value, 6)::double as masked_value, n_deleted, observed_epochs, round(coverage, 6)::double as coverage, longest_gap_minutes, censoring, replay_status from played")
def op148_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Every primitive after every mask, with coverage and status."""
    return rounded(Parts(spark, folder).played, 6, "original_value", "masked_value", "coverage")


@query(f"{_P} select primitive, scenario, replay_status, count(*)::bigint as n_masks, sum(n_deleted)::bigint as n_deleted from played group by all")
def op156_replay_statuses(spark: SparkSession, folder: str) -> DataFrame:
    return Parts(spark, folder).played.groupBy("primitive", "scenario", "replay_status").agg(F.count(F.lit(1)).alias("n_masks"), F.sum("n_deleted").alias("n_deleted"))


_GEOMETRY = """gb as (select view_id, floor(minute / 30)::int as phase_bin, count(*)::bigint as baseline_units from x where ok group by 1, 2), gc as (select g.view_id, g.seed, floor(minute / 30)::int as phase_bin, count(*)::bigint as deleted_units from gone g join x using (view_id, record_id) where ok group by 1, 2, 3),
 geo as (select s.view_id, s.seed, gb.phase_bin, baseline_units, coalesce(deleted_units, 0)::bigint as deleted_units, (baseline_units - coalesce(deleted_units, 0))::bigint as observed_units, coalesce(deleted_units, 0) / baseline_units::double as masked_fraction from (select distinct view_id, seed from gc) s join gb using (view_id) left join gc using (view_id, seed, phase_bin))"""


@query(f"{_M}, {_GEOMETRY} select view_id, seed, phase_bin, baseline_units, deleted_units, observed_units, round(masked_fraction, 6) as masked_fraction from geo")
def op149_mask_geometry(spark: SparkSession, folder: str) -> DataFrame:
    p = Parts(spark, folder)
    return rounded(replays.mask_geometry(p.framed, p.masks, p.gone), 6, "masked_fraction")


@query(f"{_M}, {_GEOMETRY} select view_id, seed, sum(baseline_units)::bigint as critical_baseline_units, sum(observed_units)::bigint as critical_observed_units from geo where phase_bin >= 36 group by 1, 2")
def op113_critical_geometry(spark: SparkSession, folder: str) -> DataFrame:
    p = Parts(spark, folder)
    return replays.critical_geometry(replays.mask_geometry(p.framed, p.masks, p.gone))


@query(f"{_T} select {_NAMES}, k, n_valid, reason, high_support from target")
def op151_matched_targets(spark: SparkSession, folder: str) -> DataFrame:
    return Parts(spark, folder).targets


@query(f"{_M}, e as (select distinct k.seed from mkey k where subject_id is not null and sensor_day_id is not null) select seed, 0::bigint as n_targets from e where seed not in (select seed from mv)")
def op152_missing_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Masks whose keys are known and that have no prepared view, so no target."""
    p = Parts(spark, folder)
    expected = replays.mask_keys(p.rows).where("subject_id is not null and sensor_day_id is not null")
    return replays.missing_targets(p.masks, expected, ["seed"])


_DIGEST = """dg as (select view_id, count(*)::bigint as n_records, sha256(string_agg(row, chr(10) order by row)) as digest from (select view_id, concat_ws('|', record_id::varchar, epoch_us(t)::varchar, case when v is null then '' when isfinite(v) then round(v * 1000000)::decimal(38, 0)::varchar else '' end) as row from x) group by 1)"""


@query(f"with {FRAMED}, {_DIGEST} select view_id, n_records, digest from dg")
def op144_view_digests(spark: SparkSession, folder: str) -> DataFrame:
    p = Parts(spark, folder)
    finite = p.framed.withColumn("v", F.when(F.abs("v") < float("inf"), F.col("v")))
    return replays.view_digests(finite)


@query(f"{_M}, {_DIGEST}, ls as (select seed, string_agg(epoch_us(m0)::varchar || '-' || epoch_us(m1)::varchar, ',' order by epoch_us(m0)::varchar || '-' || epoch_us(m1)::varchar) as spans from sp group by 1) select mv.view_id, mv.seed, sha256(coalesce(digest, '') || '|' || mode || '|' || coalesce(spans, '')) as deletion_digest from mv left join ls using (seed) left join dg using (view_id)")
def op153_deletion_digests(spark: SparkSession, folder: str) -> DataFrame:
    p = Parts(spark, folder)
    finite = p.framed.withColumn("v", F.when(F.abs("v") < float("inf"), F.col("v")))
    return replays.deletion_digests(replays.view_digests(finite), p.masks, p.spans)


_SCATTER = f"""pick as (select view_id, seed, record_id from (select x.view_id, tg.seed, x.record_id, tg.k, row_number() over (partition by tg.view_id, tg.seed order by sha256('{ROOT}|' || tg.seed || '|' || x.record_id::varchar), x.record_id) as r from target tg join x using (view_id) where x.ok and tg.reason = 'eligible') where r <= k)"""
_EDGES = """bs as (select *, case when not ok then null when op in ('binary_load', 'binary_active_minutes', 'activity_load', 'charging_onset') then v else (v > 0)::int::double end as state from x where v is not null),
 bq as (select *, lag(state) over w as q, lag(t) over w as tq, lag(s1) over w as eq from bs window w as (partition by view_id order by t, record_id)),
 bd as (select view_id, t as edge from bq where state is not null and q is not null and state <> q and case when s1 > s0 then s0 <= eq else epoch_us(t) - epoch_us(tq) <= cad * 60000000.0 end),
 near as (select b.view_id, b.record_id, b.ok, min(abs(epoch_us(b.t) - epoch_us(bd.edge))) as distance from bs b join bd using (view_id) group by 1, 2, 3),
 bpick as (select view_id, seed, record_id from (select n.view_id, tg.seed, n.record_id, tg.k, row_number() over (partition by tg.view_id, tg.seed order by n.distance, sha256('gapline|' || tg.seed || '|' || n.record_id::varchar), n.record_id) as r from target tg join near n using (view_id) where n.ok and tg.reason = 'eligible') where r <= k)"""


@query(f"{_T}, {_SCATTER} select view_id, seed, record_id from pick")
def op124_scattered_records(spark: SparkSession, folder: str) -> DataFrame:
    p = Parts(spark, folder)
    return replays.scattered_records(p.framed, p.targets, ROOT)


@query(f"{_T}, {_EDGES} select view_id, seed, record_id from bpick")
def op123_boundary_records(spark: SparkSession, folder: str) -> DataFrame:
    p = Parts(spark, folder)
    return replays.boundary_records(p.framed, p.targets, ROOT)


@query(f"{_T}, {_SCATTER} select pick.view_id, seed, record_id, {_sql_text('mask_start', 'mask_end')} from (select pick.*, case when s1 <= s0 then t else s0 end as mask_start, case when s1 <= s0 then t + interval 1 microsecond else s1 end as mask_end from pick join x using (view_id, record_id)) pick")
def op155_record_intervals(spark: SparkSession, folder: str) -> DataFrame:
    p = Parts(spark, folder)
    return _text(replays.record_intervals(p.framed, replays.scattered_records(p.framed, p.targets, ROOT)), "mask_start", "mask_end")


@query(f"{_T}, {_EDGES}, h as (select b.view_id, b.seed, count(*) as n from bpick b group by 1, 2) select tg.primitive, count(*)::bigint as n_targets, count(case when coalesce(n, 0) <> k then 1 end)::bigint as n_faulty from target tg left join h using (view_id, seed) where reason = 'eligible' group by 1")
def op154_record_mask_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Boundary masks that can't have their number of records: views without a boundary."""
    p = Parts(spark, folder)
    faults = replays.record_mask_faults(replays.boundary_records(p.framed, p.targets, ROOT), p.targets, p.framed)
    return faults.join(p.masks.select("view_id", "seed", "primitive"), ["view_id", "seed"]).groupBy("primitive").agg(F.count(F.lit(1)).alias("n_targets"), F.count_if("faulty").alias("n_faulty"))


@query(f"""with m as (select distinct mask_row_id, seed, {core_queries._REAL_SUBJECT} as sid, {core_queries._REAL_DAY} as did, window_start as w0, window_end as w1, mask_start as s, mask_end as e, case when isnan(mask_duration_minutes) then null else mask_duration_minutes end as d from mask_intervals),
 r as (select *, max(case when s < e then e end) over (partition by seed order by s nulls first, e nulls first, mask_row_id rows between unbounded preceding and 1 preceding) as reach from m),
 f as (select mask_row_id, seed, case when sid is null or did is null then 'missing_key' when s is null or e is null then 'missing_bound' when not s < e then 'empty_interval' when s < w0 or e > w1 then 'outside_window' when abs(d - (epoch_us(e) - epoch_us(s)) / 60000000.0) > 0.01 then 'wrong_duration' when reach > s then 'overlaps_earlier' end as rule from r)
 select mask_row_id, seed, rule from f where rule is not null""")
def op140_mask_faults(spark: SparkSession, folder: str) -> DataFrame:
    return replays.mask_faults(read(spark, folder, "mask_intervals"))


_SCALES = "cen as (select subject_id, primitive, median(value) as c from daily where value is not null group by 1, 2), scl as (select d.subject_id, d.primitive, 1.4826 * median(abs(value - c)) as standardizer from daily d join cen using (subject_id, primitive) where value is not null group by 1, 2)"


def _scales(daily: DataFrame) -> DataFrame:
    known = daily.where("value is not null")
    center = known.groupBy("subject_id", "primitive").agg(F.median("value").alias("c"))
    return known.join(center, ["subject_id", "primitive"]).groupBy("subject_id", "primitive").agg((F.median(F.abs(F.col("value") - F.col("c"))) * 1.4826).alias("standardizer"))


@query(f"{_P}, {_SCALES}, er as (select p.*, coalesce(replay_status = 'finite' and standardizer > 0, false) as retained, standardizer from played p left join scl using (subject_id, primitive)) select {_NAMES}, replay_status, round(case when retained then abs(masked_value - original_value) / standardizer end, 5)::double as error, retained from er")
def op165_standardized_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every mask's error in the participant's own scale of that primitive."""
    p = Parts(spark, folder)
    daily = materialize(p.daily, "daily")
    p.daily = daily
    return rounded(replays.standardized_errors(p.played, _scales(daily)), 5, "error")


@query(f"{_P} select p.view_id, p.subject_id, p.sensor_day_id, p.primitive, p.seed, p.scenario, p.draw, round(case when masked_value is not null and censoring = 'none' then greatest(least(coalesce(coverage, 0), 1), 0) * greatest(least(1 - coalesce(longest_gap_minutes, n_epochs * cad) / (n_epochs * cad)::double, 1), 0) else 0 end, 6)::double as confidence from played p join fr using (view_id)")
def op223_confidence_after(spark: SparkSession, folder: str) -> DataFrame:
    p = Parts(spark, folder)
    return rounded(replays.confidence_after(p.played, primitives.frames(p.views, p.definitions)), 6, "confidence")
