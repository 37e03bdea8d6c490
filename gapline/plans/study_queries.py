"""Queries of the study's own operators over the event stream, with their SQL.

Events stand for the readings of ten participants (see ``sources.study``), with
a cadence of 30 minutes. Each query covers all events; numbers are rounded to six places
in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions.robust import average_ranks, location_scale, rank_auc, spearman, weighted_quantile
from gapline.operators import daily, diff, inference, masks, models, personal, repair
from gapline.sources.study import CADENCE, readings

KEYS = ["subject_id", "day"]
ROOT = "gapline"
DRAWS = 3
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The readings in SQL.
EV = """ev as (select event_id, 'p' || lpad((user_id % 10)::varchar, 2, '0') as subject_id, ts, ts::date as day, (hour(ts) * 60 + minute(ts) + second(ts) / 60.0)::double as minute, event_type, value,
 case when event_type in ('click', 'purchase') then 1.0 else 0.0 end::double as state, case when event_type = 'error' then 1 else 0 end as unknown from events)"""
TOTALS = "tot as (select subject_id, day, count(value) as n, sum(value) as s from ev group by all)"


def query(sql: str | None = None):
    """Register a query, and its SQL, under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def places(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


def six(df: DataFrame, *columns: str) -> DataFrame:
    return places(df, 6, *columns)


def text_day(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns or ("day",)})


D = "strftime(day, '%Y-%m-%d') as day"


# --- scans, days, coverage --------------------------------------------------------------------------------------------


@query(f"with {EV} select subject_id, {D}, count(*)::bigint as n_records, count(distinct event_type)::bigint as n_types, min(minute) as first_minute, max(minute) as last_minute from ev group by subject_id, day".replace("min(minute)", "round(min(minute), 6)").replace("max(minute)", "round(max(minute), 6)"))
def op085_day_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = readings(spark, folder).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("event_type").alias("n_types"), F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))
    return text_day(six(out, "first_minute", "last_minute"))


@query(f"with {EV} select event_id, subject_id, {D} from ev where minute >= 1080 and minute < 1440")
def op031_clip_evening(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(readings(spark, folder).where("minute >= 1080 and minute < 1440").select("event_id", "subject_id", "day"))


@query(f"""with {EV}, e as (select subject_id, min(day) as a, max(day) as b from ev group by 1)
 select subject_id, strftime(day, '%Y-%m-%d') as day, strftime(day + interval 1 day, '%Y-%m-%d') as sleep_date, (day::date - a + 1)::int as day_index from (select subject_id, a, unnest(range(a::timestamp, b::timestamp + interval 1 day, interval 1 day)) as day from e)""")
def op047_calendar_spine(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(daily.day_spine(readings(spark, folder)), "day", "sleep_date")


@query(f"""with {EV}, e as (select subject_id, min(day) as a, max(day) as b from ev group by 1), sp as (select subject_id, unnest(range(a::timestamp, b::timestamp + interval 1 day, interval 1 day))::date as day from e)
 select s.subject_id, strftime(s.day, '%Y-%m-%d') as day, count(v.event_id) > 0 as any_source, count(case when v.unknown = 0 then 1 end) > 0 as any_support from sp s left join ev v on v.subject_id = s.subject_id and v.day = s.day group by 1, 2""")
def op084_observation_flags(spark: SparkSession, folder: str) -> DataFrame:
    ev = readings(spark, folder)
    seen = ev.groupBy(*KEYS).agg(F.lit(True).alias("any_source"), (F.count_if(F.col("unknown") == 0) > 0).alias("any_support"))
    out = daily.day_spine(ev).select(*KEYS).join(seen, KEYS, "left")
    return text_day(out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("any_source", "any_support")}))


@query("""with e as (select event_id, 'p' || lpad((user_id % 10)::varchar, 2, '0') as subject_id, ts from events)
 select event_id, subject_id, strftime((ts - interval 1 microsecond)::date, '%Y-%m-%d') as day, strftime(ts - interval 10 minute, '%H:%M:%S') as support_start, strftime(ts - interval 5 minute, '%H:%M:%S') as effective from e where (ts - interval 10 minute)::date = (ts - interval 1 microsecond)::date""")
def op045_interval_end_alignment(spark: SparkSession, folder: str) -> DataFrame:
    out = daily.interval_end(readings(spark, folder).drop("day"), "ts", 10)
    return text_day(out.select("event_id", "subject_id", "day", F.date_format("support_start", "HH:mm:ss").alias("support_start"), F.date_format("effective", "HH:mm:ss").alias("effective")))


_GAP = """b as (select distinct subject_id, day, floor(minute / 30)::int as b from ev where unknown = 0),
 w as (select *, b - coalesce(lag(b) over (partition by subject_id, day order by b), -1) - 1 as before, row_number() over (partition by subject_id, day order by b desc) as last from b),
 cov as (select subject_id, day, count(*)::int as observed_bins, count(*) / 48.0 as coverage, greatest(max(before), max(case when last = 1 then 48 - b - 1 end)) * 30 as longest_gap from w group by all)"""


@query(f"with {EV}, {_GAP} select subject_id, {D}, observed_bins, round(coverage, 6)::double as coverage, longest_gap::int as longest_gap from cov")
def op070_coverage(spark: SparkSession, folder: str) -> DataFrame:
    out = daily.coverage(readings(spark, folder).where("unknown = 0"), KEYS, "minute", F.lit(True), (0, 1440), CADENCE)
    return text_day(six(out.drop("records"), "coverage"))


# --- daily features ---------------------------------------------------------------------------------------------------

_FEATURES = """select subject_id, day, avg(state) as binary_load, sum(state) * 30.0 as active_minutes, avg(case when unknown = 0 then state end) as activity_load,
 sum(case when value >= 0 then value end) / 60.0 as additive_load, avg(case when value >= 0 then ln(1 + value) end) as exposure_mean from ev group by all"""
_NAMES = ["binary_load", "active_minutes", "activity_load", "additive_load", "exposure_mean"]


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).groupBy(*KEYS).agg(
        daily.binary_load("state").alias("binary_load"), daily.active_minutes("state", 30.0).alias("active_minutes"), daily.activity_load("state", "unknown").alias("activity_load"),
        daily.additive_load("value", 0.0, 1 / 60.0).alias("additive_load"), daily.exposure_mean("value", 0.0).alias("exposure_mean"),
    )


@query(f"with {EV}, f as ({_FEATURES}) select subject_id, {D}, " + ", ".join(f"round({n}, 6) as {n}" for n in _NAMES) + " from f")
def op081_daily_features(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(_features(spark, folder), *_NAMES))


@query(f"with {EV}, f as ({_FEATURES}) " + " union all ".join(f"select subject_id, {D}, '{n}' as primitive, round({n}, 6) as feature_value from f" for n in _NAMES))
def op192_long_features(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(daily.long_features(_features(spark, folder), KEYS, _NAMES), "feature_value"))


@query(f"with {EV}, f as ({_FEATURES}) select subject_id, {D}, " + ", ".join(f"round({n}, 6) as {n}" for n in _NAMES) + " from f")
def op201_wide_features(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(daily.wide_features(daily.long_features(_features(spark, folder), KEYS, _NAMES), KEYS, _NAMES), *_NAMES))


_BUDGET = ((0, 720), (720, 1080), (1080, 1440))


@query(f"with {EV} select subject_id, {D}, " + ", ".join(f"round(sum(case when minute >= {a} and minute < {b} then value end), 6) as load_{a // 60}_{b // 60}" for a, b in _BUDGET) + " from ev group by subject_id, day")
def op082_fixed_budget(spark: SparkSession, folder: str) -> DataFrame:
    parts = [F.round(F.sum(F.when((F.col("minute") >= a) & (F.col("minute") < b), F.col("value"))), 6).alias(f"load_{a // 60}_{b // 60}") for a, b in _BUDGET]
    return text_day(readings(spark, folder).groupBy(*KEYS).agg(*parts))


@query(f"""with {EV}, e as (select *, sum(value) over (partition by subject_id, day order by minute range unbounded preceding) as upto, sum(value) over (partition by subject_id, day) as total from ev where minute >= 1080 and value > 0)
 select subject_id, {D}, round(min(minute), 6) as evening_p90 from e where upto >= 0.9 * total - 1e-9 group by subject_id, day""")
def op076_evening_p90(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(daily.evening_p90(readings(spark, folder), KEYS, "minute", "value"), "evening_p90"))


@query(f"""with {EV}, e as (select *, sum(value) over (partition by event_type order by minute range unbounded preceding) as upto, sum(value) over (partition by event_type) as total from ev where value > 0)
 select event_type, round(min(minute), 6) as median_minute from e where upto >= 0.5 * total - 1e-9 group by event_type""")
def op069_weighted_quantile(spark: SparkSession, folder: str) -> DataFrame:
    return six(weighted_quantile(readings(spark, folder), ["event_type"], "minute", "value", 0.5, "median_minute"), "median_minute")


_BINS = "g as (select distinct subject_id, day from ev where minute >= 1080), sp as (select subject_id, day, unnest(range(0, 12))::int as b from g)"


@query(f"""with {EV}, {_BINS}, c as (select s.subject_id, s.day, s.b, case when count(case when value >= 0 then 1 end) >= 1 then case when avg(case when value >= 0 then (value <= 40)::int end) >= 0.75 then 1 else 0 end end as c
  from sp s left join ev v on v.subject_id = s.subject_id and v.day = s.day and v.minute >= 1080 and floor((v.minute - 1080) / 30) = s.b group by 1, 2, 3),
 x as (select subject_id, day, coalesce(min(case when c = 1 then b end), 12) as f, coalesce(min(case when c is null then b end), 12) as m, max(case when c is not null then b end) as last_seen from c group by 1, 2)
 select subject_id, {D}, case when f = 0 or m = 0 then 'left' when f < 12 and m < f then 'gap' when f < 12 then 'none' when m = 12 then 'none' when coalesce(last_seen, -1) < m then 'right' else 'gap' end as censoring,
  case when f < 12 and f > 0 and m > f then 1080 + 30 * f end::int as onset from x""")
def op077_low_light_onset(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(daily.low_light_onset(readings(spark, folder), KEYS, "minute", "value", 40.0, 1, 0.75))


@query(f"""with {EV}, {_BINS}, c as (select s.subject_id, s.day, s.b, max(v.state)::int as c from sp s left join ev v on v.subject_id = s.subject_id and v.day = s.day and v.minute >= 1080 and floor((v.minute - 1080) / 30) = s.b group by 1, 2, 3),
 l as (select *, lag(c) over w as p, lead(c) over w as n from c window w as (partition by subject_id, day order by b)),
 m as (select subject_id, day, coalesce(min(case when c is null then b end), 12) as m, max(case when c is not null then b end) as last_seen, max(case when b = 0 then c end) as c0, max(case when b = 11 then c end) as c11 from l group by 1, 2),
 x as (select m.*, coalesce((select min(b) from l where l.subject_id = m.subject_id and l.day = m.day and l.p = 0 and l.c = 1 and l.n = 1 and l.b + 2 <= m.m), 12) as f from m)
 select subject_id, {D}, case when m > 0 and c0 = 1 then 'left' when f < 12 then 'none' when m = 0 then 'left' when m < 12 and coalesce(last_seen, -1) < m then 'right' when m < 12 then 'gap' when c11 = 1 then 'right' else 'none' end as censoring,
  case when f < 12 and not (m > 0 and coalesce(c0, 0) = 1) then 1080 + 30 * f end::int as onset from x""")
def op079_charging_onset(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(daily.charging_onset(readings(spark, folder), KEYS, "minute", "state", 2))


@query(f"""with {EV}, e as (select * from ev where minute >= 1080), s as (select subject_id, day, count(distinct case when minute < 1200 then floor(minute) end) as e, count(distinct case when minute >= 1320 then floor(minute) end) as l, avg(case when minute >= 1320 then value end) - avg(case when minute < 1200 then value end) as delta from e group by all),
 h as (select subject_id, day, floor(minute / 30) * 0.5 as h, median(value) as m from e group by all), r as (select subject_id, day, case when count(*) >= 2 then regr_slope(m, h) end as slope from h group by all)
 select subject_id, {D}, round(case when e >= 2 and l >= 2 then delta end, 6) as delta, round(case when e >= 2 and l >= 2 then slope end, 6) as slope from s join r using (subject_id, day)""")
def op078_settling(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(daily.settling(readings(spark, folder), KEYS, "minute", "value", 2), "delta", "slope"))


@query("select l_partkey, l_suppkey, l_linenumber as line, n as n_rows from (select l_partkey, l_suppkey, min(l_linenumber) as l_linenumber, max(l_linenumber) as m, count(*)::bigint as n from lineitem group by 1, 2) where l_linenumber = m".replace("l_linenumber as line, n as", "l_linenumber, n as"))
def op094_drop_conflicting(spark: SparkSession, folder: str) -> DataFrame:
    from gapline.sources.tables import read

    return daily.drop_conflicting(read(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber"), ["l_partkey", "l_suppkey"], "l_linenumber")


# --- masks and replays ------------------------------------------------------------------------------------------------


def _hash(expression: str) -> str:
    return f"('0x' || substr({expression}, 1, 15))::bigint"


_SCENARIOS = ", ".join(f"('{n}', {int(1440 * s) if s else (m if m else 'null::int')})" for n, (s, m) in masks.SCENARIOS.items())
CELLS = "cells as (select distinct subject_id, day from ev)"
_SEED = f"sha256('{ROOT}|' || scenario || '|' || draw::varchar || '|' || subject_id || '|' || strftime(day, '%Y-%m-%d'))"
MASKS = f"""sc(scenario, minutes) as (values {_SCENARIOS}), grid as (select subject_id, day, scenario, minutes, unnest(range(0, {DRAWS}))::int as draw from cells, sc), seeded as (select *, {_SEED} as seed from grid),
 mask as (select subject_id, day, scenario, draw, seed, (case when minutes is null then 1260 else {_hash('seed')} % (1440 - minutes + 1) end)::int as mask_start, (case when minutes is null then 1440 else {_hash('seed')} % (1440 - minutes + 1) + minutes end)::int as mask_end from seeded)"""


def _masks(spark: SparkSession, folder: str, scenarios: dict | None = None) -> DataFrame:
    return masks.block_masks(readings(spark, folder).select(*KEYS).distinct(), KEYS, DRAWS, ROOT, scenarios=scenarios or masks.SCENARIOS)


_HURT = "gone as (select m.scenario, m.draw, e.* from mask m join ev e on e.subject_id = m.subject_id and e.day = m.day and e.minute >= m.mask_start and e.minute < m.mask_end)"
_REPLAY = f"""lost as (select subject_id, day, scenario, draw, count(value) as k, sum(value) as d from gone group by all),
 played as (select l.subject_id, l.day, l.scenario, l.draw, k as n_deleted, s / n as original_mean, case when n > k then (s - d) / (n - k) end as retained_mean, s as original_sum, case when n > k then s - d end as retained_sum from lost l join tot using (subject_id, day))"""
MASK = ["scenario", "draw"]


@query(f"with {EV}, {CELLS}, {MASKS} select subject_id, {D}, scenario, draw, seed, mask_start, mask_end from mask")
def op138_block_masks(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(_masks(spark, folder))


@query(f"with {EV}, t as (select distinct subject_id, day, minute from ev), l as (select *, lead(minute) over (partition by subject_id, day order by minute) as gap_end from t) select subject_id, {D}, round(minute, 6) as gap_start, round(gap_end, 6) as gap_end from l where gap_end - minute > 30")
def op119_internal_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(masks.internal_gaps(readings(spark, folder), KEYS, "minute", 30.0), "gap_start", "gap_end"))


_DONORS = f"""num as (select subject_id, day, row_number() over (partition by subject_id order by day) - 1 as i, count(*) over (partition by subject_id) as n from cells), dr as (select *, unnest(range(0, {DRAWS}))::int as draw from num where n > 1),
 pk as (select *, (i + 1 + {_hash(f"sha256('{ROOT}|empirical_gap|' || draw::varchar || '|' || subject_id || '|' || strftime(day, '%Y-%m-%d'))")} % (n - 1)) % n as j from dr), donor as (select pk.subject_id, pk.day, pk.draw, num.day as donor_day from pk join num on num.subject_id = pk.subject_id and num.i = pk.j)"""


@query(f"with {EV}, {CELLS}, {_DONORS} select subject_id, {D}, draw, strftime(donor_day, '%Y-%m-%d') as donor_day from donor")
def op141_empirical_donors(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(masks.donor_days(readings(spark, folder), "subject_id", "day", DRAWS, ROOT), "day", "donor_day")


@query(f"""with {EV}, {CELLS}, {_DONORS}, t as (select distinct subject_id, day, minute from ev), l as (select *, lead(minute) over (partition by subject_id, day order by minute) as gap_end from t), g as (select * from l where gap_end - minute > 30)
 select d.subject_id, strftime(d.day, '%Y-%m-%d') as day, d.draw, count(*)::bigint as n_deleted, round(sum(e.value), 6) as deleted_sum from donor d join g on g.subject_id = d.subject_id and g.day = d.donor_day join ev e on e.subject_id = d.subject_id and e.day = d.day and e.minute >= g.minute and e.minute < g.gap_end group by 1, 2, 3""")
def op138_empirical_gap_masks(spark: SparkSession, folder: str) -> DataFrame:
    ev = readings(spark, folder)
    gaps = masks.internal_gaps(ev, KEYS, "minute", 30.0).withColumnsRenamed({"day": "donor_day", "gap_start": "mask_start", "gap_end": "mask_end"})
    borrowed = masks.donor_days(ev, "subject_id", "day", DRAWS, ROOT).join(gaps, ["subject_id", "donor_day"])
    gone = masks.deleted(ev, borrowed, KEYS, "minute", ["draw"])
    return text_day(gone.groupBy(*KEYS, "draw").agg(F.count(F.lit(1)).alias("n_deleted"), F.round(F.sum("value"), 6).alias("deleted_sum")))


@query(f"with {EV}, {CELLS}, {TOTALS}, {MASKS}, {_HURT}, {_REPLAY} select subject_id, {D}, scenario, draw, n_deleted::bigint as n_deleted, round(original_mean, 9) as original_mean, round(retained_mean, 9) as retained_mean, round(original_sum, 9) as original_sum, round(retained_sum, 9) as retained_sum from played")
def op147_replay(spark: SparkSession, folder: str) -> DataFrame:
    ev = readings(spark, folder)
    out = masks.replay(ev, masks.deleted(ev, _masks(spark, folder), KEYS, "minute", MASK), KEYS, MASK, "event_id", "value")
    return text_day(places(out, 9, "original_mean", "retained_mean", "original_sum", "retained_sum"))


@query(f"with {EV}, {CELLS}, {MASKS} select m.subject_id, strftime(m.day, '%Y-%m-%d') as day, scenario, draw, count(*)::bigint as n_overlapping from mask m join ev e on e.subject_id = m.subject_id and e.day = m.day and e.minute - 10 < m.mask_end and e.minute > m.mask_start group by 1, 2, 3, 4")
def op142_support_overlap(spark: SparkSession, folder: str) -> DataFrame:
    ev = readings(spark, folder).withColumn("begin", F.col("minute") - 10)
    return text_day(masks.deleted_supports(ev, _masks(spark, folder), KEYS, "begin", "minute", MASK).groupBy(*KEYS, *MASK).agg(F.count(F.lit(1)).alias("n_overlapping")))


_TWENTY = {"contiguous_20pct": (0.2, None)}
_TARGET = "target as (select subject_id, day, draw, count(*)::int as k from gone where scenario = 'contiguous_20pct' and unknown = 0 group by all)"
_SCATTER = f"""picked as (select t.draw, t.k, e.*, row_number() over (partition by t.subject_id, t.day, t.draw order by sha256('{ROOT}|' || t.draw::varchar || '|' || e.event_id::varchar), e.event_id) as r from target t join ev e on e.subject_id = t.subject_id and e.day = t.day where e.unknown = 0),
 spread as (select * from picked where r <= k)"""


def _targets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    valid = readings(spark, folder).where("unknown = 0")
    gone = masks.deleted(valid, _masks(spark, folder, _TWENTY), KEYS, "minute", MASK)
    return valid, gone, gone.groupBy(*KEYS, "draw").agg(F.count(F.lit(1)).cast("int").alias("k"))


@query(f"with {EV}, {CELLS}, {MASKS}, {_HURT}, {_TARGET} select subject_id, {D}, draw, k from target")
def op151_matched_target(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(_targets(spark, folder)[2])


@query(f"with {EV}, {CELLS}, {MASKS}, {_HURT}, {_TARGET}, {_SCATTER} select subject_id, {D}, draw, event_id from spread")
def op124_scattered_mask(spark: SparkSession, folder: str) -> DataFrame:
    valid, _, target = _targets(spark, folder)
    return text_day(masks.scattered(valid, target, KEYS, ["draw"], "event_id", "k", ROOT).select(*KEYS, "draw", "event_id"))


_BOUND = "bl as (select *, lag(state) over (partition by subject_id, day order by minute, event_id) as p from ev), bd as (select subject_id, day, minute as boundary from bl where p <> state)"


@query(f"with {EV}, {_BOUND} select subject_id, {D}, round(boundary, 6) as boundary from bd")
def op121_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(masks.boundaries(readings(spark, folder), KEYS, "minute", "state"), "boundary"))


@query(f"with {EV}, {_BOUND}, ds as (select e.event_id, min(abs(e.minute - b.boundary)) as distance from ev e left join bd b on b.subject_id = e.subject_id and b.day = e.day group by 1) select event_id, round(distance, 6) as distance from ds")
def op123_boundary_distance(spark: SparkSession, folder: str) -> DataFrame:
    return six(masks.near_boundaries(readings(spark, folder), KEYS, "minute", "state").select("event_id", "distance"), "distance")


_MEDIAN = "med as (select subject_id, median(m) as c from daymean group by 1)"
_SCALES = f"""daymean as (select subject_id, day, s / n as m from tot), {_MEDIAN}, own as (select d.subject_id, 1.4826 * median(abs(m - c)) as own_scale from daymean d join med using (subject_id) group by 1),
 pop as (select 1.4826 * median(abs(m - (select median(m) from daymean))) as population_scale from daymean), std as (select subject_id, own_scale, population_scale, greatest(own_scale, 0.1 * population_scale) as standardizer from own, pop)"""


def _day_means(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).groupBy(*KEYS).agg(F.avg("value").alias("m"))


@query(f"with {EV}, {TOTALS}, {_SCALES} select subject_id, round(own_scale, 6) as own_scale, round(population_scale, 6) as population_scale, round(standardizer, 6) as standardizer from std")
def op218_standardizers(spark: SparkSession, folder: str) -> DataFrame:
    return six(personal.standardizers(_day_means(spark, folder), "subject_id", "m"), "own_scale", "population_scale", "standardizer")


_STRESS = f"""both_ as (select subject_id, day, draw, 'contiguous' as geometry, value from gone where scenario = 'contiguous_20pct' and unknown = 0 union all select subject_id, day, draw, 'scattered', value from spread),
 vt as (select subject_id, day, count(*) as n, sum(value) as s from ev where unknown = 0 group by all),
 err as (select b.subject_id, b.day, b.draw, b.geometry, case when any_value(n) > count(*) then abs((any_value(s) - sum(b.value)) / (any_value(n) - count(*)) - any_value(s) / any_value(n)) / any_value(standardizer) end as e from both_ b join vt using (subject_id, day) join std using (subject_id) group by 1, 2, 3, 4),
 delta as (select subject_id, day, draw, max(case when geometry = 'contiguous' then e end) - max(case when geometry = 'scattered' then e end) as delta from err group by 1, 2, 3)"""


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    valid, gone, target = _targets(spark, folder)
    spread = masks.scattered(valid, target, KEYS, ["draw"], "event_id", "k", ROOT)
    both = gone.select(*KEYS, "draw", F.lit("contiguous").alias("geometry"), "event_id", "value").unionByName(spread.select(*KEYS, "draw", F.lit("scattered").alias("geometry"), "event_id", "value"))
    played = masks.replay(valid, both, KEYS, ["draw", "geometry"], "event_id", "value")
    scale = personal.standardizers(_day_means(spark, folder), "subject_id", "m").select("subject_id", "standardizer")
    errors = played.join(scale, "subject_id").withColumn("e", F.abs(F.col("retained_mean") - F.col("original_mean")) / F.col("standardizer"))
    wide = errors.groupBy(*KEYS, "draw").pivot("geometry", ["contiguous", "scattered"]).agg(F.max("e"))
    return wide.select(*KEYS, "draw", (F.col("contiguous") - F.col("scattered")).alias("delta"))


@query(f"with {EV}, {CELLS}, {TOTALS}, {MASKS}, {_HURT}, {_TARGET}, {_SCATTER}, {_SCALES}, {_STRESS} select subject_id, {D}, draw, round(delta, 6) as delta from delta")
def op156_stress_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(_deltas(spark, folder), "delta"))


@query(f"with {EV}, {CELLS}, {TOTALS}, {MASKS}, {_HURT}, {_TARGET}, {_SCATTER}, {_SCALES}, {_STRESS} select subject_id, count(delta)::bigint as n_pairs, round(median(delta), 6) as median_delta from delta where delta is not null group by 1")
def op054_geometry_effect(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: at equal loss, how much more a block distorts a day's mean than scattered deletion does, by participant."""
    return six(_deltas(spark, folder).where("delta is not null").groupBy("subject_id").agg(F.count("delta").alias("n_pairs"), F.median("delta").alias("median_delta")), "median_delta")


@query(f"""with {EV}, {CELLS}, {TOTALS}, {MASKS}, {_HURT}, {_REPLAY}, {_SCALES}, p as (select subject_id, scenario, median(abs(retained_mean - original_mean) / standardizer) as m, count(*) as n from played join std using (subject_id) where retained_mean is not null and scenario like 'contiguous%' group by 1, 2)
 select scenario, count(*)::bigint as n_participants, round(median(m), 6) as median_error from p group by 1""")
def op097_dose_response(spark: SparkSession, folder: str) -> DataFrame:
    ev = readings(spark, folder)
    doses = {k: v for k, v in masks.SCENARIOS.items() if k.startswith("contiguous")}
    played = masks.replay(ev, masks.deleted(ev, _masks(spark, folder, doses), KEYS, "minute", MASK), KEYS, MASK, "event_id", "value").where("retained_mean is not null")
    scale = personal.standardizers(_day_means(spark, folder), "subject_id", "m").select("subject_id", "standardizer")
    own = played.join(scale, "subject_id").groupBy("subject_id", "scenario").agg(F.median(F.abs(F.col("retained_mean") - F.col("original_mean")) / F.col("standardizer")).alias("m"))
    return six(own.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_participants"), F.median("m").alias("median_error")), "median_error")


# --- reconstruction ---------------------------------------------------------------------------------------------------

_GONE = f"""t20 as (select e.*, m.mask_start is not null as gone from ev e left join mask m on m.subject_id = e.subject_id and m.day = e.day and m.scenario = 'contiguous_20pct' and m.draw = 0 and e.minute >= m.mask_start and e.minute < m.mask_end),
 kept as (select *, case when not gone then value end as kv from t20), st as (select subject_id, day, avg(kv) as mean, median(kv) as med, case when avg(case when not gone then state end) > 0.5 then 1.0 else 0.0 end as vote, count(kv) as n from kept group by all)"""
_PRE = f"with {EV}, {CELLS}, {MASKS}, {_GONE}"


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    ev = readings(spark, folder)
    one = _masks(spark, folder, _TWENTY).where("draw = 0").select(*KEYS, "mask_start", "mask_end")
    inside = F.coalesce((F.col("minute") >= F.col("mask_start")) & (F.col("minute") < F.col("mask_end")), F.lit(False))
    return ev.join(one, KEYS, "left").withColumn("gone", inside).drop("mask_start", "mask_end")


def _repaired(spark: SparkSession, folder: str, method: str, cap: float | None = None) -> DataFrame:
    out = repair.repaired(_marked(spark, folder), KEYS, "minute", "value", "gone", method, cap)
    return six(out.where("gone").select("event_id", "repaired", "repair_kind"), "repaired")


@query(f"{_PRE} select event_id, round(case when n > 0 then mean end, 6) as repaired, case when n > 0 then 'filled' else 'unresolved' end as repair_kind from kept join st using (subject_id, day) where gone")
def op168_repair_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder, "mean")


@query(f"{_PRE} select event_id, round(case when n > 0 then med end, 6) as repaired, case when n > 0 then 'filled' else 'unresolved' end as repair_kind from kept join st using (subject_id, day) where gone")
def op169_repair_median(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder, "median")


_NEXT = """nx as (select *, last_value(case when kv is not null then minute end ignore nulls) over u as bt, last_value(kv ignore nulls) over u as bv, last_value(case when kv is not null then minute end ignore nulls) over d as nt, last_value(kv ignore nulls) over d as av from kept
 window u as (partition by subject_id, day order by minute, event_id rows between unbounded preceding and 1 preceding), d as (partition by subject_id, day order by minute desc, event_id desc rows between unbounded preceding and 1 preceding))"""


@query(f"{_PRE}, {_NEXT}, r as (select nx.*, mean, n, case when minute - bt <= 90 then bv end as own from nx join st using (subject_id, day) where gone) select event_id, round(coalesce(own, case when n > 0 then mean end), 6) as repaired, case when own is not null then 'filled' when n > 0 then 'fallback' else 'unresolved' end as repair_kind from r")
def op169_repair_locf(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder, "locf", 90.0)


@query(f"{_PRE}, {_NEXT}, r as (select nx.*, mean, n, case when nt > bt then bv + (minute - bt) / (nt - bt) * (av - bv) end as own from nx join st using (subject_id, day) where gone) select event_id, round(coalesce(own, case when n > 0 then mean end), 6) as repaired, case when own is not null then 'filled' when n > 0 then 'fallback' else 'unresolved' end as repair_kind from r")
def op169_repair_linear(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder, "linear")


@query(f"{_PRE}, v as (select subject_id, day, count(case when not gone then 1 end) as n from kept group by all) select event_id, case when v.n > 0 then vote end::double as repaired from kept join st using (subject_id, day) join v using (subject_id, day) where gone")
def op168_repair_majority(spark: SparkSession, folder: str) -> DataFrame:
    out = repair.repaired(_marked(spark, folder), KEYS, "minute", "state", "gone", "mean", binary=True)
    return out.where("gone").select("event_id", "repaired")


_PROFILE = "pf as (select subject_id, day, floor(minute / 30)::int as slot, avg(value) as slot_mean, median(value) as slot_median, count(value)::bigint as slot_n from ev where value is not null group by all)"


@query(f"with {EV}, {_PROFILE} select subject_id, {D}, slot, round(slot_mean, 6) as slot_mean, round(slot_median, 6) as slot_median, slot_n from pf")
def op090_day_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(repair.day_profiles(readings(spark, folder), "subject_id", "day", "minute", "value"), "slot_mean", "slot_median"))


@query(f"with {EV}, {_PROFILE}, c as (select distinct subject_id, day from pf) select c.subject_id, strftime(c.day, '%Y-%m-%d') as day, slot, round(avg(slot_mean), 9) as donor_mean, count(*)::bigint as donor_days from c join pf on pf.subject_id = c.subject_id and pf.day <> c.day group by 1, 2, 3 having count(*) >= 2")
def op171_other_days(spark: SparkSession, folder: str) -> DataFrame:
    profiles = repair.day_profiles(readings(spark, folder), "subject_id", "day", "minute", "value")
    return text_day(places(repair.other_days(profiles, "subject_id", "day"), 9, "donor_mean"))


@query(f"with {EV}, {_PROFILE} select c.subject_id, strftime(c.day, '%Y-%m-%d') as day, c.slot, round(sum(pow(2.0, -(c.day - p.day) / 7.0) * p.slot_mean) / sum(pow(2.0, -(c.day - p.day) / 7.0)), 6) as recent_mean, count(*)::bigint as past_days from pf c join pf p on p.subject_id = c.subject_id and p.slot = c.slot and p.day < c.day group by 1, 2, 3 having count(*) >= 2")
def op172_recent_days(spark: SparkSession, folder: str) -> DataFrame:
    profiles = repair.day_profiles(readings(spark, folder), "subject_id", "day", "minute", "value")
    return text_day(six(repair.recent_days(profiles, "subject_id", "day"), "recent_mean"))


@query()
def op172_repair_all(spark: SparkSession, folder: str) -> DataFrame:
    rows = _marked(spark, folder)
    one = repair.cross_day(rows, "subject_id", "day", "minute", "value", "gone", cadence=CADENCE).withColumn("primitive", F.lit("value"))
    two = repair.cross_day(rows, "subject_id", "day", "minute", "state", "gone", binary=True, cadence=CADENCE).withColumn("primitive", F.lit("state"))
    return six(one.unionByName(two), "repaired")


_GAIN = f"""{_NEXT}, ft as (select nx.subject_id, nx.day, avg(value) as truth, avg(case when gone then case when n > 0 then mean end else value end) as a, avg(case when gone then coalesce(case when nt > bt then bv + (minute - bt) / (nt - bt) * (av - bv) end, case when n > 0 then mean end) else value end) as b, any_value(mean) as m0 from nx join st using (subject_id, day) group by 1, 2),
 gn as (select subject_id, day, case when m0 is not null and b is not null then abs(m0 - truth) - abs(b - truth) end as gain_linear from ft)"""


def _gains(spark: SparkSession, folder: str) -> DataFrame:
    rows = repair.repaired(_marked(spark, folder), KEYS, "minute", "value", "gone", "linear")
    day = rows.groupBy(*KEYS).agg(F.avg("value").alias("truth"), F.avg("repaired").alias("b"), F.avg(F.when(~F.col("gone"), F.col("value"))).alias("m0"))
    wide = day.select(*KEYS, F.abs(F.col("m0") - F.col("truth")).alias("M0"), F.abs(F.col("b") - F.col("truth")).alias("linear"))
    return inference.common_gains(wide, KEYS, "M0", ["linear"])


@query(f"{_PRE}, {_GAIN} select subject_id, {D}, round(gain_linear, 6) + 0.0 as gain_linear from gn")
def op271_common_gains(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(_gains(spark, folder), "gain_linear").withColumn("gain_linear", F.col("gain_linear") + 0.0))


@query(f"{_PRE}, {_GAIN}, p as (select subject_id, median(gain_linear) as m from gn where gain_linear is not null group by 1) select count(*)::bigint as n_participants, round(median(m), 6) as median, count(case when m > 0 then 1 end)::bigint as n_positive from p")
def op269_participant_summary(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.participant_summary(_gains(spark, folder), "subject_id", "gain_linear"), "median")


# --- personalization --------------------------------------------------------------------------------------------------


@query(f"with {EV}, {TOTALS}, {_SCALES} select d.subject_id, round(any_value(c), 6) as center, round(1.4826 * median(abs(m - c)), 6) as scale, count(*)::double as n_eff, count(*)::bigint as n_rows from daymean d join med using (subject_id) group by 1")
def op190_location_scale(spark: SparkSession, folder: str) -> DataFrame:
    return six(location_scale(_day_means(spark, folder).withColumn("one", F.lit(1.0)), ["subject_id"], "m", "one"), "center", "scale")


_OTHERS = "ot as (select a.subject_id, count(b.value)::bigint as others, avg(b.value) as others_mean, stddev_pop(b.value) as others_sd from (select distinct subject_id from ev) a join ev b on b.subject_id <> a.subject_id group by 1)"


@query(f"with {EV}, {_OTHERS} select subject_id, others, round(others_mean, 6) as others_mean, round(others_sd, 6) as others_sd from ot")
def op199_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    return six(personal.leave_one_out_mean_scale(readings(spark, folder), "subject_id", "value"), "others_mean", "others_sd")


_SHRUNK = f"""ow as (select subject_id, avg(m) as pc, stddev_pop(m) as ps, count(*) as n from daymean group by 1), oth as (select a.subject_id, avg(b.m) as oc, stddev_pop(b.m) as os from (select distinct subject_id from daymean) a join daymean b on b.subject_id <> a.subject_id group by 1),
 sh as (select subject_id, n / (n + 7.0) * pc + (1 - n / (n + 7.0)) * oc as center, greatest(case when n >= 3 then n / (n + 7.0) * ps + (1 - n / (n + 7.0)) * os else os end, 0.1 * os) as scale from ow join oth using (subject_id))"""
_DAYS = f"with {EV}, {TOTALS}, daymean as (select subject_id, day, s / n as m from tot)"


def _baselines(spark: SparkSession, folder: str) -> DataFrame:
    means = _day_means(spark, folder)
    own = means.groupBy("subject_id").agg(F.avg("m").alias("pc"), F.stddev_pop("m").alias("ps"), F.count("m").alias("n"))
    others = personal.leave_one_out_mean_scale(means, "subject_id", "m")
    center, scale = personal.shrunk(F.col("pc"), F.col("ps"), F.col("others_mean"), F.col("others_sd"), F.col("n"))
    return own.join(others, "subject_id").select("subject_id", center.alias("center"), scale.alias("scale"))


@query(f"{_DAYS}, {_SHRUNK} select subject_id, round(center, 6) as center, round(scale, 6) as scale from sh")
def op191_shrunk_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return six(_baselines(spark, folder), "center", "scale")


@query(f"{_DAYS}, {_SHRUNK} select subject_id, {D}, round(greatest(least((m - center) / scale, 5), -5), 6) as z from daymean join sh using (subject_id)")
def op203_self_scores(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(personal.scores(_day_means(spark, folder), _baselines(spark, folder), ["subject_id"], "m").drop("m"), "z"))


_CONF = "cf as (select subject_id, day, least(coverage, 1) * (1 - longest_gap / 1440.0) as confidence from cov)"


def _confident(spark: SparkSession, folder: str) -> DataFrame:
    cov = daily.coverage(readings(spark, folder).where("unknown = 0"), KEYS, "minute", F.lit(True), (0, 1440), CADENCE)
    return cov.select(*KEYS, personal.confidence(F.col("coverage"), F.col("longest_gap"), 1440.0, F.lit(True), F.lit(True)).alias("confidence"), "coverage", "longest_gap")


@query(f"with {EV}, {_GAP}, {_CONF} select subject_id, {D}, round(confidence, 6)::double as confidence from cf")
def op192_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(_confident(spark, folder).select(*KEYS, "confidence"), "confidence"))


@query(f"with {EV}, {_GAP}, {_CONF}, f as ({_FEATURES}) select f.subject_id, strftime(f.day, '%Y-%m-%d') as day, round((binary_load * confidence + exposure_mean * coverage) / (confidence + coverage), 6) as engagement, round(least((confidence + coverage) / 2, 1), 6)::double as engagement_confidence from f join cf using (subject_id, day) join cov using (subject_id, day) where confidence > 0 and coverage > 0")
def op193_composed_indicator(spark: SparkSession, folder: str) -> DataFrame:
    both = _features(spark, folder).join(_confident(spark, folder), KEYS).where("confidence > 0 and coverage > 0")
    mean, sure = personal.composed_mean([(F.col("binary_load"), F.col("confidence")), (F.col("exposure_mean"), F.col("coverage"))], 2)
    return text_day(six(both.select(*KEYS, mean.alias("engagement"), sure.alias("engagement_confidence")), "engagement", "engagement_confidence"))


@query(f"with {EV}, {_GAP}, r as (select *, row_number() over (partition by subject_id order by coverage desc, longest_gap, day) as rank from cov) select subject_id, {D}, rank::int as rank from r where rank <= 10")
def op114_selected_days(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(personal.selected_days(_confident(spark, folder), ["subject_id"], 10).select(*KEYS, "rank"))


@query(f"{_DAYS}, {_SHRUNK}, l as (select subject_id, avg(m) as lc, stddev_pop(m) as ls from daymean where day >= date '2024-01-22' group by 1) select subject_id, round(0.5 * abs(pc - lc) / os + 0.5 * abs(ln(ps / ls)), 6) as transfer_error from ow join oth using (subject_id) join l using (subject_id)")
def op222_transfer_error(spark: SparkSession, folder: str) -> DataFrame:
    means = _day_means(spark, folder)
    own = means.groupBy("subject_id").agg(F.avg("m").alias("pc"), F.stddev_pop("m").alias("ps"))
    later = means.where("day >= date '2024-01-22'").groupBy("subject_id").agg(F.avg("m").alias("lc"), F.stddev_pop("m").alias("ls"))
    both = own.join(later, "subject_id").join(personal.leave_one_out_mean_scale(means, "subject_id", "m"), "subject_id")
    return six(both.select("subject_id", personal.transfer_error(F.col("pc"), F.col("ps"), F.col("lc"), F.col("ls"), F.col("others_sd")).alias("transfer_error")), "transfer_error")


# --- inference --------------------------------------------------------------------------------------------------------

_PAIR = f"{_DAYS}, f as ({_FEATURES}), pr as (select subject_id, day, binary_load as x, exposure_mean as y from f)"
_SUMS = "sm as (select subject_id, count(*) as n, regr_sxx(y, x) as a, regr_syy(y, x) as b, regr_sxy(y, x) as c from pr group by 1 having count(*) >= 2)"


def _pair(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).select(*KEYS, F.col("binary_load").alias("x"), F.col("exposure_mean").alias("y"))


@query(f"{_PAIR}, {_SUMS} select sum(n)::bigint as n_pairs, count(*)::bigint as n_participants, round(sum(c) / sqrt(sum(a) * sum(b)), 6) as r from sm")
def op227_repeated_measures_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.repeated_measures_correlation(_pair(spark, folder), "subject_id", "x", "y"), "r")


@query(f"{_PAIR}, {_SUMS} select s.subject_id, round(sum(o.c) / sqrt(sum(o.a) * sum(o.b)), 6) as r_without from sm s join sm o on o.subject_id <> s.subject_id group by 1")
def op231_leave_one_out_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.leave_one_out_correlations(_pair(spark, folder), "subject_id", "x", "y"), "r_without")


_RANK = "rk as (select *, rank() over (partition by subject_id order by x) + (count(*) over (partition by subject_id, x) - 1) / 2.0 as rx, rank() over (partition by subject_id order by y) + (count(*) over (partition by subject_id, y) - 1) / 2.0 as ry from pr)"


@query(f"{_PAIR}, {_RANK} select subject_id, {D}, rx::double as rank_x from rk")
def op115_average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(average_ranks(_pair(spark, folder), ["subject_id"], "x", "rank_x").select(*KEYS, "rank_x"))


@query(f"{_PAIR}, {_RANK} select subject_id, count(*)::bigint as n_pairs, round(corr(rx, ry), 6) as rho from rk group by 1")
def op116_spearman(spark: SparkSession, folder: str) -> DataFrame:
    return six(spearman(_pair(spark, folder), ["subject_id"], "x", "y"), "rho")


@query(f"with {EV}, r as (select *, rank() over (partition by subject_id order by value) + (count(*) over (partition by subject_id, value) - 1) / 2.0 as r from ev) select subject_id, round((sum(case when state = 1 then r end) - count(case when state = 1 then 1 end) * (count(case when state = 1 then 1 end) + 1) / 2.0) / (count(case when state = 1 then 1 end) * count(case when state = 0 then 1 end)), 6)::double as auc from r group by 1")
def op117_rank_auc(spark: SparkSession, folder: str) -> DataFrame:
    return six(rank_auc(readings(spark, folder), ["subject_id"], "state", "value"), "auc")


_SHIFTS = """nm as (select *, row_number() over (partition by subject_id order by day) - 1 as i, count(*) over (partition by subject_id) as n from pr), sf as (select a.*, unnest(range(0, 21))::int as shift from nm a),
 jn as (select s.shift, s.subject_id, s.x, b.y from sf s join nm b on b.subject_id = s.subject_id and b.i = (s.i + s.shift) % s.n), ss as (select shift, subject_id, regr_sxx(y, x) as a, regr_syy(y, x) as b, regr_sxy(y, x) as c from jn group by 1, 2 having count(*) >= 2), sr as (select shift, sum(c) / sqrt(sum(a) * sum(b)) as r from ss group by 1)"""


@query(f"{_PAIR}, {_SHIFTS} select shift, round(r, 6) as r from sr")
def op126_shift_null(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.shift_null(_pair(spark, folder), "subject_id", "day", "x", "y", 20), "r")


@query(f"{_PAIR}, {_SHIFTS} select count(*)::bigint as n_shifts, round((count(case when r >= (select r from sr where shift = 0) then 1 end) + 1) / (count(*) + 1.0), 6)::double as p_value from sr where shift > 0")
def op230_shift_p_value(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.shift_p_value(inference.shift_null(_pair(spark, folder), "subject_id", "day", "x", "y", 20)), "p_value")


_PARTS = f"{_DAYS}, pd as (select subject_id, median(m) - 50 as delta from daymean group by 1)"


def _participant_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return _day_means(spark, folder).groupBy("subject_id").agg((F.median("m") - 50).alias("delta"))


@query(f"""{_PARTS}, nn as (select *, row_number() over (order by subject_id) - 1 as i, count(*) over () as n from pd), sg as (select unnest(range(0, (1 << (select count(*) from pd)::int))) as k),
 sums as (select k, sum(case when (k >> i::int) & 1 = 1 then -delta else delta end) as s from sg, nn group by 1) select (select count(*) from pd)::bigint as n_participants, round((select avg(delta) from pd), 6) as mean, round(avg(case when abs(s) >= abs((select sum(delta) from pd)) - 1e-9 then 1.0 else 0.0 end), 6)::double as p_value from sums""")
def op237_sign_flip(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.sign_flip(_participant_deltas(spark, folder), "delta"), "mean", "p_value")


@query(f"""{_PARTS}, nn as (select *, row_number() over (order by subject_id) - 1 as i, count(*) over () as n from pd), sl as (select i as j, n, unnest(range(0, 500))::int as draw from nn), pk as (select draw, {_hash("sha256('gapline|' || draw::varchar || '|' || j::varchar)")} % n as i from sl),
 md as (select draw, median(delta) as m from pk join nn using (i) group by 1) select count(*)::bigint as draws, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from md""")
def op238_participant_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.bootstrap(_participant_deltas(spark, folder), "subject_id", "delta", 500, ROOT), "low", "high")


_P = "fam as (select event_type, 1.0 / (1 + count(*) % 97) as p from ev group by 1)"


@query(f"with {EV}, {_P}, o as (select *, row_number() over (order by p, event_type) as r, count(*) over () as n from fam), w as (select *, least(1, (n - r + 1) * p) as raw from o) select event_type, round(p, 6)::double as p, round(max(raw) over (order by r), 6)::double as adjusted from w")
def op127_holm(spark: SparkSession, folder: str) -> DataFrame:
    p = readings(spark, folder).groupBy("event_type").agg((1.0 / (1 + F.count(F.lit(1)) % 97)).alias("p")).withColumn("family", F.lit(1))
    return six(inference.holm(p, ["family"], "p").drop("family"), "p", "adjusted")


_PRED = "pd as (select subject_id, event_id, state, (value % 1.0) as p, ((value * 7) % 1.0) as q from ev)"


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).select("subject_id", "event_id", "state", (F.col("value") % 1.0).alias("p"), ((F.col("value") * 7) % 1.0).alias("q"))


@query(f"""with {EV}, {_PRED}, c as (select *, greatest(least(p, 1 - 1e-6), 1e-6) as k, case when (p >= 0.5) = (state = 1) then 1.0 else 0.0 end as ok from pd) select subject_id, count(*)::bigint as n, round(avg(-case when state = 1 then ln(k) else ln(1 - k) end), 6) as log_loss, round(avg((p - state) * (p - state)), 6) as brier, round(avg(ok), 6)::double as accuracy,
 round((avg(case when state = 1 then ok end) + avg(case when state = 0 then ok end)) / 2, 6)::double as balanced_accuracy from c group by 1""")
def op277_prediction_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.prediction_metrics(_predictions(spark, folder), ["subject_id"], "state", "p"), "log_loss", "brier", "accuracy", "balanced_accuracy")


@query(f"with {EV}, {_PRED} select subject_id, count(*)::bigint as n, round(avg(abs(q - p)), 6) as drift, round(avg(case when (p >= 0.5) <> (q >= 0.5) then 1.0 else 0.0 end), 6)::double as flip_rate from pd group by 1")
def op278_change_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.change_metrics(_predictions(spark, folder), ["subject_id"], "p", "q"), "drift", "flip_rate")


@query(f"with {EV}, {_PRED}, e as (select subject_id, abs(p - state) as err, q, row_number() over (partition by subject_id order by q desc, abs(p - state)) as r, count(*) over (partition by subject_id) as n from pd) select subject_id, round(avg(err), 6) as risk, count(*)::bigint as kept from e where r <= ceil(n * 0.7) group by 1")
def op132_risk_at_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = _predictions(spark, folder).withColumn("err", F.abs(F.col("p") - F.col("state")))
    return six(inference.risk_at_coverage(rows, ["subject_id"], "err", "q", 0.7), "risk")


@query(f"with {EV}, n as (select subject_id, count(*) as k from ev group by 1) select subject_id, round((select sum(k) from n) / ((select count(*) from n) * k), 6)::double as weight from n")
def op286_participant_weights(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.participant_weights(readings(spark, folder).select("subject_id"), "subject_id").distinct(), "weight")


# --- models -----------------------------------------------------------------------------------------------------------


@query(f"with {EV}, f as ({_FEATURES}), l as (select subject_id, 'binary_load' as feature, binary_load as x from f union all select subject_id, 'exposure_mean', exposure_mean from f), h as (select distinct subject_id as held_out from f) select held_out, feature, round(median(x), 6) as median, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as sd from h join l on l.subject_id <> h.held_out group by 1, 2")
def op279_fold_preparation(spark: SparkSession, folder: str) -> DataFrame:
    return six(models.fold_preparation(_features(spark, folder).select("subject_id", "binary_load", "exposure_mean"), "subject_id", ["binary_load", "exposure_mean"]), "median", "mean", "sd")


@query()
def op285_loso_logistic(spark: SparkSession, folder: str) -> DataFrame:
    rows = _features(spark, folder)
    labelled = rows.join(rows.groupBy("subject_id").agg(F.median("additive_load").alias("usual")), "subject_id").withColumn("label", (F.col("additive_load") > F.col("usual")).cast("int"))
    return models.loso_logistic(labelled, "subject_id", "label", ["binary_load", "exposure_mean", "activity_load"])


# --- comparison -------------------------------------------------------------------------------------------------------


@query(f"with {EV}, f as ({_FEATURES}), g as (select subject_id, day, additive_load, additive_load + case when day = date '2024-01-05' then 1e-10 else 0 end as other from f) select 'additive_load' as column_name, count(case when additive_load = other then 1 end)::bigint as n_equal, count(case when additive_load <> other then 1 end)::bigint as n_different, 0::bigint as n_beyond_tolerance, 0::bigint as n_unpaired from g")
def op304_compare_tables(spark: SparkSession, folder: str) -> DataFrame:
    a = _features(spark, folder).select(*KEYS, F.round("additive_load", 9).alias("additive_load"))
    b = a.withColumn("additive_load", F.col("additive_load") + F.when(F.col("day") == "2024-01-05", 1e-10).otherwise(0.0))
    return diff.compare_tables(a, b, KEYS, ["additive_load"], absolute=1e-8).drop("max_difference")


@query("select o_custkey, count(*)::bigint as n_rows from orders group by 1 having count(*) > 1")
def op015_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    from gapline.sources.tables import read

    return diff.repeated_keys(read(spark, folder, "orders"), ["o_custkey"])


@query(f"select event_type, count(*)::bigint as n_rows, sum({_hash("sha256('=' || event_id::varchar || chr(31) || '=' || event_type)")}::hugeint)::varchar as content from events group by 1")
def op315_content_digest(spark: SparkSession, folder: str) -> DataFrame:
    from gapline.sources.tables import read

    return diff.content_digest(read(spark, folder, "events"), ["event_id", "event_type"], ["event_type"])


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def op046_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    from gapline.sources.tables import read

    return diff.unmatched(read(spark, folder, "customer"), read(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return op054_geometry_effect(spark, folder)
