"""Queries of contracts over the study tables, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import contracts, masks
from gapline.plans.primitive_queries import query as _query, rounded
from gapline.sources.study import canonical_sensor, readings, window_bounds
from gapline.sources.tables import each_once, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = partial(_query, into=(QUERIES, ORACLES))

_DAYS = ["sensor_day_id", "subject_id", "lifelog_date", "sleep_date", "collection_start_date", "elapsed_day_index", "day_type", "any_source_record_observed", "any_measurement_support_observed", "any_sensor_observed", "source_record_count"]
_WINDOWS = ["window_id", "dataset", "subject_id", "sensor_file", "label", "window_start", "window_end", "label_time", "acquisition_duration"]
DAYS = f"days as (select distinct {', '.join(_DAYS)} from calendar_days)"
WINDOWS = f"win as (select distinct {', '.join(_WINDOWS)} from prediction_windows)"


def days(spark: SparkSession, folder: str) -> DataFrame:
    return each_once(read(spark, folder, "calendar_days"), _DAYS)


def windows(spark: SparkSession, folder: str) -> DataFrame:
    return each_once(read(spark, folder, "prediction_windows"), _WINDOWS)


def _when(rules: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when coalesce({bad}, true) then '{name}'" for name, bad in rules) + " end"


@query("select event_id, strftime(try_cast(case when event_id % 7 = 0 then 'not a time' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp), '%Y-%m-%d %H:%M:%S') as parsed from events")
def op002_parse_times(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of times, a seventh of which are none."""
    text = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    out = contracts.naive_timestamps(read(spark, folder, "events").select("event_id", text.alias("text")), "text")
    return out.select("event_id", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("select p_partkey, try_cast(split_part(p_type, ' ', 1) || '' as double) as of_type, try_cast(p_size::varchar as double) as of_size, null::double as of_absent from part")
def op030_numeric_columns(spark: SparkSession, folder: str) -> DataFrame:
    part = read(spark, folder, "part").withColumn("word", F.split("p_type", " ")[0])
    out = part
    for column, name in (("word", "of_type"), ("p_size", "of_size"), ("absent", "of_absent")):
        out = contracts.numeric_column(out, column, name)
    return out.select("p_partkey", "of_type", "of_size", "of_absent")


@query(f"""with {DAYS}, n as (select *, count(*) over (partition by subject_id, lifelog_date) as k from days)
 select sensor_day_id, rule from (select sensor_day_id, {_when([("missing_key", "subject_id is null or lifelog_date is null"), ("sleep_date", "date_diff('day', lifelog_date, sleep_date) <> 1"), ("repeated_day", "k > 1"), ("elapsed_index", "elapsed_day_index is null or elapsed_day_index < 1 or elapsed_day_index <> date_diff('day', collection_start_date, lifelog_date) + 1"),
 ("observed_flags", "(any_measurement_support_observed and not any_source_record_observed) or any_sensor_observed <> (any_source_record_observed or any_measurement_support_observed)"), ("record_count", "source_record_count is null or source_record_count < 0 or (source_record_count = 0 and any_source_record_observed)")])} as rule from n) where rule is not null""")
def op036_calendar_faults(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.calendar_faults(days(spark, folder))


_INSIDE = """rec as (select distinct record_id, subject_id, sensor_file, effective_timestamp as t from phase_records), cnt as (select w.window_id, count(*) as n, min(t) as first, max(t) as last from win w join rec r on r.subject_id = w.subject_id and r.sensor_file = w.sensor_file and r.t >= w.window_start and r.t < w.window_end group by 1)"""


def _window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Readings in each window. Windows are cut into quarter hours, so that a participant's readings and windows meet by equality."""
    step = 900_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = each_once(read(spark, folder, "phase_records"), ["record_id", "subject_id", "sensor_file", "effective_timestamp"]).withColumn("q", F.floor(us("effective_timestamp") / step))
    cells = windows(spark, folder).where("window_start < window_end").select("window_id", "subject_id", "sensor_file", "window_start", "window_end", F.explode(F.sequence(F.floor(us("window_start") / step), F.floor(us("window_end") / step))).alias("q"))
    both = cells.join(rows, ["subject_id", "sensor_file", "q"]).where((F.col("effective_timestamp") >= F.col("window_start")) & (F.col("effective_timestamp") < F.col("window_end")))
    return both.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("effective_timestamp").alias("first"), F.max("effective_timestamp").alias("last"))


@query(f"""with {WINDOWS}, {_INSIDE} select window_id, rule from (select w.window_id, {_when([("missing", "sensor_file is null or label is null or label_time is null"), ("empty_window", "not window_start < window_end"), ("duration", "abs(acquisition_duration - (epoch_us(window_end) - epoch_us(window_start)) / 60000000.0) > 0.01"),
 ("future", "label_time < window_start"), ("too_few", "coalesce(n, 0) < 5"), ("too_short", "(epoch_us(last) - epoch_us(first)) / 60000000.0 < 10")])} as rule from win w left join cnt using (window_id)) where rule is not null""")
def op040_window_faults(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.window_faults(windows(spark, folder), _window_counts(spark, folder), 5, 10.0)


@query(f"with {WINDOWS} select dataset, sensor_file, count(*)::bigint as n, count(case when label = 1 then 1 end)::bigint as positive, count(case when label = 0 then 1 end)::bigint as negative from win where label is not null group by 1, 2")
def op041_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.class_counts(windows(spark, folder), ["dataset", "sensor_file"], "label")


@query("select primitive, count(*)::bigint as n_supported, round(sum(transformed_numerator), 4)::double as total from (select distinct record_id, primitive, raw_value, support_units, transformed_numerator from phase_records) where isfinite(raw_value) and support_units > 0 group by 1")
def op042_supported(spark: SparkSession, folder: str) -> DataFrame:
    rows = each_once(read(spark, folder, "phase_records"), ["record_id", "primitive", "raw_value", "support_units", "transformed_numerator"])
    return rounded(contracts.supported(rows, "raw_value", "support_units").groupBy("primitive").agg(F.count(F.lit(1)).alias("n_supported"), F.sum("transformed_numerator").alias("total")), 4, "total")


_RECORD = ["record_id", "view_id", "effective_timestamp", "support_start", "support_end", "phase_bin", "raw_value", "valid", "support_units", "positive_event_count", "event_mass"]


@query(f"""with r as (select distinct {', '.join(_RECORD)} from phase_records), v as (select distinct view_id, 1 as there from phase_views)
 select record_id, rule from (select record_id, {_when([("no_view", "there is null"), ("half_hour", "phase_bin <> floor((hour(effective_timestamp) * 60 + minute(effective_timestamp)) / 30)"), ("support", "support_end < support_start or abs(epoch_us(effective_timestamp) - (epoch_us(support_start) + epoch_us(support_end)) / 2.0) > 1"),
 ("units", "support_units < 0 or (not valid and support_units > 0)"), ("infinite", "coalesce(isinf(raw_value), false)"), ("event_mass", "(positive_event_count > 0) <> (event_mass > 0)")])} as rule from r left join v using (view_id)) where rule is not null""")
def op043_phase_faults(spark: SparkSession, folder: str) -> DataFrame:
    views = each_once(read(spark, folder, "phase_views"), ["view_id"]).withColumn("__view", F.lit(1))
    return contracts.phase_faults(each_once(read(spark, folder, "phase_records"), _RECORD), views)


_CHECKED = ["raw_value", "raw_validity", "transformed_numerator", "event_mass", "event_minute"]


@query("with r as (select distinct record_id, " + ", ".join(_CHECKED) + " from phase_records) " + " union all ".join(f"select '{c}' as column_name, count(case when {c} is null or isnan({c}) then 1 end)::bigint as n_missing, count(case when isinf({c}) then 1 end)::bigint as n_infinite from r" for c in _CHECKED))
def op044_infinite_cells(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.infinite_cells(each_once(read(spark, folder, "phase_records"), ["record_id", *_CHECKED]), _CHECKED)


_LABELS = f"{DAYS}, {WINDOWS}, dl as (select subject_id, lifelog_date as day, max(elapsed_day_index) as day_index, max(day_type) as day_type from days where subject_id is not null and lifelog_date is not null group by 1, 2), lab as (select window_id, subject_id, label_time::date as day, label from win where label is not null and label_time is not null)"


def _labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    own = days(spark, folder).where("subject_id is not null and lifelog_date is not null").groupBy("subject_id", F.col("lifelog_date").alias("day")).agg(F.max("elapsed_day_index").alias("day_index"), F.max("day_type").alias("day_type"))
    labels = windows(spark, folder).where("label is not null and label_time is not null").select("window_id", "subject_id", F.to_date("label_time").alias("day"), "label")
    return contracts.labelled_days(own, labels, 22)


@query(f"with {_LABELS} select window_id, lab.subject_id, strftime(lab.day, '%Y-%m-%d') as day, label, day_index, day_type from lab join dl on dl.subject_id = lab.subject_id and dl.day = lab.day where day_index >= 22")
def op048_labelled_days(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder)[0].select("window_id", "subject_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "label", "day_index", "day_type")


@query(f"with {_LABELS} select window_id from lab where not exists (select 1 from dl where dl.subject_id = lab.subject_id and dl.day = lab.day)")
def op050_labels_without_day(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder)[1].select("window_id")


@query("with r as (select distinct record_id, view_id, sensor_file, source_timestamp as t, case when isnan(raw_value) then null else raw_value end as v from phase_records), g as (select sensor_file, view_id, t, count(*) as n, coalesce(min(v) <> max(v), false) or (count(v) < count(*) and count(v) > 0) as odd from r where t is not null group by all) select sensor_file, sum(n)::bigint as n_rows, count(*)::bigint as n_times, count(case when n > 1 then 1 end)::bigint as n_repeated, count(case when odd then 1 end)::bigint as n_conflicting from g group by 1")
def op095_duplicate_times(spark: SparkSession, folder: str) -> DataFrame:
    rows = each_once(read(spark, folder, "phase_records"), ["record_id", "view_id", "sensor_file", "source_timestamp", "raw_value"]).withColumn("v", F.nanvl("raw_value", F.lit(None).cast("double")))
    each = contracts.duplicate_times(rows, ["sensor_file", "view_id"], "source_timestamp", "v")
    return each.groupBy("sensor_file").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_times", "n_repeated", "n_conflicting")))


_EV = """ev as (select event_id, 'p' || lpad((user_id % 10)::varchar, 2, '0') as subject_id, ts::date as day, (hour(ts) * 60 + minute(ts) + second(ts) / 60.0)::double as minute from events)"""


@query(f"with {_EV}, t as (select distinct subject_id, day, minute from ev), l as (select *, lead(minute) over (partition by subject_id, day order by minute) as gap_end from t), g as (select * from l where gap_end - minute > 30), f as (select *, case when minute < 360 or gap_end > 1380 then 'outside' end as rule from g) select subject_id, strftime(day, '%Y-%m-%d') as day, round(minute, 6) as gap_start, round(gap_end, 6) as gap_end, rule from f where rule is not null")
def op139_gap_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps of a day that can't be borrowed by a mask window from 6 to 23 h."""
    gaps = masks.internal_gaps(readings(spark, folder), ["subject_id", "day"], "minute", 30.0).withColumns({"low": F.lit(360.0), "high": F.lit(1380.0)})
    out = contracts.gap_faults(gaps, ["subject_id", "day"])
    return rounded(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")), 6, "gap_start", "gap_end")


@query("select sensor_file, count(*)::bigint as n_primitives, string_agg(primitive, ',' order by primitive) as primitives, max(expected_epochs)::int as most_epochs from primitive_definitions group by 1")
def op067_definitions_by_sensor(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "primitive_definitions")
    return d.groupBy("sensor_file").agg(F.count(F.lit(1)).alias("n_primitives"), F.array_join(F.sort_array(F.collect_list("primitive")), ",").alias("primitives"), F.max("expected_epochs").alias("most_epochs"))


@query("select distinct record_id, subject_id, strftime(source_timestamp, '%Y-%m-%d %H:%M:%S.%f') as source_timestamp, case when isnan(raw_value) then null else round(raw_value, 4) end as raw_value from phase_records where sensor_file = 'wHr_canonical.parquet'")
def op001_sensor_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One sensor's readings, by projection and a filter that reach the scan."""
    out = canonical_sensor(spark, folder, "wHr_canonical.parquet")
    return out.select("record_id", "subject_id", F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("source_timestamp"), F.round(F.nanvl("raw_value", F.lit(None).cast("double")), 4).alias("raw_value"))


@query("with v as (select distinct view_id, primitive, window_start, window_end from phase_views) select v.view_id, strftime(date_trunc('day', window_start) + case when feature_window = 'evening' then interval 18 hour else interval 0 hour end, '%Y-%m-%d %H:%M:%S') as low, strftime(date_trunc('day', window_start) + interval 1 day, '%Y-%m-%d %H:%M:%S') as high, window_start = date_trunc('day', window_start) + case when feature_window = 'evening' then interval 18 hour else interval 0 hour end and window_end = date_trunc('day', window_start) + interval 1 day as as_defined from v join primitive_definitions d on d.primitive = v.primitive")
def op032_window_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The window that a view's definition asks for, and whether the view has it."""
    views = each_once(read(spark, folder, "phase_views"), ["view_id", "primitive", "window_start", "window_end"])
    known = views.join(F.broadcast(read(spark, folder, "primitive_definitions").select("primitive", "feature_window")), "primitive")  # a fixed table
    low, high = window_bounds(F.to_date("window_start"), F.col("feature_window"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return known.select("view_id", text(low).alias("low"), text(high).alias("high"), ((F.col("window_start") == low) & (F.col("window_end") == high)).alias("as_defined"))
