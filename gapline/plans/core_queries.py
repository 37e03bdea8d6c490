"""Queries of the core's data operators over the study tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators.filling import fill, mine_all, real_day, real_text
from gapline.operators.intervals import periods_and_gaps
from gapline.operators.regular_grid import regular_grid
from gapline.operators.spikes import implausible_readings
from gapline.operators.trailing import build_trees, correct_trees, trailing_totals
from gapline.sources.tables import each_once, read
from gapline.staging import materialize


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return implausible_readings(read(spark, folder, "phase_records")).select("record_id")


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return implausible_readings(read(spark, folder, "phase_records"))


#: Columns that are there before the value is read: what may determine it.
_RECORD_COLUMNS = ["view_id", "subject_id", "sensor_day_id", "primitive", "sensor_file", "phase_bin", "source_timestamp"]
_MASK_COLUMNS = ["seed", "primitive", "scenario", "draw", "window_start", "mask_interval_id", "subject_id", "sensor_day_id"]


def _value_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = each_once(read(spark, folder, "phase_records"), ["record_id", *_RECORD_COLUMNS, "raw_value"])
    return materialize(rows.withColumn("raw_value", F.nanvl("raw_value", F.lit(None).cast("double"))), "values")


def _filled_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = _value_rows(spark, folder)
    # The statement asks for values of the own view: determinants must hold it.
    own = [d for d in mine_all(rows, "raw_value", "record_id", _RECORD_COLUMNS) if "view_id" in d.determinant]
    finite = F.when(F.abs("raw_value") < float("inf"), F.col("raw_value"))
    # The mean of the finite values; a group that has only infinite ones gives the greatest.
    return fill(rows, "raw_value", "record_id", own, [["view_id", "phase_bin"], ["view_id"]], F.coalesce(F.avg(finite), F.max("raw_value")))


def _mask_rows(spark: SparkSession, folder: str) -> DataFrame:
    table = read(spark, folder, "mask_intervals")
    rows = each_once(table, ["mask_row_id", *[c for c in _MASK_COLUMNS if c in table.columns]])
    return materialize(rows.withColumns({"subject_id": real_text("subject_id"), "sensor_day_id": real_day("sensor_day_id")}), "masks")


def _filled_masks(rows: DataFrame, field: str) -> DataFrame:
    # The statement asks for values of the own mask: determinants must hold its seed.
    own = [d for d in mine_all(rows, field, "mask_row_id", [c for c in _MASK_COLUMNS if c != field and c in rows.columns]) if "seed" in d.determinant]
    # Of seeds with more than one value, the most frequent, and of equals the least.
    return fill(rows, field, "mask_row_id", own, [["seed"]], F.mode(field, True))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    values = _filled_values(spark, folder).where("raw_value_filled").select(F.lit("phase_records").alias("table_name"), F.col("record_id").alias("row_id"), F.lit("raw_value").alias("field_name"))
    masks = _mask_rows(spark, folder)
    for field in ("subject_id", "sensor_day_id"):
        keys = _filled_masks(masks, field).where(f"{field}_filled")
        values = values.unionByName(keys.select(F.lit("mask_intervals").alias("table_name"), F.col("mask_row_id").alias("row_id"), F.lit(field).alias("field_name")))
    return values


def p3_filled_values(spark: SparkSession, folder: str) -> DataFrame:
    return _filled_values(spark, folder).select("record_id", "view_id", F.round("raw_value", 4).alias("raw_value"), "raw_value_filled", "raw_value_source")


def p3_filled_masks(spark: SparkSession, folder: str) -> DataFrame:
    masks = _mask_rows(spark, folder)
    subject = _filled_masks(masks, "subject_id").select("mask_row_id", "subject_id", "subject_id_filled", "subject_id_source")
    day = _filled_masks(masks, "sensor_day_id").select("mask_row_id", "sensor_day_id", "sensor_day_id_filled", "sensor_day_id_source")
    return subject.join(day, "mask_row_id")


def p3_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """What determines a lost field: all minimal dependencies on one or two columns that hold on all complete rows."""
    masks, found = _mask_rows(spark, folder), []
    for field in ("subject_id", "sensor_day_id"):
        found += mine_all(masks, field, "mask_row_id", [c for c in _MASK_COLUMNS if c != field and c in masks.columns])
    found += mine_all(_value_rows(spark, folder), "raw_value", "record_id", _RECORD_COLUMNS)
    return spark.createDataFrame([(",".join(d.determinant), d.field, d.groups, d.repeated_groups) for d in found], "determinant string, field string, n_groups bigint, repeated_groups bigint")


def _calendar(spark: SparkSession, folder: str) -> DataFrame:
    return each_once(read(spark, folder, "calendar_days"), ["sensor_day_id", "subject_id", "lifelog_date", "source_record_count"])


def p4_trailing(spark: SparkSession, folder: str) -> DataFrame:
    totals = trailing_totals(build_trees(_calendar(spark, folder), "subject_id", "lifelog_date", "source_record_count"))
    return totals.select(
        F.col("entity").alias("subject_id"), F.date_format("day", "yyyy-MM-dd").alias("lifelog_date"), "total_7", "total_30",
        F.round("average_7", 6).alias("average_7"), F.round("average_30", 6).alias("average_30"), "valued_days_7", "valued_days_30",
    )


def p4_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Trees of what had come within two days, then corrected by the rows that came later: the same totals as from all rows."""
    rows = read(spark, folder, "calendar_days").groupBy("sensor_day_id", "subject_id", "lifelog_date", "source_record_count").agg(F.min("received_at").alias("came"))
    late = F.coalesce(F.col("came") >= F.date_add("lifelog_date", 2), F.lit(True))
    day = rows.groupBy("subject_id", "lifelog_date").agg(F.sum("source_record_count").alias("source_record_count"), F.sum(F.when(~late, F.col("source_record_count"))).alias("first"), F.bool_or(late).alias("late"), F.bool_or(~late).alias("early"))
    day = materialize(day, "days")
    trees = build_trees(day.where("early").select("subject_id", "lifelog_date", F.col("first").alias("source_record_count")), "subject_id", "lifelog_date", "source_record_count")
    totals = trailing_totals(correct_trees(materialize(trees, "trees"), day.where("late"), "subject_id", "lifelog_date", "source_record_count"))
    return totals.select(F.col("entity").alias("subject_id"), F.date_format("day", "yyyy-MM-dd").alias("lifelog_date"), "total_7", "total_30", "valued_days_7", "valued_days_30")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    totals = trailing_totals(build_trees(_calendar(spark, folder), "subject_id", "lifelog_date", "source_record_count"))
    # average_7 < average_30 / 10, in whole numbers.
    quiet = totals.where("total_7 * 300 < total_30 * 7")
    return quiet.select(F.col("entity").alias("subject_id"), F.date_format("day", "yyyy-MM-dd").alias("lifelog_date"))


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid(read(spark, folder, "phase_records"), read(spark, folder, "phase_views"), read(spark, folder, "primitive_definitions"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).where("is_empty").select("view_id", "epoch_index")


def p6_series(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder)


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).select("view_id", "epoch_index", "n_readings", F.round("observed", 6).alias("observed"), "is_empty")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    supports = periods_and_gaps(read(spark, folder, "phase_records").where("support_end > support_start"), ["view_id"], "support_start", "support_end")
    masks = periods_and_gaps(read(spark, folder, "mask_intervals"), ["seed"], "mask_start", "mask_end")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    shape = lambda df, kind, key: df.select(F.lit(kind).alias("interval_kind"), F.col(key).cast("string").alias("entity_key"), "span_kind", text("span_start"), text("span_end"))
    return shape(supports, "support", "view_id").unionByName(shape(masks, "mask", "seed"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_reasons, p3_found, p3_filled_values, p3_filled_masks, p3_dependencies, p4_found, p4_trailing, p4_corrected, p6_found, p6_series, p6_counts, p7_found)
}

_REAL_SUBJECT = "case when subject_id is null or not regexp_matches(subject_id, '[\\p{L}\\p{N}]') or lower(trim(subject_id)) in ('na', 'n/a', 'nan', 'none', 'null', 'nil', 'unknown', 'unk', 'missing', 'undefined', 'tbd') then null else subject_id end"
_REAL_DAY = "case when sensor_day_id > 0 then sensor_day_id end"
_MASKS = f"masks as (select distinct mask_row_id, seed, {_REAL_SUBJECT} as subject_id, {_REAL_DAY} as sensor_day_id from mask_intervals)"
_SPINE = """days as (select distinct sensor_day_id, subject_id, lifelog_date, source_record_count from calendar_days where subject_id is not null and lifelog_date is not null),
 daily as (select subject_id, lifelog_date, coalesce(sum(source_record_count), 0)::bigint as total, case when count(source_record_count) > 0 then 1 else 0 end as valued from days group by all),
 spine as (select subject_id, unnest(range(min(lifelog_date)::timestamp, max(lifelog_date)::timestamp + interval 1 day, interval 1 day))::date as lifelog_date from daily group by subject_id),
 filled as (select s.subject_id, s.lifelog_date, coalesce(d.total, 0) as total, coalesce(d.valued, 0) as valued from spine s left join daily d on d.subject_id = s.subject_id and d.lifelog_date = s.lifelog_date),
 totals as (select subject_id, lifelog_date,
  sum(total) over (partition by subject_id order by lifelog_date rows 6 preceding)::bigint as total_7,
  sum(total) over (partition by subject_id order by lifelog_date rows 29 preceding)::bigint as total_30,
  sum(valued) over (partition by subject_id order by lifelog_date rows 6 preceding)::bigint as valued_days_7,
  sum(valued) over (partition by subject_id order by lifelog_date rows 29 preceding)::bigint as valued_days_30 from filled)"""
_EPOCHS = """frames as (select distinct v.view_id, v.window_start, d.cadence_minutes, d.expected_epochs from phase_views v join primitive_definitions d on d.primitive = v.primitive),
 recs as (select distinct record_id, view_id, effective_timestamp, raw_value from phase_records where raw_value is not null and not isnan(raw_value)),
 hits as (select r.view_id, floor(epoch_us(r.effective_timestamp) - epoch_us(f.window_start))::hugeint // (f.cadence_minutes * 60000000) as epoch_index, r.raw_value
  from recs r join frames f on f.view_id = r.view_id where r.effective_timestamp >= f.window_start),
 cells as (select view_id, epoch_index::int as epoch_index, count(*)::bigint as n_readings, avg(case when isfinite(raw_value) then raw_value end) as observed from hits group by all),
 slots as (select view_id, unnest(range(0, expected_epochs))::int as epoch_index from frames)"""


def _merge_sql(kind: str, key: str, table: str, start: str, end: str) -> str:
    return f"""(with i as (select distinct {key}::varchar as k, {start} as s, {end} as e from {table} where {key} is not null and {start} < {end}),
 m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
 g as (select *, sum(case when reach >= s then 0 else 1 end) over (partition by k order by s, e rows unbounded preceding) as island from m),
 p as (select k, min(s) as s, max(e) as e from g group by k, island),
 x as (select k, 'period' as span_kind, s, e from p union all select k, 'gap', lag(e) over (partition by k order by s), s from p)
 select '{kind}' as interval_kind, k as entity_key, span_kind, strftime(s, '%Y-%m-%d %H:%M:%S') as span_start, strftime(e, '%Y-%m-%d %H:%M:%S') as span_end from x where s is not null)"""


def _dependencies_sql() -> str:
    """All sets of one or two columns, checked in full, and the minimal ones that hold."""
    from itertools import combinations

    parts, jobs = [], [("subject_id", _MASK_COLUMNS, "m", "mask_row_id"), ("sensor_day_id", _MASK_COLUMNS, "m", "mask_row_id"), ("raw_value", _RECORD_COLUMNS, "r", "record_id")]
    for field, columns, table, ident in jobs:
        rest = [c for c in columns if c != field]
        for d in [*combinations(rest, 1), *combinations(rest, 2)]:
            there = " and ".join(f"{c} is not null" for c in (*d, field))
            parts.append(f"select '{','.join(d)}' as determinant, '{field}' as field, {len(d)} as size, ['{chr(39).join(d) if len(d) == 1 else (chr(39) + ', ' + chr(39)).join(d)}'] as cols, count(*) as n_groups, count(case when again then 1 end) as repeated_groups, count(case when bad then 1 end) as bad from (select min({field}) <> max({field}) as bad, min({ident}) <> max({ident}) as again from {table} where {there} group by {', '.join(d)})")
    return f"""with m as (select distinct mask_row_id, seed, primitive, scenario, draw, window_start, mask_interval_id, {_REAL_SUBJECT} as subject_id, {_REAL_DAY} as sensor_day_id from mask_intervals),
 r as (select distinct record_id, {', '.join(_RECORD_COLUMNS)}, case when isnan(raw_value) then null else raw_value end as raw_value from phase_records),
 c as ({' union all '.join(parts)}), h as (select * from c where bad = 0 and repeated_groups > 0 and repeated_groups >= 0.1 * n_groups)
 select determinant, field, n_groups::bigint as n_groups, repeated_groups::bigint as repeated_groups from h where not exists (select 1 from h g where g.field = h.field and g.size < h.size and list_has_all(h.cols, g.cols))"""


ORACLES = {
    "p3_found": f"""with {_MASKS}, known as (select seed, max(subject_id) as s, max(sensor_day_id) as d from masks group by seed),
 recs as (select distinct record_id, view_id, case when isnan(raw_value) then null else raw_value end as raw_value from phase_records),
 views as (select view_id from recs where raw_value is not null group by view_id)
 select 'phase_records' as table_name, record_id as row_id, 'raw_value' as field_name from recs where raw_value is null and view_id in (select view_id from views)
 union all select 'mask_intervals', mask_row_id, 'subject_id' from masks join known using (seed) where subject_id is null and s is not null
 union all select 'mask_intervals', mask_row_id, 'sensor_day_id' from masks join known using (seed) where sensor_day_id is null and d is not null""",
    "p3_filled_masks": f"""with {_MASKS}, known as (select seed, max(subject_id) as s, max(sensor_day_id) as d from masks group by seed)
 select mask_row_id, coalesce(subject_id, s) as subject_id, subject_id is null and s is not null as subject_id_filled,
  case when subject_id is not null then 'observed' when s is not null then 'dependency:seed' else 'open' end as subject_id_source,
  coalesce(sensor_day_id, d) as sensor_day_id, sensor_day_id is null and d is not null as sensor_day_id_filled,
  case when sensor_day_id is not null then 'observed' when d is not null then 'dependency:seed' else 'open' end as sensor_day_id_source
 from masks join known using (seed)""",
    "p3_dependencies": _dependencies_sql(),
    "p3_filled_values": """with r as (select distinct record_id, view_id, phase_bin, case when isnan(raw_value) then null else raw_value end as v from phase_records),
 b as (select view_id, phase_bin, coalesce(avg(case when isfinite(v) then v end), max(v)) as m from r where v is not null and phase_bin is not null group by 1, 2), w as (select view_id, coalesce(avg(case when isfinite(v) then v end), max(v)) as m from r where v is not null group by 1)
 select record_id, r.view_id, round(coalesce(v, b.m, w.m), 4)::double as raw_value, v is null and coalesce(b.m, w.m) is not null as raw_value_filled, case when v is not null then 'observed' when b.m is not null then 'group:view_id,phase_bin' when w.m is not null then 'group:view_id' else 'open' end as raw_value_source
 from r left join b on b.view_id = r.view_id and b.phase_bin = r.phase_bin left join w on w.view_id = r.view_id""",
    "p4_trailing": f"with {_SPINE} select subject_id, strftime(lifelog_date, '%Y-%m-%d') as lifelog_date, total_7, total_30, round(total_7 / 7.0, 6)::double as average_7, round(total_30 / 30.0, 6)::double as average_30, valued_days_7, valued_days_30 from totals",
    "p4_corrected": f"with {_SPINE} select subject_id, strftime(lifelog_date, '%Y-%m-%d') as lifelog_date, total_7, total_30, valued_days_7, valued_days_30 from totals",
    "p4_found": f"with {_SPINE} select subject_id, strftime(lifelog_date, '%Y-%m-%d') as lifelog_date from totals where total_7 * 300 < total_30 * 7",
    "p6_found": f"with {_EPOCHS} select s.view_id, s.epoch_index from slots s left join cells c on c.view_id = s.view_id and c.epoch_index = s.epoch_index where c.view_id is null",
    "p6_counts": f"with {_EPOCHS} select s.view_id, s.epoch_index, coalesce(c.n_readings, 0)::bigint as n_readings, round(c.observed, 6) as observed, c.view_id is null as is_empty from slots s left join cells c on c.view_id = s.view_id and c.epoch_index = s.epoch_index",
    "p7_found": _merge_sql("support", "view_id", "phase_records", "support_start", "support_end") + " union all " + _merge_sql("mask", "seed", "mask_intervals", "mask_start", "mask_end"),
}
