"""Contracts of tables: what breaks them, row by row, with the first rule broken. An empty result is a sound table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from gapline.staging import micros


def naive_timestamps(df: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    """``out``: the zone-free time that a text or time column holds, null where it is none.

    A column of zoned times, or a text with a zone, is an error: the clock of the
    participant must not be shifted silently.
    """
    if isinstance(df.schema[column].dataType, TimestampType):
        raise ValueError(f"{column} has a time zone")
    text = F.col(column).cast("string")
    zoned = F.trim(text).rlike(r"(?i)\d(?:z|[+-]\d\d:?\d\d| ?utc| ?gmt)$")
    checked = F.when(zoned, F.raise_error(F.concat(F.lit("a time with a zone: "), text)).cast("string")).otherwise(text)
    return df.withColumn(out, F.try_to_timestamp(checked).cast("timestamp_ntz"))


def numeric_column(df: DataFrame, column: str, out: str = "number") -> DataFrame:
    """``out``: the column as a number, null where it is none or the column is missing altogether."""
    if column not in df.columns:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, F.col(column).cast("string").try_cast("double"))


def whole_number(column: Column, least: float | None = None) -> Column:
    """Whether a number is finite, whole and not under ``least``; null isn't."""
    ok = (F.abs(column) < float("inf")) & (column == F.floor(column))
    return F.coalesce(ok if least is None else ok & (column >= least), F.lit(False))


def _first_rule(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    rule = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules))
    return df.select(*keys, rule.alias("rule")).where("rule is not null")


def calendar_faults(days: DataFrame) -> DataFrame:
    """Days that break the calendar's contract: ``sensor_day_id``, ``rule``.

    Rules: missing_key, sleep_date (not the day after), repeated_day (of one
    participant), elapsed_index (null, not whole, or not the days since the start
    of the collection plus 1), observed_flags (support without source, or the
    union wrong), record_count (null, not whole, negative, or 0 with a source).
    """
    w = Window.partitionBy("subject_id", "lifelog_date")
    rows = days.withColumn("__n", F.count(F.lit(1)).over(w))
    source, support = F.col("any_source_record_observed"), F.col("any_measurement_support_observed")
    count = F.col("source_record_count").cast("double")
    return _first_rule(
        rows, ["sensor_day_id"],
        [
            ("missing_key", F.col("subject_id").isNull() | F.col("lifelog_date").isNull()),
            ("sleep_date", F.datediff("sleep_date", "lifelog_date") != 1),
            ("repeated_day", F.col("__n") > 1),
            ("elapsed_index", ~whole_number(F.col("elapsed_day_index").cast("double"), 1) | (F.col("elapsed_day_index") != F.datediff("lifelog_date", "collection_start_date") + 1)),
            ("observed_flags", (support & ~source) | (F.col("any_sensor_observed") != (source | support))),
            ("record_count", ~whole_number(count, 0) | ((count == 0) & source)),
        ],
    )


def window_faults(windows: DataFrame, counts: DataFrame, least_records: int, least_minutes: float) -> DataFrame:
    """Windows before labels that can't be used: ``window_id``, ``rule``.

    ``counts``: ``window_id``, ``n``, ``first``, ``last`` of the readings within.
    Rules: missing (sensor, label or time), empty_window, duration (not that of
    the window), future (the label lies before the window's end), too_few (readings), too_short (their span).
    """
    rows = windows.join(counts, "window_id", "left")
    length = (micros("window_end") - micros("window_start")) / 60_000_000
    return _first_rule(
        rows, ["window_id"],
        [
            ("missing", F.col("sensor_file").isNull() | F.col("label").isNull() | F.col("label_time").isNull()),
            ("empty_window", ~(F.col("window_start") < F.col("window_end"))),
            ("duration", F.abs(F.col("acquisition_duration") - length) > 0.01),
            ("future", micros("label_time") < micros("window_start")),
            ("too_few", F.coalesce("n", F.lit(0)) < least_records),
            ("too_short", (micros("last") - micros("first")) / 60_000_000 < least_minutes),
        ],
    )


def phase_faults(records: DataFrame, views: DataFrame) -> DataFrame:
    """Records that break the phase contract: ``record_id``, ``rule``.

    Rules: no_view, half_hour (not that of its time), support (ends before it
    starts, or its middle isn't its time), units (negative, or positive for an invalid
    one), infinite, event_mass (events without mass or mass without events).
    """
    rows = records.join(views, "view_id", "left")
    middle = (micros("support_start") + micros("support_end")) / 2
    minute = F.hour("effective_timestamp") * 60 + F.minute("effective_timestamp")
    return _first_rule(
        rows, ["record_id"],
        [
            ("no_view", F.col("__view").isNull()),
            ("half_hour", F.col("phase_bin") != F.floor(minute / 30)),
            ("support", (F.col("support_end") < F.col("support_start")) | (F.abs(micros("effective_timestamp") - middle) > 1)),
            ("units", (F.col("support_units") < 0) | (~F.col("valid") & (F.col("support_units") > 0))),
            ("infinite", F.coalesce(F.abs("raw_value") == float("inf"), F.lit(False))),
            ("event_mass", (F.col("positive_event_count") > 0) != (F.col("event_mass") > 0)),
        ],
    )


def class_counts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows with a label, and how many are 1 and 0."""
    return df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))


def supported(df: DataFrame, value: str, support: str) -> DataFrame:
    """Rows with a finite value and a positive support."""
    return df.where((F.abs(value) < float("inf")) & (F.col(support) > 0))


def infinite_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each numeric column how many cells are missing (null or NaN) and infinite: missing ones are allowed, infinite ones aren't."""
    null = F.lit(None).cast("double")
    v = lambda c: F.nanvl(F.col(c).cast("double"), null)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), v(c).alias("v")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("column_name").agg(F.count_if(F.col("v").isNull()).alias("n_missing"), F.count_if(F.abs("v") == float("inf")).alias("n_infinite"))


def labelled_days(days: DataFrame, labels: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Days with their labels from day ``first`` on, one row each; and labels of no day, which must not be.

    Both tables have ``subject_id`` and ``day``; ``days`` also ``day_index``.
    """
    keys = ["subject_id", "day"]
    lost = labels.join(days.select(*keys), keys, "left_anti")
    return labels.join(days, keys).where(F.col("day_index") >= first), lost


def gap_faults(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps that can't be borrowed as a mask: outside the window, empty, or overlapping the one before. Nothing is clipped.

    ``gaps``: ``keys``, ``gap_start``, ``gap_end``, ``low``, ``high`` in minutes.
    """
    w = Window.partitionBy(*keys).orderBy("gap_start", "gap_end")
    rows = gaps.withColumn("__before", F.max("gap_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rule = F.when(~(F.col("gap_start") < F.col("gap_end")), "empty").when((F.col("gap_start") < F.col("low")) | (F.col("gap_end") > F.col("high")), "outside").when(F.col("__before") > F.col("gap_start"), "overlaps")
    return rows.select(*keys, "gap_start", "gap_end", rule.alias("rule")).where("rule is not null")


def duplicate_times(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Of each group: rows, distinct times, times with several rows, and how many of those disagree in value."""
    times = df.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.min(value) != F.max(value), F.lit(False)) | (F.count(value) < F.count(F.lit(1))) & (F.count(value) > 0)).alias("odd"))
    return times.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_times"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if("odd").alias("n_conflicting"))
