"""The event stream as sensor readings of participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.sources.tables import read

#: Cadence and windows of the readings, in minutes of the day.
CADENCE = 30
DAY, EVENING = (0, 1440), (1080, 1440)


def minute_of_day(ts: str):
    """Minutes since midnight with seconds as fractions; parts of seconds don't count."""
    return F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """One row a reading: participant, time, day, minute of the day, value, a 0/1 state and whether its validity is unknown."""
    e = read(spark, folder, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("p"), F.lpad((F.col("user_id") % 10).cast("string"), 2, "0")).alias("subject_id"),
        "ts",
        F.to_date("ts").alias("day"),
        minute_of_day("ts").alias("minute"),
        "event_type",
        "value",
        F.when(F.col("event_type").isin("click", "purchase"), 1.0).otherwise(0.0).alias("state"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("unknown"),
    )


def canonical_sensor(spark: SparkSession, folder: str, sensor_file: str, columns: tuple[str, ...] = ("raw_value",)) -> DataFrame:
    """The readings of one sensor: ``subject_id``, ``source_timestamp`` and the named columns, each record once; nothing else is scanned."""
    rows = read(spark, folder, "phase_records").where(F.col("sensor_file") == sensor_file)
    return rows.select("record_id", "subject_id", "source_timestamp", *columns).distinct()


def window_bounds(day: Column, window: Column) -> tuple[Column, Column]:
    """Start and end of a day's feature window: the whole day, or from 18 h on."""
    start = day.cast("timestamp_ntz")
    hours = lambda n: F.make_dt_interval(F.lit(0), F.lit(n))
    return F.when(window == "evening", start + hours(18)).otherwise(start), start + hours(24)
