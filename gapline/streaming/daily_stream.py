"""Daily additive features of a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_daily_loads(stream: DataFrame, ts: str = "ts", subject: str = "user_id", value: str = "value", lateness: str = "1 day") -> DataFrame:
    """Number and sum of readings a participant and day, final once the watermark has passed the day.

    Readings later than ``lateness`` are dropped by the watermark, as a stream
    must end at some time; a batch over the same readings has them all.
    """
    timed = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", lateness)
    return timed.groupBy(F.window("__t", "1 day").alias("w"), subject).agg(F.count(value).alias("n"), F.sum(value).alias("total")).select(subject, F.col("w.start").alias("day_start"), "n", "total")
