"""Pairing each row with the nearest row in time of the same entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance_seconds: int,
) -> DataFrame:
    """For each row of ``left`` the ``right_id`` nearest in time with the same ``keys``.

    Time is cut into buckets as wide as the tolerance, so a partner lies in the
    same or an adjacent bucket: the join is an equality on keys and bucket, and a
    busy entity is spread over its buckets. Copies of a right row collapse before
    the shuffle. Ties go to the earlier row, then to the smaller id.

    Result: ``left_id``, ``right_id``, ``seconds`` (right minus left), one row for
    each distinct ``left_id`` whose keys and time aren't null and that has a
    partner at most the tolerance away, before or after. Rows of either side with
    a null key, time or id match nothing. Other columns are ignored.
    """
    width = tolerance_seconds * 1_000_000
    key = [f"__k{i}" for i in range(len(keys))]
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    def side(df: DataFrame, time: str, ident: str, names: tuple[str, str]) -> DataFrame:
        out = df.select(*(F.col(k).alias(n) for k, n in zip(keys, key)), us(time).alias(names[0]), F.col(ident).alias(names[1]))
        return out.dropna()

    asked = side(left, left_time, left_id, ("at", "asker")).distinct()
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / width) - 1, F.floor(F.col("at") / width) + 1)))
    # Of rows of one entity at one instant only the smallest id can win.
    given = (
        side(right, right_time, right_id, ("t", "partner"))
        .withColumn("bucket", F.floor(F.col("t") / width))
        .groupBy(*key, "bucket", "t")
        .agg(F.min("partner").alias("partner"))
    )
    apart = F.col("t") - F.col("at")
    best = (
        given.join(asked, [*key, "bucket"])
        .where(F.abs(apart) <= width)
        .groupBy("asker")
        .agg(F.min(F.struct(F.abs(apart).alias("apart"), F.col("t"), F.col("partner"), apart.alias("signed"))).alias("best"))
    )
    return best.select(F.col("asker").alias(left_id), F.col("best.partner").alias(right_id), (F.col("best.signed") / 1e6).alias("seconds"))
