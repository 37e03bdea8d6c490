"""Windows of readings before labels, anchors, and days of other data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before_each(df: DataFrame, subject: str, seconds: str, value: str, far: int, near: int) -> DataFrame:
    """``window_n`` and ``window_mean`` of the values from ``far`` to ``near`` seconds before each row, both included. No join: a range frame."""
    w = Window.partitionBy(subject).orderBy(seconds).rangeBetween(-far, -near)
    return df.withColumns({"window_n": F.count(value).over(w), "window_mean": F.avg(value).over(w)})


def window_features(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, median and linear 90th percentile of each group's values."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.median(value).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"))


def earliest_a_day(df: DataFrame, keys: list[str], ts: str, ident: str) -> DataFrame:
    """The first row of each group; ties of time go to the smaller id."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(ts, ident))).where("__r = 1").drop("__r")


def spaced_anchors(df: DataFrame, subject: str, seconds: str, gap: int) -> DataFrame:
    """Anchors of each participant at least ``gap`` seconds apart, taken greedily from the first on.

    Only the first row of each full hour is a candidate, which bounds a
    participant's candidates by the hours of the study.
    """
    hours = df.where(F.col(seconds).isNotNull()).groupBy(subject, F.floor(F.col(seconds) / 3600).alias("__h")).agg(F.min(seconds).alias("__s"))
    lists = hours.groupBy(subject).agg(F.sort_array(F.collect_list("__s")).alias("__l"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda a, s: F.when(a["last"].isNull() | (s - a["last"] >= gap), F.struct(s.alias("last"), F.concat(a["taken"], F.array(s)).alias("taken"))).otherwise(a)
    return lists.select(subject, F.explode(F.aggregate("__l", start, step)["taken"]).alias("anchor"))


def local_day(ts: Column, zone: str) -> Column:
    """The local date of a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def index_masks(df: DataFrame, keys: list[str], order: str, ident: str, root: str, share: float = 0.2) -> DataFrame:
    """Two masks of floor(share * n) records of each group: a run of successive ones from a hashed start, and scattered ones by hash.

    Result: ``keys``, ``ident``, ``in_block`` and ``in_scatter``. A group too small for one record has none.
    """
    w = Window.partitionBy(*keys)
    number = lambda *parts: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(root), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("bigint")
    rows = df.select(*keys, order, ident).withColumns({"__i": F.row_number().over(w.orderBy(order, ident)) - 1, "__n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("__k", F.floor(F.col("__n") * share + 1e-9))
    start = F.pmod(number(*(F.col(k) for k in keys)), F.col("__n") - F.col("__k") + 1)
    hashed = rows.withColumns({"__s": start, "__r": F.row_number().over(w.orderBy(number(F.col(ident)), ident))})
    return hashed.select(*keys, ident, ((F.col("__i") >= F.col("__s")) & (F.col("__i") < F.col("__s") + F.col("__k"))).alias("in_block"), (F.col("__r") <= F.col("__k")).alias("in_scatter"))


def thinned(df: DataFrame, keys: list[str], order: str, ident: str, every: int) -> DataFrame:
    """Every ``every``-th record of each group, from the first on: a coarser cadence."""
    w = Window.partitionBy(*keys).orderBy(order, ident)
    return df.withColumn("__i", F.row_number().over(w) - 1).where(F.col("__i") % every == 0).drop("__i")


def kept_share(df: DataFrame, keys: list[str], ident: str, root: str, share: float) -> DataFrame:
    """A share of each group's records, rounded up, by hash."""
    w = Window.partitionBy(*keys)
    order = F.sha2(F.concat_ws("|", F.lit(root), F.col(ident).cast("string")), 256)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(order, ident)), "__n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("__r") <= F.ceil(F.col("__n") * share - 1e-9)).drop("__r", "__n")


def support_summary(df: DataFrame, keys: list[str], minute: str, ident: str) -> DataFrame:
    """Records, and the least, median and greatest time between successive ones (null with one record)."""
    w = Window.partitionBy(*keys).orderBy(minute, ident)
    steps = df.withColumn("__d", F.col(minute) - F.lag(minute).over(w))
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.min("__d").alias("least_gap"), F.median("__d").alias("median_gap"), F.max("__d").alias("greatest_gap"))


def donor_counts(profiles: DataFrame, subject: str, day: str) -> DataFrame:
    """For each day and slot that has values: how many other, earlier, later and same kind of days (weekday or weekend) have it too."""
    weekend = F.weekday(F.col(day)) >= 5
    w = Window.partitionBy(subject, "slot")
    before = F.row_number().over(w.orderBy(day)) - 1
    rows = profiles.withColumn("weekend", weekend)
    every, kind = F.count(F.lit(1)).over(w), F.count(F.lit(1)).over(Window.partitionBy(subject, "slot", "weekend"))
    return rows.select(subject, day, "slot", (every - 1).alias("other_days"), before.alias("past_days"), (every - 1 - before).alias("future_days"), (kind - 1).alias("same_kind_days"))


def one_hot(df: DataFrame, column: str, vocabulary: list[str]) -> list[Column]:
    """One 0/1 column a word of a fixed vocabulary, and one for all else; null counts as else."""
    known = [F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}") for v in vocabulary]
    return [*known, F.when(F.col(column).isin(*vocabulary), 0).otherwise(1).alias(f"{column}_other")]


def calendar_features(day: Column, index: Column) -> list[Column]:
    """Sine and cosine of the weekday (Monday 0) and the trend of the day's index."""
    angle = F.weekday(day) * (2 * 3.141592653589793 / 7)
    return [F.sin(angle).alias("weekday_sin"), F.cos(angle).alias("weekday_cos"), (index / 30.0).alias("trend")]
