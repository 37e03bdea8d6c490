"""Days of participants, coverage of days, and daily features under explicit contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions.robust import weighted_quantile


def day_spine(df: DataFrame, subject: str = "subject_id", day: str = "day") -> DataFrame:
    """Each day of each participant from the first to the last, with its index from 1 and the day after (the sleep date)."""
    ends = df.where(F.col(subject).isNotNull() & F.col(day).isNotNull()).groupBy(subject).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    days = ends.select(subject, "__a", F.explode(F.sequence("__a", "__b")).alias(day))
    return days.select(subject, day, F.date_add(day, 1).alias("sleep_date"), (F.datediff(day, "__a") + 1).alias("day_index"))


def interval_end(df: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Readings that stand for the minutes before them: ``support_start``, ``support_end``, ``effective`` (the middle) and ``day``.

    The day is that of the last microsecond of the support; a support that began
    on the day before belongs to no day and is left out.
    """
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    half = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(minutes * 30))
    tick = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))
    out = df.withColumns({"support_start": F.col(ts) - span, "support_end": F.col(ts), "effective": F.col(ts) - half, "day": F.to_date(F.col(ts) - tick)})
    return out.where(F.to_date("support_start") == F.col("day"))


def coverage(df: DataFrame, keys: list[str], minute: str, valid: Column, window: tuple[int, int], cadence: int) -> DataFrame:
    """How much of a window's cadence bins holds a valid reading.

    ``observed_bins``, ``coverage`` (at most 1), ``longest_gap`` (minutes of the
    longest run of empty bins, borders included) and ``records``.
    """
    low, high = window
    bins = (high - low) // cadence
    seen = df.where((F.col(minute) >= low) & (F.col(minute) < high)).withColumn("__b", F.when(valid, F.floor((F.col(minute) - low) / cadence).cast("int")))
    # A window has a fixed number of bins, so the set is bounded.
    grouped = seen.groupBy(*keys).agg(F.sort_array(F.collect_set("__b")).alias("__set"), F.count(F.lit(1)).alias("records"))
    edges = lambda a, b: F.concat(a, b)
    gaps = F.zip_with(edges(F.array(F.lit(-1)), F.col("__set")), edges(F.col("__set"), F.array(F.lit(bins))), lambda a, b: b - a - 1)
    return grouped.select(*keys, F.size("__set").alias("observed_bins"), (F.size("__set") / bins).alias("coverage"), (F.array_max(gaps) * cadence).alias("longest_gap"), "records")


def binary_load(value: str) -> Column:
    """Mean of the readings that are 0 or 1; null without any."""
    return F.avg(F.when(F.col(value).isin(0.0, 1.0), F.col(value)))


def active_minutes(value: str, epoch: float) -> Column:
    """Minutes of epochs whose flag is 1; null without a valid flag."""
    return F.sum(F.when(F.col(value).isin(0.0, 1.0), F.col(value))) * epoch


def activity_load(value: str, unknown: str) -> Column:
    """Mean flag of the readings whose validity isn't unknown."""
    return F.avg(F.when((F.col(unknown) == 0) & F.col(value).isin(0.0, 1.0), F.col(value)))


def additive_load(value: str, minimum: float, scale: float = 1.0) -> Column:
    """Sum of the finite readings of at least ``minimum``, scaled; null without any."""
    ok = (F.abs(value) < float("inf")) & (F.col(value) >= minimum)
    return F.sum(F.when(ok, F.col(value))) * scale


def exposure_mean(value: str, minimum: float) -> Column:
    """Mean of log(1 + x) over the readings of at least ``minimum``."""
    ok = (F.abs(value) < float("inf")) & (F.col(value) >= minimum)
    return F.avg(F.when(ok, F.log1p(value)))


def evening_p90(df: DataFrame, keys: list[str], minute: str, value: str) -> DataFrame:
    """The minute of the evening by which nine tenths of the day's positive magnitude had come."""
    rows = df.where((F.col(minute) >= 1080) & (F.col(minute) < 1440))
    return weighted_quantile(rows, keys, minute, value, 0.9, "evening_p90")


def evening_bins(df: DataFrame, keys: list[str], minute: str, cell: Column, cadence: int = 30) -> DataFrame:
    """An array of one cell for each bin of the evening, null where a bin has no reading."""
    bins = 360 // cadence
    rows = df.where((F.col(minute) >= 1080) & (F.col(minute) < 1440)).withColumn("__b", F.floor((F.col(minute) - 1080) / cadence).cast("int"))
    cells = rows.groupBy(*keys, "__b").agg(cell.alias("__c"))
    known = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__b", "__c"))).alias("__m"))
    return known.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.try_element_at("__m", i)).alias("bins"))


def _first(name: str, test) -> Column:
    """The first index of an array that passes a test, else its size."""
    return F.coalesce(F.array_min(F.filter(F.transform(name, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())), F.size(name))


def dark_onset(b: DataFrame, keys: list[str], cadence: int = 30) -> DataFrame:
    """``onset`` and ``censoring`` out of ``bins`` (1 dark, 0 light, null not assessable): see ``low_light_onset``."""
    dark, blind, n = _first("bins", lambda x, _: x == 1), _first("bins", lambda x, _: x.isNull()), F.size("bins")
    later = F.exists(F.slice("bins", blind + 1, F.greatest(n - blind, F.lit(0))), lambda x: x.isNotNull())
    censoring = (
        F.when((dark == 0) | (blind == 0), "left")
        .when((dark < n) & (blind < dark), "gap")
        .when(dark < n, "none")
        .when(blind == n, "none")
        .when(~later, "right")
        .otherwise("gap")
    )
    return b.select(*keys, censoring.alias("censoring"), F.when((dark < n) & (dark > 0) & (blind > dark), 1080 + cadence * dark).alias("onset"))


def low_light_onset(df: DataFrame, keys: list[str], minute: str, value: str, threshold: float, least: int, share: float) -> DataFrame:
    """When the evening gets dark: ``onset`` and ``censoring`` (none, left, gap, right).

    A bin is assessable with ``least`` readings and qualifies if ``share`` of them
    are at most the threshold. The first qualifying bin counts if all bins before
    it are assessable and it isn't the first.
    """
    ok = F.col(value).isNotNull() & (F.col(value) >= 0)
    cell = F.when(F.count_if(ok) >= least, F.when(F.avg(F.when(ok, (F.col(value) <= threshold).cast("double"))) >= share, 1).otherwise(0))
    return dark_onset(evening_bins(df, keys, minute, cell), keys)


def run_onset(b: DataFrame, keys: list[str], run: int, cadence: int = 30) -> DataFrame:
    """``onset`` and ``censoring`` out of ``bins`` (1 on, 0 off, null missing): see ``charging_onset``."""
    n, blind = F.size("bins"), _first("bins", lambda x, _: x.isNull())
    starts = lambda x, i: (i > 0) & (i + run <= blind) & (F.get("bins", i - 1) == 0) & (F.aggregate(F.slice("bins", i + 1, F.lit(run)), F.lit(0), lambda a, y: a + F.coalesce(y, F.lit(0))) == run)
    on = _first("bins", starts)
    later = F.exists(F.slice("bins", blind + 1, F.greatest(n - blind, F.lit(0))), lambda x: x.isNotNull())
    censoring = (
        F.when((blind > 0) & (F.get("bins", F.lit(0)) == 1), "left")
        .when(on < n, "none")
        .when(blind == 0, "left")
        .when((blind < n) & ~later, "right")
        .when(blind < n, "gap")
        .when(F.get("bins", n - 1) == 1, "right")
        .otherwise("none")
    )
    return b.select(*keys, censoring.alias("censoring"), F.when((on < n) & ~((blind > 0) & (F.get("bins", F.lit(0)) == 1)), 1080 + cadence * on).alias("onset"))


def charging_onset(df: DataFrame, keys: list[str], minute: str, flag: str, run: int) -> DataFrame:
    """When charging begins: the first change from off to on that lasts ``run`` bins, before any missing bin."""
    return run_onset(evening_bins(df, keys, minute, F.max(flag).cast("int")), keys, run)


def settling(df: DataFrame, keys: list[str], minute: str, value: str, least: int) -> DataFrame:
    """Late minus early evening mean (``delta``), and the slope of half-hour medians an hour (``slope``).

    Null with fewer than ``least`` distinct minutes in 18-20 h or 22-24 h; the
    slope also with fewer than two half hours.
    """
    rows = df.where((F.col(minute) >= 1080) & (F.col(minute) < 1440) & F.col(value).isNotNull())
    early, late = F.col(minute) < 1200, F.col(minute) >= 1320
    sides = rows.groupBy(*keys).agg(
        F.countDistinct(F.when(early, F.floor(minute))).alias("__e"),
        F.countDistinct(F.when(late, F.floor(minute))).alias("__l"),
        (F.avg(F.when(late, F.col(value))) - F.avg(F.when(early, F.col(value)))).alias("delta"),
    )
    half = rows.groupBy(*keys, (F.floor(F.col(minute) / 30) * 0.5).alias("__h")).agg(F.median(value).alias("__m"))
    slopes = half.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, F.regr_slope("__m", "__h")).alias("slope"))
    enough = (F.col("__e") >= least) & (F.col("__l") >= least)
    return sides.join(slopes, keys).select(*keys, F.when(enough, F.col("delta")).alias("delta"), F.when(enough, F.col("slope")).alias("slope"))


def long_features(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A wide table of features as rows (``primitive``, ``feature_value``)."""
    return df.unpivot(keys, columns, "primitive", "feature_value")


def wide_features(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows of features as one column each; ``names`` fixes the columns."""
    return df.groupBy(*keys).pivot("primitive", names).agg(F.first("feature_value"))


def drop_conflicting(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key; keys whose rows disagree are left out whole."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__max"), F.count(F.lit(1)).alias("n_rows")).where(F.col(value) == F.col("__max")).drop("__max")
