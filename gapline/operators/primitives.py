"""Daily features of prepared views, each by the definition of its primitive.

A definition names the operation, its parameters, the unit, the validity rule and
the window; nothing about a primitive is fixed here. A view is one primitive of
one participant-day, so what is gathered of a view is bounded by its epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.operators.daily import dark_onset, evening_bins, run_onset
from gapline.sources.tables import each_once
from gapline.staging import join_bounded, materialize, micros

MINUTE = 60_000_000
#: What names a view.
VIEW = ["view_id", "subject_id", "sensor_day_id", "primitive"]


def frames(views: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each view once, with its window's start and the definition of its primitive."""
    number = lambda name, default: F.coalesce(F.col("operation_params")[name].cast("double"), F.lit(default)).alias(f"p_{name}")
    known = definitions.select(
        "primitive", "cadence_minutes", "expected_epochs", "coverage_mode", "operation", "unit_scale", number("minimum", 0.0), number("validity_equals", None), number("epoch_minutes", 1.0),
        number("low_threshold", 10.0), number("min_observations", 1.0), number("min_duration_minutes", 10.0), F.col("operation_params")["component"].alias("p_component"),
    )
    return join_bounded(each_once(views, [*VIEW, "window_start"]), known, ["primitive"])


def valid_reading(operation: Column, v: Column, validity: Column, minimum: Column, equals: Column) -> Column:
    """Whether a reading counts for its primitive: flags are 0 or 1, magnitudes finite and not under the minimum, validity as asked for."""
    finite, flag = F.abs(v) < float("inf"), v.isin(0.0, 1.0)
    ok = (
        F.when(operation.isin("binary_load", "binary_active_minutes", "charging_onset"), flag)
        .when(operation == "activity_load", flag)
        .when(operation.isin("additive_load", "exposure_mean", "evening_p90"), finite & (v >= minimum))
        .when(operation == "low_light_onset", finite & (v >= 0))
        .otherwise(finite)
    )
    return F.coalesce(ok & (equals.isNull() | (validity == equals)), F.lit(False))


def framed(records: DataFrame, views: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each record once, in its view's frame: ``v`` (null if missing), ``minute`` of the day, ``epoch`` of the window, and ``ok``.

    ``ok`` is whether it counts for the primitive; a record outside of the window
    doesn't. Records of no view are left out; a null or NaN value is no reading.
    """
    rows = each_once(records, ["record_id", "view_id", "effective_timestamp", "support_start", "support_end", "raw_value", "raw_validity"])
    both = join_bounded(rows, frames(views, definitions), ["view_id"])
    null = F.lit(None).cast("double")
    both = both.withColumns({"v": F.nanvl("raw_value", null), "u": F.nanvl("raw_validity", null), "at": micros("effective_timestamp") - micros("window_start")})
    midnight = F.unix_micros(F.date_trunc("day", F.col("window_start").cast("timestamp")))
    inside = (F.col("at") >= 0) & (F.col("at") < F.col("expected_epochs") * F.col("cadence_minutes") * F.lit(MINUTE).cast("bigint"))
    return both.withColumns(
        {
            "minute": (micros("effective_timestamp") - midnight) / MINUTE,
            "epoch": F.floor(F.col("at") / (F.col("cadence_minutes") * F.lit(MINUTE).cast("bigint"))).cast("int"),
            "ok": F.coalesce(inside, F.lit(False)) & valid_reading(F.col("operation"), F.col("v"), F.col("u"), F.col("p_minimum"), F.col("p_validity_equals")),
        }
    ).drop("raw_value", "raw_validity", "at")


def coverage_of(rows: DataFrame, by: list[str] = VIEW) -> DataFrame:
    """How much of each view is covered by counted readings.

    ``observed_epochs``, ``expected_epochs``, ``coverage`` and
    ``longest_gap_minutes`` (availability; null in event support, where an epoch
    without event says nothing), ``support_density`` (event support only),
    ``coverage_status`` (observed, missing, unknown) and ``status`` (observed, insufficient).
    """
    seen = rows.groupBy(*by).agg(
        F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("epoch")))).alias("e"), F.first("expected_epochs").alias("expected_epochs"),
        F.first("cadence_minutes").alias("cadence"), F.first("coverage_mode").alias("mode"), F.count("record_id").alias("n_records"), F.count_if("ok").alias("n_valid"),
    )
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), "e"), F.concat("e", F.array(F.col("expected_epochs"))), lambda a, b: b - a - 1)
    share = F.least(F.size("e") / F.col("expected_epochs"), F.lit(1.0))
    there, events = F.size("e") > 0, F.col("mode") == "event_support"
    return seen.select(
        *by, "n_records", "n_valid", F.size("e").alias("observed_epochs"), "expected_epochs", F.when(~events, share).alias("coverage"),
        F.when(~events, F.array_max(gaps) * F.col("cadence")).cast("double").alias("longest_gap_minutes"), F.when(events, share).alias("support_density"),
        F.when(events, "unknown").when(there, "observed").otherwise("missing").alias("coverage_status"), F.when(there, "observed").otherwise("insufficient").alias("status"),
    )


def _simple(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums and means."""
    mine = rows.where(F.col("operation").isin("binary_load", "binary_active_minutes", "activity_load", "additive_load", "exposure_mean") & F.col("ok"))
    total, n = F.sum("v"), F.count("v")
    op = F.first("operation")
    value = (
        F.when(op.isin("binary_load", "activity_load"), total / n).when(op == "binary_active_minutes", total * F.first("p_epoch_minutes")).when(op == "additive_load", total * F.first("unit_scale")).otherwise(F.avg(F.log1p("v")))
    )
    return mine.groupBy(*by).agg(value.alias("value")).withColumn("censoring", F.lit("none"))


def weighted_p90(rows: DataFrame, by: list[str], time: str, weight: str, q: float = 0.9) -> DataFrame:
    """The time by which ``q`` of the positive weight had come: the inverse of the weighted distribution, without interpolation."""
    mass = rows.where(F.col(weight) > 0).groupBy(*by, time).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*by)
    run = mass.withColumns({"upto": F.sum("w").over(w.orderBy(time)), "all": F.sum("w").over(w)})
    return run.where(F.col("upto") >= F.col("all") * (q * (1 - 1e-12))).groupBy(*by).agg(F.min(time).alias("value"))


def _settling(rows: DataFrame, by: list[str], least: int = 30) -> DataFrame:
    """Late less early evening mean, or the slope of half-hour medians an hour."""
    mine = rows.where(F.col("operation").isin("heart_rate_settling") & F.col("ok"))
    early, late = (F.col("minute") >= 1080) & (F.col("minute") < 1200), (F.col("minute") >= 1320) & (F.col("minute") < 1440)
    sides = mine.groupBy(*by, "p_component").agg(
        F.countDistinct(F.when(early, F.floor("minute"))).alias("e"), F.countDistinct(F.when(late, F.floor("minute"))).alias("l"),
        (F.avg(F.when(late, F.col("v"))) - F.avg(F.when(early, F.col("v")))).alias("delta"),
    )
    half = mine.groupBy(*by, (F.floor(F.col("minute") / 30) * 0.5).alias("h")).agg(F.median("v").alias("m"))
    slope = half.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 2, F.regr_slope("m", "h")).alias("slope"))
    picked = F.when((F.col("e") >= least) & (F.col("l") >= least), F.when(F.col("p_component") == "delta", F.col("delta")).otherwise(F.col("slope")))
    return sides.join(slope, by).select(*by, picked.alias("value"), F.lit("none").alias("censoring"))


def values_of(rows: DataFrame, by: list[str] = VIEW) -> DataFrame:
    """``value`` and ``censoring`` of each view that has a counted reading, whatever its operation. ``rows``: see ``framed``.

    ``by`` may add names to those of the view, such as a mask's.
    """
    ok = rows.where("ok")
    p90 = weighted_p90(ok.where("operation = 'evening_p90'"), by, "minute", "v").withColumn("censoring", F.lit("none"))
    light = F.when(F.count_if("ok") >= F.max("p_min_observations"), F.when(F.avg((F.col("v") <= F.col("p_low_threshold")).cast("double")) >= 0.75, 1).otherwise(0))
    dark = dark_onset(evening_bins(ok.where("operation = 'low_light_onset'"), by, "minute", light), by)
    on = run_onset(evening_bins(ok.where("operation = 'charging_onset'"), by, "minute", F.max("v").cast("int"), 1), by, 10, 1)
    onset = lambda d: d.select(*by, F.col("onset").cast("double").alias("value"), "censoring")
    out = _simple(rows, by)
    for part in (p90, onset(dark), onset(on), _settling(rows, by)):
        out = out.unionByName(part.select(*out.columns))
    return out


def daily_primitives(records: DataFrame, views: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row a view: ``value``, coverage (see ``coverage_of``) and ``censoring``. Views without records have none of these but their counts.

    A view without a counted reading has no value, never 0. An empty table gives
    an empty result.
    """
    base = frames(views, definitions)
    # Read by coverage and by each kind of operation.
    rows = materialize(framed(records, views, definitions), "framed")
    known = coverage_of(rows).join(values_of(rows), VIEW, "left")
    out = base.select(*VIEW, "expected_epochs", "coverage_mode").join(known.drop("expected_epochs"), VIEW, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = lambda c, other: F.coalesce(F.col(c), other).alias(c)
    return out.select(
        *VIEW, "value", zero("n_records"), zero("n_valid"), zero("observed_epochs"), "expected_epochs", "coverage", "longest_gap_minutes",
        F.coalesce("support_density", F.when(F.col("coverage_mode") == "event_support", 0.0)).alias("support_density"),
        status("coverage_status", F.when(F.col("coverage_mode") == "event_support", "unknown").otherwise("missing")), status("status", F.lit("insufficient")), status("censoring", F.lit("unknown")),
    )


def wide_primitives(daily: DataFrame, names: list[str], parts: tuple[str, ...] = ("value", "coverage", "longest_gap_minutes", "status", "censoring")) -> DataFrame:
    """One row a participant-day; each primitive's value under its name, its other parts under ``name__part``."""
    wide = daily.groupBy("subject_id", "sensor_day_id").pivot("primitive", names).agg(*(F.first(p, ignorenulls=True).alias(p) for p in parts))
    return wide.withColumnsRenamed({f"{n}_{p}": n if p == "value" else f"{n}__{p}" for n in names for p in parts})
