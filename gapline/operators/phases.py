"""Half-hour phases of a day: their values, templates from other days and people, and repair of masked days from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 30


def phase_bins(df: DataFrame, keys: list[str], minute: str, value: str, expected: int) -> DataFrame:
    """Number, sum and mean of each half hour's values, and its support: readings over those expected, at most 1."""
    rows = df.where(F.col(value).isNotNull()).withColumn("phase_bin", F.floor(F.col(minute) / BIN).cast("int"))
    return rows.groupBy(*keys, "phase_bin").agg(F.count(value).alias("units"), F.sum(value).alias("numerator"), F.avg(value).alias("bin_mean"), F.least(F.count(value) / expected, F.lit(1.0)).alias("support"))


def daily_from_bins(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The day's sum and mean out of its bins: they equal those of the readings."""
    return bins.groupBy(*keys).agg(F.sum("numerator").alias("day_sum"), (F.sum("numerator") / F.sum("units")).alias("day_mean"))


def others_median(df: DataFrame, group: list[str], member: str, value: str, out: str) -> DataFrame:
    """For each row the median of the other rows of its group: order statistics, no pairs.

    Taking out the row of rank r moves those behind it up by one, so the others'
    median needs only the three or four values in the middle of the group.
    """
    w = Window.partitionBy(*group)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"__r": F.row_number().over(w.orderBy(value, member)), "__n": F.count(F.lit(1)).over(w)})
    low, high = F.floor(F.col("__n") / 2).cast("int"), F.ceil(F.col("__n") / 2).cast("int")
    # With n - 1 others the middle positions are floor(n / 2) and ceil(n / 2), of the whole order from there or one behind.
    middle = ranked.groupBy(*group).agg(*(F.max(F.when(F.col("__r") == at + step, F.col(value))).alias(f"__{name}{step}") for name, at in (("l", low), ("h", high)) for step in (0, 1)))
    pick = lambda name, at: F.when(F.col("__r") <= at, F.col(f"__{name}1")).otherwise(F.col(f"__{name}0"))
    both = ranked.join(middle, group)
    return both.withColumn(out, F.when(F.col("__n") > 1, (pick("l", low) + pick("h", high)) / 2)).drop("__r", "__n", "__l0", "__l1", "__h0", "__h1")


def shrunk_template(personal: Column, population: Column, n: Column, days: float = 7.0) -> Column:
    """Personal value with weight n / (n + days), population with the rest; one alone where the other is missing."""
    w = n / (n + days)
    return F.coalesce(w * personal + (1 - w) * population, personal, population)


def masked_fraction(start: Column, end: Column, phase_bin: Column) -> Column:
    """The share of a half hour that lies in a mask of minutes."""
    return F.greatest(F.least(end, (phase_bin + 1) * BIN) - F.greatest(start, phase_bin * BIN), F.lit(0)) / float(BIN)


def additive_repair(observed: DataFrame, masks: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """Observed sum plus template times masked fraction over the bins of each day; null where a masked bin has no template.

    ``observed``: keys, ``observed_sum``; ``masks``: keys, ``mask_start``, ``mask_end``;
    ``template``: keys, ``phase_bin``, ``template``.
    """
    first, last = F.floor(F.col("mask_start") / BIN), F.floor((F.col("mask_end") - 1) / BIN)
    bins = masks.select(*keys, "mask_start", "mask_end", F.explode(F.sequence(first, last)).alias("phase_bin")).withColumn("phase_bin", F.col("phase_bin").cast("int"))
    filled = bins.join(template, [*keys, "phase_bin"], "left").withColumn("f", masked_fraction(F.col("mask_start"), F.col("mask_end"), F.col("phase_bin")))
    added = filled.groupBy(*keys).agg(F.when(F.count("template") == F.count(F.lit(1)), F.sum(F.col("template") * F.col("f"))).alias("added"))
    return observed.join(added, keys).select(*keys, "observed_sum", "added", (F.col("observed_sum") + F.col("added")).alias("repaired_sum"))


def repair_reliability(observed: Column, n: Column, scale: Column, population_scale: Column, critical: Column, days: float = 7.0) -> Column:
    """(coverage * min(1, n / days) * exp(-scale / population scale) * critical coverage) ** (1 / 4)."""
    return F.pow(observed * F.least(n / days, F.lit(1.0)) * F.exp(-scale / F.greatest(population_scale, F.lit(1e-12))) * critical, F.lit(0.25))


# --- half hours of prepared views -------------------------------------------------------------------------------------

#: How a primitive's half hours add up to its day.
KINDS = {"additive": ("additive_load", "binary_active_minutes"), "rate": ("binary_load", "activity_load", "exposure_mean"), "timing": ("evening_p90",)}
#: Last day of the calibration, least support of a personal template, days that a template leans on the population.
LAST_DAY, LEAST_SUPPORT, LEAN_DAYS = 14, 3.0 - 1e-9, 7.0


def kind_of(operation: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, ops in KINDS.items():
        out = F.when(operation.isin(*ops), kind).otherwise(out)
    return out


def contribution(operation: Column, v: Column) -> Column:
    """What a counted reading adds to its half hour."""
    return F.when(operation == "additive_load", v * F.col("unit_scale")).when(operation == "binary_active_minutes", v * F.col("p_epoch_minutes")).when(operation == "exposure_mean", F.log1p(v)).when(operation == "evening_p90", v * F.col("unit_scale")).otherwise(v)


def phase_readings(framed: DataFrame) -> DataFrame:
    """Counted readings of primitives that have half hours: ``phase_bin``, ``kind``, ``contribution``, ``expected_units`` of a half hour."""
    rows = framed.where("ok").withColumn("kind", kind_of(F.col("operation"))).where("kind is not null")
    return rows.withColumns({"phase_bin": F.floor(F.col("minute") / BIN).cast("int"), "contribution": contribution(F.col("operation"), F.col("v")), "expected_units": BIN / F.col("cadence_minutes")})


def view_bins(readings: DataFrame, by: list[str]) -> DataFrame:
    """Each half hour with a counted reading, of each view (``by`` names it and what goes with it): ``units``, ``numerator``, ``support``, ``n_events``, ``event_mass``, ``bin_value``.

    The value is the sum (additive), the mean (rate) or the time by which nine
    tenths of the mass had come (timing; null without mass).
    """
    keys = [*by, "phase_bin"]
    sums = readings.groupBy(*keys).agg(
        F.first("kind").alias("kind"), F.count(F.lit(1)).alias("units"), F.sum("contribution").alias("numerator"), F.least(F.count(F.lit(1)) / F.first("expected_units"), F.lit(1.0)).alias("support"),
        F.count_if(F.col("contribution") > 0).alias("n_events"), F.sum(F.when(F.col("contribution") > 0, F.col("contribution")).otherwise(0.0)).alias("event_mass"),
    )
    late = _p90(readings.where("kind = 'timing'"), ["view_id", "phase_bin"])
    value = F.when(F.col("kind") == "additive", F.col("numerator")).when(F.col("kind") == "rate", F.col("numerator") / F.col("units")).otherwise(F.col("late"))
    return sums.join(late, ["view_id", "phase_bin"], "left").withColumn("bin_value", value).drop("late")


def _p90(rows: DataFrame, keys: list[str], q: float = 0.9) -> DataFrame:
    mass = rows.where("contribution > 0").groupBy(*keys, "minute").agg(F.sum("contribution").alias("w"))
    w = Window.partitionBy(*keys)
    run = mass.withColumns({"upto": F.sum("w").over(w.orderBy("minute")), "all": F.sum("w").over(w)})
    return run.where(F.col("upto") >= F.col("all") * (q * (1 - 1e-12))).groupBy(*keys).agg(F.min("minute").alias("late"))


def days_of_bins(bins: DataFrame, readings: DataFrame, by: list[str]) -> DataFrame:
    """The day's value out of its half hours: sums, sums over units, or the pooled events' time."""
    sums = bins.groupBy(*by).agg(F.first("kind").alias("kind"), F.sum("numerator").alias("s"), F.sum("units").alias("n"))
    late = _p90(readings.where("kind = 'timing'"), by)
    value = F.when(F.col("kind") == "additive", F.col("s")).when(F.col("kind") == "rate", F.col("s") / F.col("n")).otherwise(F.col("late"))
    return sums.join(late, by, "left").select(*by, "kind", value.alias("day_value"))


def personal_templates(bins: DataFrame) -> DataFrame:
    """Of each participant, primitive, half hour and ``target`` day (2 to 15): the support-weighted median of the days before it, up to day 14.

    ``bins`` has ``subject_id``, ``primitive``, ``phase_bin``, ``elapsed``,
    ``bin_value``, ``support``. Target 15 stands for all later days. A day's row
    stands for at most 14 targets. ``n``: the support behind it.
    """
    from gapline.functions.robust import weighted_median

    days = bins.where(F.col("bin_value").isNotNull() & F.col("elapsed").between(1, LAST_DAY) & (F.col("support") > 0))
    each = days.withColumn("target", F.explode(F.sequence(F.col("elapsed") + 1, F.lit(LAST_DAY + 1))))
    keys = ["subject_id", "primitive", "phase_bin", "target"]
    size = each.groupBy(*keys).agg(F.sum("support").alias("n"))
    center = weighted_median(each, keys, "bin_value", "support", "personal")
    off = each.join(center, keys).withColumn("off", F.abs(F.col("bin_value") - F.col("personal")))
    return center.join(size, keys).join(weighted_median(off, keys, "off", "support", "mad"), keys)


def population_templates(personal: DataFrame) -> DataFrame:
    """Of each participant, primitive and half hour: the median of the other participants' full calibrations."""
    full = personal.where(F.col("target") == LAST_DAY + 1).select("subject_id", "primitive", "phase_bin", "personal")
    return others_median(full, ["primitive", "phase_bin"], "subject_id", "personal", "population").select("subject_id", "primitive", "phase_bin", "population")


def templates(personal: DataFrame, population: DataFrame) -> DataFrame:
    """Four templates of each participant, primitive, half hour and target: ``personal_phase`` (with enough support), ``population_phase``, ``phaseguard`` (the blend) and ``personal_global`` (the median of the personal ones of the day)."""
    keys = ["subject_id", "primitive", "phase_bin"]
    both = personal.join(population, keys, "left")
    own = F.when(F.col("n") >= LEAST_SUPPORT, F.col("personal"))
    out = both.select(*keys, "target", "n", "mad", own.alias("personal_phase"), F.col("population").alias("population_phase"), shrunk_template(own, F.col("population"), F.col("n"), LEAN_DAYS).alias("phaseguard"))
    whole = personal.where(F.col("n") >= LEAST_SUPPORT).groupBy("subject_id", "primitive", "target").agg(F.median("personal").alias("personal_global"))
    return out.join(whole, ["subject_id", "primitive", "target"], "left")


def event_distributions(readings: DataFrame) -> DataFrame:
    """Where each participant's events lie: ``personal``, the share of mass of each half hour of a timing primitive; ``population``, the mean of the others' shares; ``blend``.

    The blend gives the personal part the weight days / (days + 7). No pair of
    participants is formed: the others' mean is the sum less the own part.
    """
    mass = readings.where("kind = 'timing' and contribution > 0").groupBy("subject_id", "primitive", "phase_bin").agg(F.sum("contribution").alias("m"))
    total = mass.groupBy("subject_id", "primitive").agg(F.sum("m").alias("total"))
    days = readings.where("kind = 'timing'").groupBy("subject_id", "primitive").agg(F.countDistinct("view_id").alias("days"))
    own = mass.join(total, ["subject_id", "primitive"]).select("subject_id", "primitive", "phase_bin", (F.col("m") / F.col("total")).alias("personal"))
    donors = total.groupBy("primitive").agg(F.count(F.lit(1)).alias("donors"))
    every = own.groupBy("primitive", "phase_bin").agg(F.sum("personal").alias("s"))
    spine = total.select("subject_id", "primitive").join(every, "primitive").join(donors, "primitive").join(days, ["subject_id", "primitive"])
    both = spine.join(own, ["subject_id", "primitive", "phase_bin"], "left").withColumn("personal", F.coalesce("personal", F.lit(0.0)))
    others = F.when(F.col("donors") > 1, (F.col("s") - F.col("personal")) / (F.col("donors") - 1))
    w = F.col("days") / (F.col("days") + LEAN_DAYS)
    return both.select("subject_id", "primitive", "phase_bin", "personal", others.alias("population"), F.when(others.isNull(), F.col("personal")).otherwise(w * F.col("personal") + (1 - w) * others).alias("blend"))


def repaired_days(bins: DataFrame, cut: DataFrame, template: DataFrame, name: str = "phaseguard") -> DataFrame:
    """Days of masked views repaired from a template: ``observed_value``, ``repaired_value``, ``abstention``.

    ``bins``: the view's half hours; ``cut``: ``view_id``, ``seed``, ``phase_bin``,
    ``deleted_units``, ``deleted_sum``. An additive day is what is observed and, of
    each half hour, the template times the share deleted; a rate is that sum over
    observed and filled units. ``abstention``: missing_template (a half hour that
    lost readings has none), timing_needs_events (a time of day isn't filled from
    values) or null.
    """
    seeds = cut.select("view_id", "seed").distinct()
    each = seeds.join(bins, "view_id").join(cut, ["view_id", "seed", "phase_bin"], "left").na.fill(0, ["deleted_units"]).na.fill(0.0, ["deleted_sum"])
    target = F.least(F.col("elapsed"), F.lit(LAST_DAY + 1))
    keys = ["subject_id", "primitive", "phase_bin", "target"]
    both = each.withColumn("target", target).join(template.select(*keys, F.col(name).alias("template")), keys, "left")
    hit = F.col("deleted_units") > 0
    share = F.col("deleted_units") / F.col("units")
    kind = F.first("kind")
    sums = both.groupBy("view_id", "seed", "subject_id", "primitive").agg(
        kind.alias("kind"), F.sum(F.col("numerator") - F.col("deleted_sum")).alias("s"), F.sum(F.col("units") - F.col("deleted_units")).alias("n"), F.count_if(hit & F.col("template").isNull()).alias("without"),
        F.sum(F.when(hit, F.col("template") * share)).alias("added"), F.sum(F.when(hit, F.col("template") * F.col("deleted_units"))).alias("rated"), F.sum("deleted_units").alias("filled"),
    )
    why = F.when(F.col("kind") == "timing", "timing_needs_events").when(F.col("without") > 0, "missing_template")
    observed = F.when(F.col("kind") == "additive", F.col("s")).when(F.col("n") > 0, F.col("s") / F.col("n"))
    value = F.when(F.col("kind") == "additive", F.col("s") + F.col("added")).otherwise((F.col("s") + F.col("rated")) / (F.col("n") + F.col("filled")))
    return sums.select("view_id", "seed", "subject_id", "primitive", F.when(F.col("kind") != "timing", observed).alias("observed_value"), F.when(why.isNull(), value).alias("repaired_value"), why.alias("abstention"))


def repaired_times(bins: DataFrame, cut: DataFrame, shares: DataFrame, q: float = 0.9) -> DataFrame:
    """The time of day of masked timing views, from the events left and the deleted mass laid where events usually are.

    ``shares``: ``event_distributions``. Each half hour's retained mass stays in
    its middle; the deleted mass is spread over the half hours that lost
    readings, by their share of the blend. Null without any mass.
    """
    seeds = cut.select("view_id", "seed").distinct()
    each = seeds.join(bins.where("kind = 'timing'"), "view_id").join(cut, ["view_id", "seed", "phase_bin"], "left").na.fill(0, ["deleted_units"]).na.fill(0.0, ["deleted_sum"])
    both = each.join(shares.select("subject_id", "primitive", "phase_bin", "blend"), ["subject_id", "primitive", "phase_bin"], "left")
    w = Window.partitionBy("view_id", "seed")
    hit = F.when(F.col("deleted_units") > 0, F.coalesce("blend", F.lit(0.0))).otherwise(0.0)
    lost = F.sum("deleted_sum").over(w)
    moved = both.withColumn("mass", F.col("numerator") - F.col("deleted_sum") + F.when(F.sum(hit).over(w) > 0, lost * hit / F.sum(hit).over(w)).otherwise(0.0)).where("mass > 0")
    run = moved.withColumns({"upto": F.sum("mass").over(w.orderBy("phase_bin")), "all": F.sum("mass").over(w)})
    return run.where(F.col("upto") >= F.col("all") * (q * (1 - 1e-9))).groupBy("view_id", "seed").agg((F.min("phase_bin") * BIN + BIN / 2).alias("repaired_time"))
