"""Days relative to a participant's own past and to all others, and indicators composed of several primitives.

All tables are long: one row for each participant, day and primitive (or
indicator). A fold holds one participant out; its population is made of all others'
rows, so that a row stands in as many folds as there are other participants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.robust import location_scale, weighted_median
from gapline.operators.personal import shrunk
from gapline.staging import join_bounded

DAY = ["subject_id", "sensor_day_id"]
#: Calibration lengths in days, days that a baseline leans on the population, least weight of a personal scale, limit of scores.
CALIBRATIONS, LEAN_DAYS, LEAST_WEIGHT, LIMIT = (3, 7, 14, 21), 7.0, 3.0 - 1e-9, 5.0
METHODS = ("population", "personal", "shrinkage", "placebo")
#: Primitives without coverage of their own.
USAGE = ("usage_load_24h", "usage_disengagement_p90")
#: Indicator, how it is composed, of the score or the raw value, expected sources, and its sources with their sign.
INDICATORS = (
    ("digital_engagement_score", "mean", "z", 2, (("screen_load_24h", 1), ("usage_load_24h", 1))),
    ("digital_disengagement_time", "median", "raw", 2, (("screen_disengagement_p90", 1), ("usage_disengagement_p90", 1))),
    ("physical_activity_score", "mean", "z", 2, (("phone_activity_load_24h", 1), ("step_load_24h", 1))),
    ("physical_disengagement_time", "median", "raw", 2, (("phone_activity_disengagement_p90", 1), ("step_disengagement_p90", 1))),
    ("light_exposure_score", "mean", "z", 2, (("mobile_light_exposure_24h", 1), ("wearable_light_exposure_24h", 1))),
    ("low_light_onset", "median", "raw", 2, (("mobile_low_light_onset", 1), ("wearable_low_light_onset", 1))),
    ("physiological_settling_score", "mean", "z", 2, (("heart_rate_settling_delta", -1), ("heart_rate_settling_slope", -1))),
)
#: Scores that only the deviation from routine needs.
TIMING_SCORES = (
    ("digital_timing_z", "mean", "z", 2, (("screen_disengagement_p90", 1), ("usage_disengagement_p90", 1))),
    ("physical_timing_z", "mean", "z", 2, (("phone_activity_disengagement_p90", 1), ("step_disengagement_p90", 1))),
    ("low_light_z", "mean", "z", 2, (("mobile_low_light_onset", 1), ("wearable_low_light_onset", 1))),
    ("charging_z", "mean", "z", 1, (("charging_onset", 1),)),
)
ROUTINE = ("digital_engagement_score", "digital_timing_z", "physical_activity_score", "physical_timing_z", "light_exposure_score", "low_light_z", "physiological_settling_score", "charging_z")
WINDDOWN = ("digital_disengagement_time", "physical_disengagement_time", "low_light_onset", "charging_raw")


def confidences(daily: DataFrame, definitions: DataFrame, usage: str = "unweighted") -> DataFrame:
    """``daily`` with ``confidence`` (coverage, gap, validity and censoring), ``coverage_only``, ``value_only`` and ``unweighted``.

    Usage has no coverage: under ``unweighted`` it is as sure as its value is
    valid; under ``screen`` it takes the confidence of the screen's primitive of
    the same day, 0 without one.
    """
    sizes = definitions.select("primitive", (F.col("expected_epochs") * F.col("cadence_minutes")).alias("minutes"))
    rows = join_bounded(daily, sizes, ["primitive"])
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    valid = (F.col("value").isNotNull() & (F.col("status") == "observed")).cast("double")
    open_ = (F.col("censoring") == "none").cast("double")
    covered = unit(F.coalesce("coverage", F.lit(0.0)))
    whole = unit(1 - F.coalesce(F.col("longest_gap_minutes"), F.col("minutes").cast("double")) / F.col("minutes"))
    own = covered * whole * valid * open_
    is_usage = F.col("primitive").isin(*USAGE)
    if usage == "unweighted":
        sure, cover = F.when(is_usage, valid).otherwise(own), F.when(is_usage, valid).otherwise(covered * valid)
    else:
        kind = F.when(F.col("primitive").endswith("p90"), "p90").otherwise("load")
        rows = rows.withColumns({"__kind": kind, "__screen": F.when(F.col("primitive").isin("screen_load_24h", "screen_disengagement_p90"), covered * whole)})
        proxy = F.coalesce(F.max("__screen").over(Window.partitionBy(*DAY, "__kind")), F.lit(0.0))
        sure, cover = F.when(is_usage, proxy * valid * open_).otherwise(own), F.when(is_usage, proxy * valid).otherwise(covered * valid)
    return rows.withColumns({"confidence": sure, "coverage_only": cover, "value_only": valid, "unweighted": valid * open_}).drop("minutes", "__kind", "__screen")


def personal_estimates(rows: DataFrame, calibrations: tuple[int, ...] = CALIBRATIONS) -> DataFrame:
    """Weighted median and MAD of each participant's first ``k`` days, for each k and primitive: ``pc``, ``ps``, ``n_eff``, ``n_rows``.

    ``rows``: ``subject_id``, ``primitive``, ``elapsed``, ``value``, ``confidence``.
    """
    each = rows.withColumn("k", F.explode(F.array(*map(F.lit, calibrations)))).where(F.col("elapsed").between(1, F.col("k")))
    out = location_scale(each, ["subject_id", "primitive", "k"], "value", "confidence")
    return out.withColumnsRenamed({"center": "pc", "scale": "ps"})


def population_estimates(rows: DataFrame) -> DataFrame:
    """Weighted median and MAD of all other participants' rows, for each participant and primitive: ``held_out``, ``oc``, ``os``."""
    folds = rows.select("primitive", F.col("subject_id").alias("held_out")).distinct()
    trained = rows.join(folds, "primitive").where(F.col("held_out") != F.col("subject_id"))
    out = location_scale(trained, ["held_out", "primitive"], "value", "confidence")
    return out.select("held_out", "primitive", F.col("center").alias("oc"), F.col("scale").alias("os"))


def baseline_grid(rows: DataFrame, calibrations: tuple[int, ...] = CALIBRATIONS) -> DataFrame:
    """``center``, ``scale`` and ``basis`` for each participant, primitive, k and method.

    population: all others. personal: the own calibration, where its weight and
    scale allow, else the population (basis population_fallback). shrinkage: own
    weight n / (n + 7). placebo: the personal calibration of the next participant
    in order that has one (null without any other).
    """
    others = population_estimates(rows).withColumnRenamed("held_out", "subject_id")
    grid = others.withColumn("k", F.explode(F.array(*map(F.lit, calibrations))))
    own = personal_estimates(rows, calibrations)
    ring = Window.partitionBy("primitive", "k").orderBy("subject_id")
    donors = own.withColumns({"d_c": F.coalesce(F.lead("pc").over(ring), F.first("pc").over(ring)), "d_s": F.coalesce(F.lead("ps").over(ring), F.first("ps").over(ring)), "d_id": F.coalesce(F.lead("subject_id").over(ring), F.first("subject_id").over(ring))})
    both = grid.join(donors, ["subject_id", "primitive", "k"], "left")
    n = F.coalesce("n_eff", F.lit(0.0))
    able = F.coalesce((F.col("n_eff") >= LEAST_WEIGHT) & (F.col("ps") > 0), F.lit(False))
    center, scale = shrunk(F.col("pc"), F.coalesce(F.col("ps"), F.col("os")), F.col("oc"), F.col("os"), n, LEAN_DAYS)
    other = F.coalesce(F.col("d_id") != F.col("subject_id"), F.lit(False))
    method = lambda name, c, s, basis: F.struct(F.lit(name).alias("method"), c.alias("center"), s.alias("scale"), basis.alias("basis"))
    rows_ = F.array(
        method("population", F.col("oc"), F.col("os"), F.lit("population")),
        method("personal", F.when(able, F.col("pc")).otherwise(F.col("oc")), F.when(able, F.col("ps")).otherwise(F.col("os")), F.when(able, "personal").otherwise("population_fallback")),
        method("shrinkage", center, scale, F.when(n > 0, "shrinkage").otherwise("population_fallback")),
        method("placebo", F.when(other, F.col("d_c")), F.when(other, F.col("d_s")), F.when(other, "placebo").otherwise("no_donor")),
    )
    return both.select("subject_id", "primitive", "k", F.explode(rows_).alias("x")).select("subject_id", "primitive", "k", "x.*")


def scored(rows: DataFrame, grid: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``rows`` under each baseline of ``grid``: ``z``, cut to the limit, and ``z_uncut``; null where the scale isn't positive."""
    both = rows.join(grid, ["subject_id", "primitive"])
    z = F.when(F.col("scale") > 0, (F.col("value") - F.col("center")) / F.col("scale"))
    return both.withColumn("z_uncut", z).withColumn("z", F.when(F.col("z_uncut").isNotNull(), F.greatest(F.least(F.col("z_uncut"), F.lit(limit)), F.lit(-limit))))


def dual_coordinates(rows: DataFrame, grid: DataFrame, k: int = 14) -> DataFrame:
    """Each value on two scales: ``reference_z`` (distance from the own center in the population's scale) and ``self_z`` (in the own scale)."""
    own = grid.where((F.col("k") == k) & (F.col("method") == "shrinkage")).select("subject_id", "primitive", "center", "scale")
    pop = grid.where((F.col("k") == k) & (F.col("method") == "population")).select("subject_id", "primitive", F.col("scale").alias("reference_scale"))
    both = rows.join(own, ["subject_id", "primitive"]).join(pop, ["subject_id", "primitive"])
    cut = lambda c: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(LIMIT)), F.lit(-LIMIT)))
    ref = F.when(F.col("reference_scale") > 0, (F.col("value") - F.col("center")) / F.col("reference_scale"))
    own_z = F.when(F.col("scale") > 0, (F.col("value") - F.col("center")) / F.col("scale"))
    return both.select(*DAY, "primitive", cut(ref).alias("reference_z"), cut(own_z).alias("self_z"))


def _composed(parts: DataFrame, by: list[str]) -> DataFrame:
    """Indicators out of their sources: ``by``, ``indicator``, ``how``, ``expected``, ``x``, ``w``."""
    ok = parts.where(F.col("x").isNotNull() & (F.abs("x") < float("inf")) & (F.col("w") > 0))
    keys = [*by, "indicator"]
    sums = ok.groupBy(*keys, "how", "expected").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"), F.sqrt(F.sum(F.col("x") * F.col("x") * F.col("w")) / F.sum("w")).alias("rms"), F.sum("w").alias("sw"), F.count(F.lit(1)).alias("n_sources"))
    middle = weighted_median(ok.where("how = 'median'"), keys, "x", "w", "middle")
    value = F.when(F.col("how") == "mean", F.col("mean")).when(F.col("how") == "rms", F.col("rms")).otherwise(F.col("middle"))
    return sums.join(middle, keys, "left").select(*keys, value.alias("value"), F.least(F.col("sw") / F.col("expected"), F.lit(1.0)).alias("confidence"), "n_sources")


def composed_indicators(rows: DataFrame, by: list[str] = DAY, indicators=INDICATORS) -> DataFrame:
    """The ten indicators of each day that has a source for them: ``by``, ``indicator``, ``value``, ``confidence``, ``n_sources``.

    ``rows``: ``by``, ``primitive``, ``value``, ``z``, ``confidence``. Sources without value or
    confidence don't count. Beside those of ``INDICATORS``: ``winddown_center`` (weighted
    median of four times), ``winddown_spread`` (weighted median distance from it,
    with two sources at least) and ``routine_deviation`` (root of the weighted
    mean square of eight scores).
    """
    spark = rows.sparkSession
    listed = [(name, how, part, expected, p, float(sign)) for name, how, part, expected, sources in (*indicators, *TIMING_SCORES) for p, sign in sources]
    table = spark.createDataFrame(listed, "indicator string, how string, part string, expected int, primitive string, sign double")
    parts = rows.join(F.broadcast(table), "primitive").withColumns({"x": F.when(F.col("part") == "z", F.col("z")).otherwise(F.col("value")) * F.col("sign"), "w": F.col("confidence")})  # a fixed list
    first = _composed(parts, by)
    charging = rows.where("primitive = 'charging_onset'").select(*by, F.lit("charging_raw").alias("indicator"), F.col("value"), "confidence", F.lit(1).cast("bigint").alias("n_sources"))
    times = first.unionByName(charging).where(F.col("indicator").isin(*WINDDOWN)).select(*by, F.col("value").alias("x"), F.col("confidence").alias("w"))
    wind = lambda name, how: times.select(*by, F.lit(name).alias("indicator"), F.lit(how).alias("how"), F.lit(4).alias("expected"), "x", "w")
    center = _composed(wind("winddown_center", "median"), by)
    off = wind("winddown_spread", "median").join(center.select(*by, F.col("value").alias("c")), by).withColumn("x", F.abs(F.col("x") - F.col("c"))).drop("c")
    spread = _composed(off, by).where("n_sources >= 2")
    routine = first.where(F.col("indicator").isin(*ROUTINE)).select(*by, F.lit("routine_deviation").alias("indicator"), F.lit("rms").alias("how"), F.lit(8).alias("expected"), F.col("value").alias("x"), F.col("confidence").alias("w"))
    out = first.where(F.col("indicator").isin(*(i[0] for i in indicators)))
    return out.unionByName(center).unionByName(spread).unionByName(_composed(routine, by))


def without_each_source(rows: DataFrame, by: list[str] = DAY) -> DataFrame:
    """How much each two-source indicator changes without one of its sources: ``indicator``, ``dropped``, ``value``, ``value_without``."""
    spark = rows.sparkSession
    listed = [(name, how, part, expected, p, float(sign), q) for name, how, part, expected, sources in INDICATORS if len(sources) == 2 for p, sign in sources for q, _ in sources if q != p]
    table = spark.createDataFrame(listed, "indicator string, how string, part string, expected int, primitive string, sign double, dropped string")
    both = rows.join(F.broadcast(table), "primitive").withColumns({"x": F.when(F.col("part") == "z", F.col("z")).otherwise(F.col("value")) * F.col("sign"), "w": F.col("confidence")})  # a fixed list
    left = _composed(both, [*by, "dropped"]).select(*by, "indicator", "dropped", F.col("value").alias("value_without"))
    whole = composed_indicators(rows, by).select(*by, "indicator", "value", "n_sources")
    return left.join(whole, [*by, "indicator"]).where("n_sources = 2").select(*by, "indicator", "dropped", "value", "value_without")


def future_oracles(rows: DataFrame, first: int = 22) -> DataFrame:
    """Center and scale of each participant's days from ``first`` on, by primitive: what a calibration should have foretold."""
    out = location_scale(rows.where(F.col("elapsed") >= first), ["subject_id", "primitive"], "value", "confidence")
    return out.select("subject_id", "primitive", F.col("center").alias("later_center"), F.col("scale").alias("later_scale"), "n_rows")


def transfer_errors(grid: DataFrame, oracles: DataFrame) -> DataFrame:
    """How far each baseline lies from the later days, in the population's scale, and by the log ratio of the scales, half each."""
    pop = grid.where("method = 'population'").select("subject_id", "primitive", "k", F.col("scale").alias("s_pop"))
    both = grid.join(oracles, ["subject_id", "primitive"]).join(pop, ["subject_id", "primitive", "k"])
    ok = (F.col("s_pop") > 0) & (F.col("scale") > 0) & (F.col("later_scale") > 0)
    error = 0.5 * F.abs(F.col("center") - F.col("later_center")) / F.col("s_pop") + 0.5 * F.abs(F.log(F.col("scale") / F.col("later_scale")))
    return both.select("subject_id", "primitive", "k", "method", F.when(ok, error).alias("transfer_error"))


def rolled_up(errors: DataFrame, domains: Column, value: str = "transfer_error") -> DataFrame:
    """Primitive to domain to participant to all: means of means, so that each participant weighs the same. ``level``, ``n``, ``mean_error``."""
    rows = errors.where(F.col(value).isNotNull()).withColumn("domain", domains)
    domain = rows.groupBy("subject_id", "k", "method", "domain").agg(F.avg(value).alias("v"))
    person = domain.groupBy("subject_id", "k", "method").agg(F.avg("v").alias("v"))
    return person.groupBy("k", "method").agg(F.count(F.lit(1)).alias("n_participants"), F.avg("v").alias("mean_error"))


def feature_patches(rows: DataFrame, masked: DataFrame, grid: DataFrame, k: int = 14, method: str = "shrinkage") -> DataFrame:
    """What a masked value changes: its own score, and no other. ``seed``, ``view_id``, ``primitive``, ``z``, ``z_masked``, ``changed``.

    ``masked``: ``view_id``, ``seed``, ``masked_value``. The reference row stays; ``apply_patches`` lays the changes over it.
    """
    base = scored(rows, grid.where((F.col("k") == k) & (F.col("method") == method)))
    both = masked.join(base.select("view_id", *DAY, "primitive", "center", "scale", "z", "confidence"), "view_id")
    new = F.when((F.col("scale") > 0) & F.col("masked_value").isNotNull(), F.greatest(F.least((F.col("masked_value") - F.col("center")) / F.col("scale"), F.lit(LIMIT)), F.lit(-LIMIT)))
    return both.select("view_id", "seed", *DAY, "primitive", "masked_value", "z", new.alias("z_masked"), "confidence", (~new.eqNullSafe(F.col("z"))).alias("changed"))


def patched_indicators(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Indicators of each mask's day with its patch laid over the reference row: only those that the patched primitive feeds.

    ``rows``: scored reference rows. ``seed``, ``indicator``, ``value``, ``patched_value``.
    """
    seeds = patches.select("seed", *DAY).distinct()
    laid = seeds.join(rows.select(*DAY, "primitive", "value", "z", "confidence"), DAY).join(patches.select("seed", "primitive", "masked_value", "z_masked", F.lit(True).alias("hit")), ["seed", "primitive"], "left")
    hit = F.coalesce("hit", F.lit(False))
    now = laid.select("seed", *DAY, "primitive", F.when(hit, F.col("masked_value")).otherwise(F.col("value")).alias("value"), F.when(hit, F.col("z_masked")).otherwise(F.col("z")).alias("z"), "confidence")
    new = composed_indicators(now, ["seed", *DAY]).select("seed", *DAY, "indicator", F.col("value").alias("patched_value"))
    old = composed_indicators(laid.select("seed", *DAY, "primitive", "value", "z", "confidence"), ["seed", *DAY]).select("seed", *DAY, "indicator", "value")
    return old.join(new, ["seed", *DAY, "indicator"], "full").where(~F.col("value").eqNullSafe(F.col("patched_value")))


def calibration_under_masks(rows: DataFrame, played: DataFrame, k: int = 14) -> DataFrame:
    """How far masks of calibration days move a participant's center: ``subject_id``, ``primitive``, ``scenario``, ``draw``, ``center``, ``masked_center``, ``n_masked``.

    ``played``: ``view_id``, ``scenario``, ``draw``, ``masked_value`` (null: the day drops out). Each scenario and
    draw that masks a day of the calibration estimates it anew, with all its other days as they are.
    """
    days = rows.where(F.col("elapsed").between(1, k) & F.col("value").isNotNull() & (F.col("confidence") > 0)).select("view_id", "subject_id", "primitive", "value", "confidence")
    hit = days.select("view_id", "subject_id", "primitive").join(played.select("view_id", "scenario", "draw", "masked_value"), "view_id")
    once = hit.groupBy("view_id", "subject_id", "primitive", "scenario", "draw").agg(F.max("masked_value").alias("masked_value"))
    runs = once.groupBy("subject_id", "primitive", "scenario", "draw").agg(F.count(F.lit(1)).alias("n_masked"))
    each = runs.join(days, ["subject_id", "primitive"]).join(once.select("view_id", "scenario", "draw", "masked_value", F.lit(True).alias("hit")), ["view_id", "scenario", "draw"], "left")
    now = each.withColumn("value", F.when(F.coalesce("hit", F.lit(False)), F.col("masked_value")).otherwise(F.col("value")))
    keys = ["subject_id", "primitive", "scenario", "draw"]
    new = weighted_median(now, keys, "value", "confidence", "masked_center")
    old = weighted_median(days, ["subject_id", "primitive"], "value", "confidence", "center")
    return runs.join(old, ["subject_id", "primitive"]).join(new, keys, "left").select(*keys, "center", "masked_center", "n_masked")


#: Primitives of one behaviour seen by two sensors.
PAIRS = (("screen_load_24h", "usage_load_24h"), ("screen_disengagement_p90", "usage_disengagement_p90"), ("phone_activity_load_24h", "step_load_24h"), ("mobile_light_exposure_24h", "wearable_light_exposure_24h"), ("mobile_low_light_onset", "wearable_low_light_onset"))


def pair_days(coordinates: DataFrame, column: str = "reference_z", pairs=PAIRS) -> DataFrame:
    """Days on which both primitives of a pair have a coordinate: ``left``, ``right``, ``discrepancy`` and ``same_sign``."""
    table = coordinates.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, left string, right string")
    known = coordinates.where(F.col(column).isNotNull()).select(*DAY, "primitive", F.col(column).alias("c"))
    left = known.join(F.broadcast(table.select("pair", F.col("left").alias("primitive"))), "primitive").select(*DAY, "pair", F.col("primitive").alias("left"), F.col("c").alias("a"))  # a fixed list
    right = known.join(F.broadcast(table.select("pair", F.col("right").alias("primitive"))), "primitive").select(*DAY, "pair", F.col("primitive").alias("right"), F.col("c").alias("b"))  # a fixed list
    return left.join(right, [*DAY, "pair"]).select(*DAY, "left", "right", F.abs(F.col("a") - F.col("b")).alias("discrepancy"), (F.signum("a") == F.signum("b")).alias("same_sign"))


#: Blocks of columns that each arm of an outcome model has.
ARMS = {
    "calendar": ("calendar",), "quality": ("calendar", "quality"), "raw": ("calendar", "quality", "raw"), "population": ("calendar", "quality", "population"), "personal": ("calendar", "quality", "shrinkage"),
    "composed": ("calendar", "quality", "composed"),
}


def arm_features(blocks: dict[str, DataFrame], arm: str) -> DataFrame:
    """The features of one arm as rows: ``subject_id``, ``sensor_day_id``, ``feature``, ``x``. ``blocks``: each block's rows of the same shape."""
    out = None
    for name in ARMS[arm]:
        part = blocks[name].select(*DAY, F.concat(F.lit(f"{name}__"), "feature").alias("feature"), F.col("x").cast("double").alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


def fold_safe_grid(rows: DataFrame, outer: str, calibrations: tuple[int, ...] = CALIBRATIONS) -> DataFrame:
    """``baseline_grid`` of all participants without ``outer`` in any population or donor, and of ``outer`` against all others: nothing of the held-out one reaches what it is judged by."""
    inner = baseline_grid(rows.where(F.col("subject_id") != outer), calibrations)
    return inner.unionByName(baseline_grid(rows, calibrations).where(F.col("subject_id") == outer))
