"""What masks of prepared views delete, and what is left of each feature.

Masks come as rows of intervals with a seed. Their spans are merged, so that
nothing is deleted twice, and belong to the view of their participant, day and
primitive. Instants are deleted from a span's start up to before its end;
supports are deleted where they overlap it, touching not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.operators.filling import real_day, real_text
from gapline.operators.intervals import PERIOD, periods_and_gaps
from gapline.operators.primitives import VIEW, coverage_of, values_of
from gapline.sources.tables import each_once
from gapline.staging import join_bounded, materialize, micros

#: What names a mask of a view.
MASK = [*VIEW, "seed", "scenario", "draw"]


def mask_keys(rows: DataFrame) -> DataFrame:
    """One row a mask: its participant and day, from any of its rows that has them, and its primitive, scenario and draw."""
    once = each_once(rows, ["mask_row_id", "seed", "subject_id", "sensor_day_id", "primitive", "scenario", "draw"]).where("seed is not null")
    keys = once.withColumns({"subject_id": real_text("subject_id"), "sensor_day_id": real_day("sensor_day_id")})
    return keys.groupBy("seed").agg(*(F.max(c).alias(c) for c in ("subject_id", "sensor_day_id", "primitive", "scenario", "draw")))


def view_masks(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Masks with the view they belong to; masks of no view are left out. Columns of ``frames``, ``seed``, ``scenario``, ``draw``."""
    return join_bounded(frames, mask_keys(rows), ["subject_id", "sensor_day_id", "primitive"])


def mask_spans(rows: DataFrame) -> DataFrame:
    """Merged spans of each mask: ``seed``, ``m0``, ``m1`` in microseconds. Broken bounds are no spans."""
    spans = periods_and_gaps(rows, ["seed"], "mask_start", "mask_end").where(F.col("span_kind") == PERIOD)
    return spans.select("seed", micros("span_start").alias("m0"), micros("span_end").alias("m1"))


def _timed(framed: DataFrame) -> DataFrame:
    return framed.withColumns({"t0": micros("support_start"), "t1": micros("support_end"), "t": micros("effective_timestamp")})


def deleted_records(framed: DataFrame, masks: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each mask and record that it deletes: ``view_id``, ``seed``, ``record_id``.

    A mask's spans are gathered in its own row (a mask has as many as it was drawn
    with), so that a record is compared once a mask of its view, not once a span.
    """
    gathered = spans.groupBy("seed").agg(F.collect_list(F.struct("m0", "m1")).alias("spans"))
    known = masks.select("view_id", "seed").join(gathered, "seed")
    both = join_bounded(_timed(framed).select("view_id", "record_id", "t", "t0", "t1"), known, ["view_id"])
    instant = F.col("t1") <= F.col("t0")
    hit = F.exists("spans", lambda s: F.when(instant, (F.col("t") >= s["m0"]) & (F.col("t") < s["m1"])).otherwise((F.col("t0") < s["m1"]) & (F.col("t1") > s["m0"])))
    return both.where(hit).select("view_id", "seed", "record_id")


def replayed(framed: DataFrame, masks: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``framed`` that each mask of their view leaves, with the mask's names: what ``values_of`` and ``coverage_of`` take."""
    each = join_bounded(framed, masks.select("view_id", "seed", "scenario", "draw"), ["view_id"])
    return each.join(gone, ["view_id", "seed", "record_id"], "left_anti")


def replay(framed: DataFrame, masks: DataFrame, spans: DataFrame, daily: DataFrame) -> DataFrame:
    """Each mask's feature: ``original_value``, ``masked_value``, coverage after deletion, ``n_deleted``, ``replay_status``.

    ``replay_status``: structurally_unavailable (the view has no value itself),
    abstained_no_event_support (a time of day without any mass left),
    abstained_insufficient_support, or finite.
    """
    gone = materialize(deleted_records(framed, masks, spans), "gone")
    # Read by coverage and by each kind of operation.
    left = materialize(replayed(framed, masks, gone), "left")
    after = coverage_of(left, MASK).join(values_of(left, MASK), MASK, "left").withColumnRenamed("value", "masked_value")
    counts = gone.groupBy("view_id", "seed").agg(F.count(F.lit(1)).alias("n_deleted"))
    out = masks.select(*MASK, "operation").join(after, MASK, "left").join(counts, ["view_id", "seed"], "left").join(daily.select("view_id", F.col("value").alias("original_value")), "view_id", "left")
    timing = F.col("operation") == "evening_p90"
    status = (
        F.when(F.col("original_value").isNull(), "structurally_unavailable").when(F.col("masked_value").isNotNull(), "finite").when(timing, "abstained_no_event_support").otherwise("abstained_insufficient_support")
    )
    return out.select(*MASK, "original_value", "masked_value", F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"), F.coalesce("observed_epochs", F.lit(0)).alias("observed_epochs"), "coverage", "longest_gap_minutes", F.coalesce("censoring", F.lit("unknown")).alias("censoring"), status.alias("replay_status"))


def block_replay(framed: DataFrame, masks: DataFrame, spans: DataFrame) -> DataFrame:
    """Counts and sums that each mask deletes of the counted readings, by prefix sums: no record meets a mask.

    Records and the bounds of spans are ordered together once a view; a bound
    then knows the sums before it, and a span deletes the difference of two. All
    supports of a view are as long, so they start and end in one order, and a
    record under two spans counts once. Result: ``view_id``, ``seed``, ``k``, ``d``, ``dl``
    (number, sum and sum of log(1 + x)), for masks with a span.
    """
    rows = _timed(framed).where("ok").select("view_id", "t", "t0", "t1", "v")
    instant = F.col("t1") <= F.col("t0")
    log = F.log1p(F.when(F.col("v") > -1, F.col("v")))
    part = rows.select("view_id", F.explode(F.array(F.struct(F.lit("a").alias("kind"), F.when(instant, F.col("t")).otherwise(F.col("t0")).alias("at")), F.struct(F.lit("b").alias("kind"), F.when(instant, F.col("t")).otherwise(F.col("t1")).alias("at")))).alias("x"), "v", log.alias("l"), instant.alias("instant"))
    part = part.select("view_id", "x.kind", "x.at", F.lit(1).alias("rank"), "v", "l", F.lit(None).cast("string").alias("seed"), F.lit(None).cast("bigint").alias("m0"))
    asked = join_bounded(spans, masks.select("view_id", "seed", (F.col("coverage_mode") == "event_support").alias("events")), ["seed"])
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    bound = lambda kind, at, rank: asked.select("view_id", F.lit(kind).alias("kind"), F.col(at).alias("at"), rank.alias("rank"), none("double", "v"), none("double", "l"), "seed", "m0")
    # Starts count what ends before them: instants before, supports up to and with the start.
    every = part.unionByName(bound("a", "m1", F.lit(0))).unionByName(bound("b", "m0", F.when(F.col("events"), 2).otherwise(0)))
    run = Window.partitionBy("view_id", "kind").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = every.withColumns({"n": F.count("v").over(run), "s": F.coalesce(F.sum("v").over(run), F.lit(0.0)), "ls": F.coalesce(F.sum("l").over(run), F.lit(0.0))}).where("seed is not null")
    state = F.struct("n", "s", "ls")
    ends = sums.groupBy("view_id", "seed", "m0").agg(F.max(F.when(F.col("kind") == "a", state)).alias("z"), F.max(F.when(F.col("kind") == "b", state)).alias("a"))
    before = F.lag("z").over(Window.partitionBy("view_id", "seed").orderBy("m0"))
    ends = ends.withColumn("p", before).withColumn("from", F.when(F.col("p.n") > F.col("a.n"), F.col("p")).otherwise(F.col("a")))
    return ends.groupBy("view_id", "seed").agg(F.sum(F.greatest(F.col("z.n") - F.col("from.n"), F.lit(0))).alias("k"), F.sum(F.when(F.col("z.n") > F.col("from.n"), F.col("z.s") - F.col("from.s")).otherwise(0.0)).alias("d"), F.sum(F.when(F.col("z.n") > F.col("from.n"), F.col("z.ls") - F.col("from.ls")).otherwise(0.0)).alias("dl"))


def block_values(framed: DataFrame, masks: DataFrame, lost: DataFrame) -> DataFrame:
    """``masked_value`` of sums and means out of ``block_replay``; null where nothing is left."""
    ops = ("binary_load", "binary_active_minutes", "activity_load", "additive_load", "exposure_mean")
    total = framed.where(F.col("ok") & F.col("operation").isin(*ops)).groupBy("view_id").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.log1p("v")).alias("ls"))
    both = masks.where(F.col("operation").isin(*ops)).join(total, "view_id").join(lost, ["view_id", "seed"], "left").na.fill(0, ["k"]).na.fill(0.0, ["d", "dl"])
    left, op = F.col("n") - F.col("k"), F.col("operation")
    value = F.when(op.isin("binary_load", "activity_load"), (F.col("s") - F.col("d")) / left).when(op == "binary_active_minutes", (F.col("s") - F.col("d")) * F.col("p_epoch_minutes")).when(op == "additive_load", (F.col("s") - F.col("d")) * F.col("unit_scale")).otherwise((F.col("ls") - F.col("dl")) / left)
    return both.select("view_id", "seed", F.col("k").alias("n_valid_deleted"), F.when(left > 0, value).alias("masked_value"))


def deletion_audit(framed: DataFrame, masks: DataFrame, gone: DataFrame) -> DataFrame:
    """One row a mask: records of its view, deleted ones, counted ones deleted, and the first and last deleted record's time."""
    rows = framed.select("view_id", "record_id", "ok", "effective_timestamp")
    hit = gone.join(rows, ["view_id", "record_id"]).groupBy("view_id", "seed").agg(F.count(F.lit(1)).alias("n_deleted"), F.count_if("ok").alias("n_valid_deleted"), F.min("effective_timestamp").alias("first_deleted"), F.max("effective_timestamp").alias("last_deleted"))
    total = rows.groupBy("view_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("ok").alias("n_valid"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return masks.select(*MASK).join(total, "view_id", "left").join(hit, ["view_id", "seed"], "left").select(*MASK, zero("n_records"), zero("n_valid"), zero("n_deleted"), zero("n_valid_deleted"), "first_deleted", "last_deleted")


def matched_targets(audit: DataFrame, daily: DataFrame, least_support: float = 0.8) -> DataFrame:
    """How many counted records a matched mask must delete (``k``), whether it can (``reason``), and whether support is high.

    ``reason`` is the first that applies: invalid_reference (no value),
    no_valid_source_contribution, zero_valid_deleted_count,
    infeasible_valid_deleted_count (nothing would be left), or eligible.
    """
    known = audit.join(daily.select("view_id", "value", F.coalesce("coverage", "support_density").alias("support")), "view_id", "left")
    reason = (
        F.when(F.col("value").isNull(), "invalid_reference").when(F.col("n_valid") == 0, "no_valid_source_contribution").when(F.col("n_valid_deleted") == 0, "zero_valid_deleted_count")
        .when(F.col("n_valid_deleted") >= F.col("n_valid"), "infeasible_valid_deleted_count").otherwise("eligible")
    )
    return known.select(*MASK, F.col("n_valid_deleted").alias("k"), "n_valid", reason.alias("reason"), F.coalesce(F.col("support") >= least_support, F.lit(False)).alias("high_support"))


def missing_targets(targets: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should have a target and have none, or have more than one: a complete ledger gives none."""
    have = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return expected.select(*keys).distinct().join(have, keys, "left").where("n is null or n <> 1").select(*keys, F.coalesce("n", F.lit(0)).alias("n_targets"))


def scattered_records(framed: DataFrame, targets: DataFrame, root: str) -> DataFrame:
    """For each eligible target as many counted records as it asks for, drawn without replacement by the hash of seed and record."""
    return _first_k(framed, targets, F.sha2(F.concat_ws("|", F.lit(root), F.col("seed"), F.col("record_id").cast("string")), 256))


def _first_k(rows: DataFrame, targets: DataFrame, *order: Column) -> DataFrame:
    both = join_bounded(rows.where("ok"), targets.where("reason = 'eligible'").select("view_id", "seed", "k"), ["view_id"])
    w = Window.partitionBy("view_id", "seed").orderBy(*order, "record_id")
    return both.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("k")).select("view_id", "seed", "record_id")


def boundary_distances(framed: DataFrame) -> DataFrame:
    """``framed`` with ``distance``: microseconds to the nearest boundary of its view, null in a view without one.

    Flags have a boundary where the value changes between adjacent readings, at
    the later one's time; other features have boundaries at the edges of runs of
    adjacent positive readings. Adjacent readings lie one cadence or less apart,
    or their supports touch; a reading that doesn't count breaks adjacency.
    """
    w = Window.partitionBy("view_id").orderBy("t", "record_id")
    state = F.when(F.col("operation").isin("binary_load", "binary_active_minutes", "activity_load", "charging_onset"), F.col("v")).otherwise((F.col("v") > 0).cast("double"))
    rows = _timed(framed).where("v is not null").withColumns({"state": F.when(F.col("ok"), state)})
    last = rows.withColumns({"q": F.lag("state").over(w), "tq": F.lag("t").over(w), "eq": F.lag("t1").over(w)})
    near = F.when(F.col("t1") > F.col("t0"), F.col("t0") <= F.col("eq")).otherwise(F.col("t") - F.col("tq") <= F.col("cadence_minutes") * F.lit(60_000_000).cast("bigint"))
    change = F.col("state").isNotNull() & F.col("q").isNotNull() & near & (F.col("state") != F.col("q"))
    marked = last.withColumn("edge", F.when(change, F.col("t")))
    down = Window.partitionBy("view_id").orderBy(F.col("t").desc(), F.col("record_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = marked.withColumns({"l": F.last("edge", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "f": F.last("edge", True).over(down)})
    return both.withColumn("distance", F.least(F.col("t") - F.col("l"), F.col("f") - F.col("t"))).drop("q", "tq", "eq", "edge", "l", "f", "state")


def boundary_records(framed: DataFrame, targets: DataFrame, root: str) -> DataFrame:
    """For each eligible target the counted records nearest to a boundary; ties by hash. Views without boundary give nothing."""
    near = boundary_distances(framed).where("distance is not null")
    return _first_k(near, targets, F.col("distance"), F.sha2(F.concat_ws("|", F.lit(root), F.col("seed"), F.col("record_id").cast("string")), 256))


def record_intervals(framed: DataFrame, picked: DataFrame) -> DataFrame:
    """The intervals that delete just the picked records: a microsecond for an instant, the support for others."""
    rows = _timed(framed).select("view_id", "record_id", "t", "t0", "t1")
    instant = F.col("t1") <= F.col("t0")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return picked.join(rows, ["view_id", "record_id"]).select("view_id", "seed", "record_id", at(F.when(instant, F.col("t")).otherwise(F.col("t0"))).alias("mask_start"), at(F.when(instant, F.col("t") + 1).otherwise(F.col("t1"))).alias("mask_end"))


def record_mask_faults(picked: DataFrame, targets: DataFrame, framed: DataFrame) -> DataFrame:
    """One row a target: records picked, repeated, not counted; ``faulty`` unless exactly k counted ones are picked once."""
    hit = picked.join(framed.select("view_id", "record_id", "ok"), ["view_id", "record_id"], "left")
    have = hit.groupBy("view_id", "seed").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("n_distinct"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("n_uncounted"))
    both = targets.where("reason = 'eligible'").select("view_id", "seed", "k").join(have, ["view_id", "seed"], "left").na.fill(0, ["n", "n_distinct", "n_uncounted"])
    return both.withColumn("faulty", (F.col("n") != F.col("k")) | (F.col("n_distinct") != F.col("k")) | (F.col("n_uncounted") > 0))


def mask_geometry(framed: DataFrame, masks: DataFrame, gone: DataFrame) -> DataFrame:
    """Half hours of each mask that deletes something: counted units before (``baseline_units``), after and deleted, and the share deleted."""
    rows = framed.where("ok").select("view_id", "record_id", F.floor(F.col("minute") / 30).cast("int").alias("phase_bin"))
    base = rows.groupBy("view_id", "phase_bin").agg(F.count(F.lit(1)).alias("baseline_units"))
    cut = gone.join(rows, ["view_id", "record_id"]).groupBy("view_id", "seed", "phase_bin").agg(F.count(F.lit(1)).alias("deleted_units"))
    some = cut.select("view_id", "seed").distinct()
    out = some.join(base, "view_id").join(cut, ["view_id", "seed", "phase_bin"], "left").na.fill(0, ["deleted_units"])
    return out.withColumns({"observed_units": F.col("baseline_units") - F.col("deleted_units"), "masked_fraction": F.col("deleted_units") / F.col("baseline_units")})


def critical_geometry(geometry: DataFrame, first: int = 36) -> DataFrame:
    """Units before and after in the evening's half hours of each mask."""
    return geometry.where(F.col("phase_bin") >= first).groupBy("view_id", "seed").agg(F.sum("baseline_units").alias("critical_baseline_units"), F.sum("observed_units").alias("critical_observed_units"))


def view_digests(framed: DataFrame) -> DataFrame:
    """SHA-256 of the readings of each view, in order of time: a view has as many as its day."""
    row = F.concat_ws("|", F.col("record_id").cast("string"), micros("effective_timestamp").cast("string"), F.coalesce(F.round(F.col("v") * 1e6).cast("decimal(38,0)").cast("string"), F.lit("")))
    return framed.groupBy("view_id").agg(F.count(F.lit(1)).alias("n_records"), F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("digest"))


def deletion_digests(digests: DataFrame, masks: DataFrame, spans: DataFrame) -> DataFrame:
    """SHA-256 of what a deletion rests on: the view's digest, its time semantics, and the mask's spans."""
    span = F.concat_ws("-", F.col("m0").cast("string"), F.col("m1").cast("string"))
    listed = spans.groupBy("seed").agg(F.array_join(F.sort_array(F.collect_list(span)), ",").alias("spans"))
    both = masks.select("view_id", "seed", "coverage_mode").join(listed, "seed", "left").join(digests, "view_id", "left")
    return both.select("view_id", "seed", F.sha2(F.concat_ws("|", F.coalesce("digest", F.lit("")), "coverage_mode", F.coalesce("spans", F.lit(""))), 256).alias("deletion_digest"))


def mask_faults(rows: DataFrame) -> DataFrame:
    """One row for each row of a mask that breaks the contract, with the first rule broken.

    Rules: missing_key (participant or day), missing_bound, empty_interval,
    outside_window, wrong_duration (more than a hundredth of a minute off),
    overlaps_earlier (the mask's interval before it ends later).
    """
    columns = ["mask_row_id", "seed", "subject_id", "sensor_day_id", "window_start", "window_end", "mask_start", "mask_end", "mask_duration_minutes"]
    once = each_once(rows, columns)
    w = Window.partitionBy("seed").orderBy("mask_start", "mask_end", "mask_row_id").rowsBetween(Window.unboundedPreceding, -1)
    sound = F.col("mask_start") < F.col("mask_end")
    marked = once.withColumn("reach", F.max(F.when(sound, F.col("mask_end"))).over(w))
    minutes = (micros("mask_end") - micros("mask_start")) / 60_000_000
    rule = (
        F.when(real_text("subject_id").isNull() | real_day("sensor_day_id").isNull(), "missing_key")
        .when(F.col("mask_start").isNull() | F.col("mask_end").isNull(), "missing_bound")
        .when(~sound, "empty_interval")
        .when((F.col("mask_start") < F.col("window_start")) | (F.col("mask_end") > F.col("window_end")), "outside_window")
        .when(F.coalesce(F.abs(F.nanvl("mask_duration_minutes", F.lit(None).cast("double")) - minutes) > 0.01, F.lit(False)), "wrong_duration")
        .when(F.col("reach") > F.col("mask_start"), "overlaps_earlier")
    )
    return marked.select("mask_row_id", "seed", rule.alias("rule")).where("rule is not null")


def standardized_errors(played: DataFrame, scales: DataFrame) -> DataFrame:
    """``error``: how far the masked value lies from the original, in the participant's scale; null and not ``retained`` unless both are finite."""
    both = played.join(scales, ["subject_id", "primitive"], "left")
    ok = (F.col("replay_status") == "finite") & (F.col("standardizer") > 0)
    return both.select(*MASK, "replay_status", F.when(ok, F.abs(F.col("masked_value") - F.col("original_value")) / F.col("standardizer")).alias("error"), F.coalesce(ok, F.lit(False)).alias("retained"))


def confidence_after(played: DataFrame, frames: DataFrame) -> DataFrame:
    """Confidence from what a mask leaves: coverage times what of the window isn't the longest gap, 0 without a finite value or if censored."""
    both = played.join(frames.select("view_id", "expected_epochs", "cadence_minutes"), "view_id")
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    good = ((F.col("masked_value").isNotNull()) & (F.col("censoring") == "none")).cast("double")
    share = unit(F.coalesce("coverage", F.lit(0.0))) * unit(1 - F.coalesce(F.col("longest_gap_minutes"), F.col("expected_epochs") * F.col("cadence_minutes")) / (F.col("expected_epochs") * F.col("cadence_minutes")))
    return both.select(*MASK, (share * good).alias("confidence"))
