"""Deleted readings filled from the same day's retained ones, or from other days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def neighbours(df: DataFrame, keys: list[str], time: str, kept: str) -> DataFrame:
    """``before``, ``before_time``, ``after``, ``after_time``: the nearest retained value strictly before and after each reading.

    ``kept`` is the value where it was retained, else null. A filled value is
    never a donor of another. Ties of time are ordered by ``event_id``.
    """
    up = Window.partitionBy(*keys).orderBy(time, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    donor = F.when(F.col(kept).isNotNull(), F.struct(F.col(time).alias("t"), F.col(kept).alias("v")))
    out = df.withColumns({"__b": F.last(donor, True).over(up), "__a": F.last(donor, True).over(down)})
    return out.withColumns({"before": F.col("__b.v"), "before_time": F.col("__b.t"), "after": F.col("__a.v"), "after_time": F.col("__a.t")}).drop("__b", "__a")


def majority(kept: Column) -> Column:
    """1 if more than half of the values are 1, else 0: a tie is 0."""
    return F.when(F.avg(kept) > 0.5, 1.0).otherwise(0.0)


def repaired(df: DataFrame, keys: list[str], time: str, value: str, target: str, method: str, cap: float | None = None, binary: bool = False) -> DataFrame:
    """``repaired`` for each reading: its value, or where ``target`` is true one from the retained readings of its cell.

    ``method``: mean (binary: majority), median, locf (the value before, within
    ``cap``; else the mean), linear (between the values before and after, weighted
    by time; never beyond them; else the mean). Median and linear don't apply to
    binary values. A reading without value that is no target stays null, and all
    stay null in a cell that retains none. ``repair_kind`` is kept, natural_gap,
    filled, fallback or unresolved.
    """
    if binary and method in ("median", "linear"):
        raise ValueError(f"{method} doesn't apply to binary values")
    kept = F.when(~F.col(target), F.col(value))
    rows = df.withColumn("__kept", kept)
    stats = rows.groupBy(*keys).agg((majority(F.col("__kept")) if binary else F.avg("__kept")).alias("__mean"), F.median("__kept").alias("__median"), F.count("__kept").alias("__n"))
    out = neighbours(rows, keys, time, "__kept").join(stats, keys)
    mean = F.when(F.col("__n") > 0, F.col("__mean"))
    if method == "mean":
        own = F.lit(None).cast("double")
    elif method == "median":
        own = F.col("__median")
    elif method == "locf":
        own = F.when(F.col(time) - F.col("before_time") <= (cap if cap is not None else float("inf")), F.col("before"))
    elif method == "linear":
        share = (F.col(time) - F.col("before_time")) / (F.col("after_time") - F.col("before_time"))
        own = F.when(F.col("after_time") > F.col("before_time"), F.col("before") + share * (F.col("after") - F.col("before")))
    else:
        raise ValueError(method)
    filled = F.coalesce(own, mean)
    kind = F.when(~F.col(target), F.when(F.col(value).isNull(), "natural_gap").otherwise("kept")).when(filled.isNull(), "unresolved").when(own.isNotNull() | F.lit(method == "mean"), "filled").otherwise("fallback")
    return out.withColumns({"repaired": F.when(F.col(target), filled).otherwise(F.col(value)), "repair_kind": kind}).drop("__kept", "__mean", "__median", "__n", "before", "before_time", "after", "after_time")


def day_profiles(df: DataFrame, subject: str, day: str, minute: str, value: str, slot: int = 30) -> DataFrame:
    """The mean, median and number of values of each slot of each day: the first of two stages, so that busy days don't dominate."""
    rows = df.where(F.col(value).isNotNull()).withColumn("slot", F.floor(F.col(minute) / slot).cast("int"))
    return rows.groupBy(subject, day, "slot").agg(F.avg(value).alias("slot_mean"), F.median(value).alias("slot_median"), F.count(value).alias("slot_n"))


def other_days(profiles: DataFrame, subject: str, day: str, least_days: int = 2) -> DataFrame:
    """For each day and slot the mean over the participant's other days, out of sums less the day's own part.

    Null (no row) where fewer than ``least_days`` other days have the slot. No day
    is paired with another.
    """
    all_days = profiles.groupBy(subject, "slot").agg(F.sum("slot_mean").alias("__s"), F.count(F.lit(1)).alias("__n"))
    spine = profiles.select(subject, day).distinct().join(all_days, subject)
    own = spine.join(profiles.select(subject, day, "slot", "slot_mean"), [subject, day, "slot"], "left")
    n = F.col("__n") - F.when(F.col("slot_mean").isNotNull(), 1).otherwise(0)
    return own.where(n >= least_days).select(subject, day, "slot", ((F.col("__s") - F.coalesce("slot_mean", F.lit(0.0))) / n).alias("donor_mean"), n.alias("donor_days"))


def recent_days(profiles: DataFrame, subject: str, day: str, half_life: float = 7.0, least_days: int = 2) -> DataFrame:
    """For each day that has a slot, the mean over earlier days, each weighing half as much for every half life of its age.

    A running sum does it: each day's weight is 2 ** (age / half life) of a fixed
    day, which cancels out of the quotient.
    """
    age = F.datediff(F.col(day), F.lit("2000-01-01").cast("date"))
    w = Window.partitionBy(subject, "slot").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(age).over(Window.partitionBy(subject, "slot"))
    weight = F.pow(F.lit(2.0), (age - first) / half_life)
    rows = profiles.withColumn("__w", weight)
    out = rows.withColumns({"__sw": F.sum("__w").over(w), "__swv": F.sum(F.col("__w") * F.col("slot_mean")).over(w), "past_days": F.count(F.lit(1)).over(w)})
    return out.where(F.col("past_days") >= least_days).select(subject, day, "slot", (F.col("__swv") / F.col("__sw")).alias("recent_mean"), "past_days")


#: Methods that fill from other days. Medians don't apply to binary values.
CROSS_DAY = ("all_day", "time_mean", "time_median", "weektype_mean", "weektype_median", "past_time_mean", "past_recent_mean", "similar_copy")


def _without_own(rows: DataFrame, keys: list[str], value: str, name: str, median: bool = False) -> DataFrame:
    """``rows`` with ``name`` and ``name``_n: the mean or median of ``value`` over the other rows of the group, and their number.

    The mean is the sum less the own part; the median follows from the own rank
    and the middle values of the group. A row without value has no own part.
    """
    group = Window.partitionBy(*keys)
    own = F.col(value).isNotNull()
    if not median:
        n = F.count(value).over(group) - own.cast("int")
        total = F.sum(value).over(group) - F.coalesce(F.col(value), F.lit(0.0))
        return rows.withColumns({name: F.when(n > 0, total / n), f"{name}_n": n})
    ranked = rows.withColumns({"__r": F.when(own, F.row_number().over(group.orderBy(F.col(value).asc_nulls_last()))), "__c": F.count(value).over(group)})
    n = F.col("__c") - own.cast("int")
    out = ranked
    for i, k in enumerate((F.floor((n + 1) / 2), F.floor(n / 2) + 1)):
        out = out.withColumn(f"__k{i}", k + (own & (F.col("__r") <= k)).cast("int"))
    # The ranks asked for lie within one of the middle: four values a group.
    for j in range(4):
        out = out.withColumn(f"__m{j}", F.max(F.when(F.col("__r") == F.floor(F.col("__c") / 2) + j - 1, F.col(value))).over(group))
    at = lambda i: F.coalesce(*[F.when(F.col(f"__k{i}") == F.floor(F.col("__c") / 2) + j - 1, F.col(f"__m{j}")) for j in range(4)])
    out = out.withColumns({name: F.when(n > 0, (at(0) + at(1)) / 2), f"{name}_n": n})
    return out.drop("__r", "__c", "__k0", "__k1", *[f"__m{j}" for j in range(4)])


def _earlier(rows: DataFrame, keys: list[str], day: str, value: str, name: str, half_life: float | None = None) -> DataFrame:
    """``rows`` with ``name`` and ``name``_n: the mean of ``value`` over the group's earlier days, by half life of age if given."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    age = F.datediff(F.col(day), F.lit("2000-01-01").cast("date"))
    rows = rows.withColumn("__w", F.when(F.col(value).isNotNull(), F.pow(F.lit(2.0), (age - F.min(age).over(Window.partitionBy(*keys))) / half_life) if half_life else F.lit(1.0)))
    return rows.withColumns({name: F.sum(F.col("__w") * F.col(value)).over(w) / F.sum("__w").over(w), f"{name}_n": F.count(value).over(w)}).drop("__w")


def cross_day(
    df: DataFrame, subject: str, day: str, minute: str, value: str, target: str, *, binary: bool = False, profile_log: bool = False, slot: int = 30, least_days: int = 2, half_life: float = 7.0, similar_slots: int = 12, similar_share: float = 0.5, cadence: float = 30.0
) -> DataFrame:
    """Each target reading, filled from the participant's other days by each of ``CROSS_DAY``: ``event_id``, ``method``, ``repaired``, ``repair_tier``, ``donors``.

    ``repair_tier``: 1 the method's own value; 2 the slot's mean or median over all other
    days (methods of week types and copies); 3 the mean of other days' means (of
    earlier days for methods of the past); 4 the mean of what the target's day
    retains; null where none of them has a value. Estimates of slots and days need
    ``least_days``. Copies come from the day most like what the target's day
    retains, from the nearest reading within half a cadence, at a tie the earlier.
    Binary values are 1 above 0.5, else 0. ``donors``: days behind the value.
    """
    clean = df.withColumn("__v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
    rows = clean.select("event_id", F.col(subject).alias("s"), F.col(day).alias("d"), F.col(minute).alias("m"), F.col("__v").alias("v"), F.coalesce(F.col(target), F.lit(False)).alias("gone")).withColumn("slot", F.floor(F.col("m") / slot).cast("int"))
    asked = rows.where("gone").select("event_id", "s", "d", "m", "slot")
    like = F.log1p("v") if profile_log else F.col("v")
    weekend = F.weekday("d") >= 5

    # Slots: those asked for without a reading of their own day are there without value.
    profiles = rows.where("v is not null").groupBy("s", "d", "slot").agg(F.avg("v").alias("mean"), F.median("v").alias("mid"), F.avg(like).alias("like"))
    slots = profiles.join(asked.select("s", "d", "slot").distinct(), ["s", "d", "slot"], "full").withColumn("weekend", weekend)
    slots = _without_own(slots, ["s", "slot"], "mean", "all_mean")
    slots = _without_own(slots, ["s", "slot", "weekend"], "mean", "week_mean")
    if not binary:
        slots = _without_own(slots, ["s", "slot"], "mid", "all_median", True)
        slots = _without_own(slots, ["s", "slot", "weekend"], "mid", "week_median", True)
    slots = _earlier(_earlier(slots, ["s", "slot"], "d", "mean", "past_mean"), ["s", "slot"], "d", "mean", "recent_mean", half_life).drop("mean", "mid", "like", "weekend")

    days = rows.groupBy("s", "d").agg(F.avg("v").alias("mean"), F.avg(F.when(~F.col("gone"), F.col("v"))).alias("kept"), F.max("gone").alias("any"))
    days = _without_own(days, ["s"], "mean", "day_all")
    days = _earlier(_earlier(days, ["s"], "d", "mean", "day_past"), ["s"], "d", "mean", "day_recent", half_life)
    days = days.where("any").drop("mean", "any")

    # The most similar day: pairs of days of one participant, as a distance needs them.
    seen = rows.where("v is not null and not gone").groupBy("s", "d", "slot").agg(F.avg(like).alias("x")).join(asked.select("s", "d").distinct(), ["s", "d"], "left_semi")
    pairs = seen.join(profiles.select("s", F.col("d").alias("donor"), "slot", "like"), ["s", "slot"]).where("d <> donor")
    common = pairs.groupBy("s", "d", "donor").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("like") - F.col("x"))).alias("distance"))
    lag = F.datediff("donor", "d")
    eligible = common.join(seen.groupBy("s", "d").agg(F.count(F.lit(1)).alias("own")), ["s", "d"]).where((F.col("n") >= similar_slots) & (F.col("n") >= similar_share * F.col("own")))
    chosen = eligible.groupBy("s", "d").agg(F.min_by("donor", F.struct("distance", F.abs(lag), (lag > 0).cast("int"), "donor")).alias("donor"))
    given = rows.where("v is not null").select("s", F.col("d").alias("donor"), "event_id", "m", "v").join(chosen, ["s", "donor"])
    both = asked.select("s", "d", "event_id", "m", F.lit(0).alias("given"), F.lit(None).cast("double").alias("v")).unionByName(given.select("s", "d", "event_id", "m", F.lit(1).alias("given"), "v"))
    part, order = Window.partitionBy("s", "d"), ["m", "given", "event_id"]
    donor = F.when(F.col("given") == 1, F.struct("m", "v"))
    both = both.withColumns({"a": F.last(donor, True).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), "b": F.last(donor, True).over(part.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1))}).where("given = 0")
    before, after = F.col("m") - F.col("a.m"), F.col("b.m") - F.col("m")
    nearest = F.when(before <= F.coalesce(after, before), F.when(before <= cadence / 2, F.col("a.v"))).otherwise(F.when(after <= cadence / 2, F.col("b.v")))
    copies = both.select("event_id", nearest.alias("copy"))

    wide = asked.join(slots, ["s", "d", "slot"], "left").join(days, ["s", "d"], "left").join(copies, "event_id", "left")
    enough = lambda c: F.when(F.col(f"{c}_n") >= least_days, F.col(c))
    last = F.when(F.col("kept").isNotNull(), (F.col("kept") > 0.5).cast("double")) if binary else F.col("kept")

    def chain(method: str):
        tiers = {
            "all_day": [("day_all", 1)], "time_mean": [("all_mean", 1), ("day_all", 3)], "time_median": [("all_median", 1), ("day_all", 3)],
            "weektype_mean": [("week_mean", 1), ("all_mean", 2), ("day_all", 3)], "weektype_median": [("week_median", 1), ("all_median", 2), ("day_all", 3)],
            "past_time_mean": [("past_mean", 1), ("day_past", 3)], "past_recent_mean": [("recent_mean", 1), ("day_recent", 3)], "similar_copy": [("copy", 1), ("all_mean", 2), ("day_all", 3)],
        }[method]
        steps = [(F.col(c), F.lit(1), t) if c == "copy" else (enough(c), F.col(f"{c}_n"), t) for c, t in tiers] + [(last, F.lit(0), 4)]
        got = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("repaired"), F.lit(t).alias("repair_tier"), n.cast("bigint").alias("donors"))) for v, n, t in steps])
        return F.struct(F.lit(method).alias("method"), got.alias("got"))

    methods = [m for m in CROSS_DAY if not (binary and m.endswith("median"))]
    out = wide.select("event_id", F.explode(F.array(*[chain(m) for m in methods])).alias("x")).select("event_id", "x.method", "x.got.repaired", "x.got.repair_tier", "x.got.donors")
    return out.withColumn("repaired", (F.col("repaired") > 0.5).cast("double")) if binary else out
