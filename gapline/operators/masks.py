"""Deterministic masks of a participant-day, and what deleting their readings does to a feature.

A mask follows from the SHA-256 of its names alone, so it is the same however
the data are distributed, and SQL can make it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scenario -> (share of the window, or None) and (minutes, or None).
SCENARIOS = {
    "contiguous_10pct": (0.1, None),
    "contiguous_20pct": (0.2, None),
    "contiguous_40pct": (0.4, None),
    "outage_1h": (None, 60),
    "outage_3h": (None, 180),
    "outage_6h": (None, 360),
    "evening_critical": (None, None),
}


def mask_seed(root: str, *parts: Column) -> Column:
    """SHA-256 (64 hex) of the names of a mask."""
    return F.sha2(F.concat_ws("|", F.lit(root), *(p.cast("string") for p in parts)), 256)


def hash_number(seed: Column) -> Column:
    """A number from 0 to 16 ** 15 - 1 out of a seed's first 15 digits."""
    return F.conv(F.substring(seed, 1, 15), 16, 10).cast("bigint")


def block_masks(cells: DataFrame, keys: list[str], draws: int, root: str, window: tuple[int, int] = (0, 1440), scenarios: dict = SCENARIOS) -> DataFrame:
    """One interval of minutes for each cell, scenario and draw: ``mask_start`` and ``mask_end``, half open.

    The start is a whole minute, uniform over those at which the block lies in
    the window; evening_critical is always 21:00 to 24:00.
    """
    low, high = window
    rows = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(None if share is None and minutes is None else int((high - low) * share) if share else minutes).cast("int").alias("minutes")) for n, (share, minutes) in scenarios.items()))
    grid = cells.select(*keys, F.explode(rows).alias("s")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    named = grid.select(*keys, "s.scenario", "s.minutes", "draw").withColumn("seed", mask_seed(root, F.col("scenario"), F.col("draw"), *(F.col(k) for k in keys)))
    start = low + F.pmod(hash_number(F.col("seed")), F.lit(high - low) - F.col("minutes") + 1)
    begin = F.when(F.col("minutes").isNull(), 1260).otherwise(start).cast("int")
    return named.select(*keys, "scenario", "draw", "seed", begin.alias("mask_start"), F.when(F.col("minutes").isNull(), 1440).otherwise(begin + F.col("minutes")).cast("int").alias("mask_end"))


def internal_gaps(df: DataFrame, keys: list[str], minute: str, cadence: float) -> DataFrame:
    """Stretches between successive distinct reading times that are longer than the cadence."""
    times = df.select(*keys, minute).distinct()
    after = times.withColumn("gap_end", F.lead(minute).over(Window.partitionBy(*keys).orderBy(minute)))
    return after.where(F.col("gap_end") - F.col(minute) > cadence).select(*keys, F.col(minute).alias("gap_start"), "gap_end")


def donor_days(cells: DataFrame, subject: str, day: str, draws: int, root: str) -> DataFrame:
    """For each day and draw one other day of the same participant, chosen by hash: ``donor_day``.

    The days of a participant are numbered, and the hash picks a number, so no
    pairs of days are formed. A participant with one day has no donor.
    """
    w = Window.partitionBy(subject)
    numbered = cells.select(subject, day).distinct().withColumns({"__i": F.row_number().over(w.orderBy(day)) - 1, "__n": F.count(F.lit(1)).over(w)})
    drawn = numbered.where("__n > 1").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.pmod(hash_number(mask_seed(root, F.lit("empirical_gap"), F.col("draw"), F.col(subject), F.col(day))), F.col("__n") - 1)
    chosen = drawn.withColumn("__j", F.pmod(F.col("__i") + 1 + pick, F.col("__n")).cast("int"))
    return chosen.select(subject, day, "draw", "__j").join(numbered.select(subject, F.col(day).alias("donor_day"), F.col("__i").alias("__j")), [subject, "__j"]).drop("__j")


def deleted(records: DataFrame, masks: DataFrame, keys: list[str], minute: str, mask: list[str]) -> DataFrame:
    """Pairs of a mask and a record in it: instants from its start up to before its end. ``mask`` names a mask within ``keys``."""
    return records.join(masks.select(*keys, *mask, "mask_start", "mask_end"), keys).where((F.col(minute) >= F.col("mask_start")) & (F.col(minute) < F.col("mask_end")))


def deleted_supports(records: DataFrame, masks: DataFrame, keys: list[str], start: str, end: str, mask: list[str]) -> DataFrame:
    """Pairs of a mask and a record whose support overlaps it; touching isn't overlapping."""
    return records.join(masks.select(*keys, *mask, "mask_start", "mask_end"), keys).where((F.col(start) < F.col("mask_end")) & (F.col(end) > F.col("mask_start")))


def scattered(records: DataFrame, targets: DataFrame, keys: list[str], mask: list[str], ident: str, count: str, root: str) -> DataFrame:
    """For each mask as many records of its cell as ``count`` says, drawn without replacement by hash."""
    both = records.join(targets.select(*keys, *mask, count), keys)
    order = F.sha2(F.concat_ws("|", F.lit(root), *(F.col(m).cast("string") for m in mask), F.col(ident).cast("string")), 256)
    w = Window.partitionBy(*keys, *mask).orderBy(order, ident)
    return both.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col(count)).drop("__r")


def boundaries(records: DataFrame, keys: list[str], minute: str, state: str) -> DataFrame:
    """Times at which the state differs from that of the reading before."""
    w = Window.partitionBy(*keys).orderBy(minute, "event_id")
    return records.withColumn("__before", F.lag(state).over(w)).where(F.col("__before") != F.col(state)).select(*keys, F.col(minute).alias("boundary"))


def near_boundaries(records: DataFrame, keys: list[str], minute: str, state: str) -> DataFrame:
    """Records with their distance to the nearest boundary of their cell, before or after; null in a cell without one."""
    w = Window.partitionBy(*keys).orderBy(minute, "event_id")
    change = F.when(F.col("__before") != F.col(state), F.col(minute))
    marked = records.withColumn("__before", F.lag(state).over(w)).withColumn("__at", change)
    last = F.last("__at", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # The next boundary: the last one in descending order, so that both frames are cumulative.
    down = Window.partitionBy(*keys).orderBy(F.col(minute).desc(), F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    following = F.last("__at", True).over(down)
    return marked.withColumns({"__l": last, "__f": following}).withColumn("distance", F.least(F.col(minute) - F.col("__l"), F.col("__f") - F.col(minute))).drop("__before", "__at", "__l", "__f")


def replay(records: DataFrame, gone: DataFrame, keys: list[str], mask: list[str], ident: str, value: str) -> DataFrame:
    """Sum and mean of each cell after each mask's deletions, out of sufficient statistics.

    Only the deleted records are joined with their masks; what is retained is the
    cell's total less their part, so a cell isn't repeated for every mask. Result:
    ``keys``, ``mask``, ``n_deleted``, ``original_mean``, ``retained_mean`` (null if none is
    left), ``original_sum``, ``retained_sum``.
    """
    total = records.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    lost = gone.groupBy(*keys, *mask).agg(F.count(value).alias("k"), F.sum(value).alias("d"))
    left = F.col("n") - F.col("k")
    return lost.join(total, keys).select(
        *keys, *mask, F.col("k").alias("n_deleted"), (F.col("s") / F.col("n")).alias("original_mean"), F.when(left > 0, (F.col("s") - F.col("d")) / left).alias("retained_mean"),
        F.col("s").alias("original_sum"), F.when(left > 0, F.col("s") - F.col("d")).alias("retained_sum"),
    )
