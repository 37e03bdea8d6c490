"""Features relative to a participant and to all others: shrunk baselines, scores, confidence and composed indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.robust import MAD_FACTOR, location_scale
from gapline.staging import materialize


def shrunk(personal_center: Column, personal_scale: Column, population_center: Column, population_scale: Column, n: Column, days: float = 7.0) -> tuple[Column, Column]:
    """Center and scale between personal and population: weight n / (n + days) on the personal.

    The personal scale counts only from three days on; the scale is at least a
    tenth of the population's.
    """
    w = n / (n + days)
    center = w * personal_center + (1 - w) * population_center
    scale = F.when(n >= 3, w * personal_scale + (1 - w) * population_scale).otherwise(population_scale)
    return F.coalesce(center, population_center), F.greatest(scale, 0.1 * population_scale)


def leave_one_out_mean_scale(df: DataFrame, subject: str, value: str) -> DataFrame:
    """Mean and standard deviation over all other participants' rows, out of sums less the own part: no pairs."""
    own = df.where(F.col(value).isNotNull()).groupBy(subject).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    own = materialize(own, "own")
    whole = own.agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).first()
    n, s, q = (F.lit(whole[c]) - F.col(c) for c in ("n", "s", "q"))
    return own.select(subject, n.alias("others"), (s / n).alias("others_mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("others_sd"))


def scores(df: DataFrame, baseline: DataFrame, keys: list[str], value: str, limit: float = 5.0) -> DataFrame:
    """``z``: the value less the baseline's center over its scale, cut to +-``limit``; null where the scale isn't positive."""
    z = F.when(F.col("scale") > 0, (F.col(value) - F.col("center")) / F.col("scale"))
    return df.join(baseline.select(*keys, "center", "scale"), keys).withColumn("z", F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(limit)), F.lit(-limit)))).drop("center", "scale")


def confidence(coverage: Column, longest_gap: Column, window_minutes: float, finite: Column, uncensored: Column) -> Column:
    """Coverage times what of the window isn't the longest gap, 0 for values that aren't finite or are censored."""
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    return unit(coverage) * unit(1 - longest_gap / window_minutes) * finite.cast("double") * uncensored.cast("double")


def composed_mean(sources: list[tuple[Column, Column]], expected: int, least: int = 1) -> tuple[Column, Column]:
    """The confidence-weighted mean of several values, and its confidence: the sum of weights over the expected number, at most 1.

    Sources without a value or a positive confidence don't count; null with fewer than ``least``.
    """
    on = [v.isNotNull() & (c > 0) for v, c in sources]
    count = sum((F.when(o, 1).otherwise(0) for o in on), F.lit(0))
    weight = sum((F.when(o, c).otherwise(0.0) for o, (_, c) in zip(on, sources)), F.lit(0.0))
    total = sum((F.when(o, v * c).otherwise(0.0) for o, (v, c) in zip(on, sources)), F.lit(0.0))
    return F.when(count >= least, total / weight), F.when(count >= least, F.least(weight / expected, F.lit(1.0)))


def standardizers(df: DataFrame, subject: str, value: str) -> DataFrame:
    """The scale of errors: 1.4826 MAD of the participant's values, at least a tenth of the scale of all; the latter where the former is missing."""
    own = location_scale(df.withColumn("__one", F.lit(1.0)), [subject], value, "__one").select(subject, F.col("scale").alias("own_scale"))
    every = location_scale(df.withColumns({"__one": F.lit(1.0), "__every": F.lit(1)}), ["__every"], value, "__one").select(F.col("scale").alias("population_scale"))
    one = every.first()
    both = own.withColumn("population_scale", F.lit(one[0] if one else None).cast("double"))
    return both.select(subject, "own_scale", "population_scale", F.greatest(F.coalesce("own_scale", "population_scale"), 0.1 * F.col("population_scale")).alias("standardizer"))


def transfer_error(center: Column, scale: Column, later_center: Column, later_scale: Column, population_scale: Column) -> Column:
    """Half the shift of the center in population scales plus half the log ratio of the scales."""
    return 0.5 * F.abs(center - later_center) / population_scale + 0.5 * F.abs(F.log(scale / later_scale))


def mad(value: str) -> Column:
    """1.4826 times the median distance from the group's median, which must be in the column ``__median``."""
    return F.median(F.abs(F.col(value) - F.col("__median"))) * MAD_FACTOR


def selected_days(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best days of each group: by coverage, then by shorter longest gap, then by day, with their ``rank``."""
    w = Window.partitionBy(*keys).orderBy(F.col("coverage").desc(), F.col("longest_gap"), F.col("day"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
