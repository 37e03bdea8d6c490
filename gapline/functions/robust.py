"""Order statistics with weights, ranks with ties, and robust location and scale."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.staging import materialize

#: Fixed value: makes the median absolute deviation of normal values their standard deviation.
MAD_FACTOR = 1.4826


def value_cell(value: Column) -> Column:
    """The cell of a fixed grid of values, 64 to each doubling of 1 + |value|: a monotone function of the value."""
    size = F.floor(F.log2(1.0 + F.abs(value.cast("double"))) * 64)
    return F.when(value < 0, -size - 1).otherwise(size).cast("int")


def same_group(keys: list[str], mark: str = "__r_") -> Column:
    """The condition that two rows are of one group, null keys included; the right side's keys are named with ``mark``."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys], F.lit(True))


def running_weights(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Each distinct value of each group with its weight: ``__w``, that up to it: ``__upto``, that of the group: ``__all``, and the ``__next`` value.

    Values are ordered within cells of a fixed grid, and only cells by group: a
    group of any size is never sorted in one task, but for a cell of values
    within about a hundredth of each other.
    """
    mass = rows.groupBy(*keys, value).agg(F.sum(weight).alias("__w")).withColumn("__cell", value_cell(F.col(value)))
    cells = mass.groupBy(*keys, "__cell").agg(F.sum("__w").alias("__cw"), F.min(value).alias("__least"))
    group = Window.partitionBy(*keys)
    by_cell = group.orderBy("__cell")
    # What lies before a cell is a sum of cells, not a difference: equal halves stay equal.
    before = F.coalesce(F.sum("__cw").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0) * F.col("__cw"))
    offsets = cells.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col("__cell").alias("__r___cell"), before.alias("__before"), F.sum("__cw").over(group).alias("__all"), F.lead("__least").over(by_cell).alias("__beyond"))
    inner = Window.partitionBy(*keys, "__cell").orderBy(value)
    both = mass.withColumns({"__in": F.sum("__w").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.lead(value).over(inner)}).join(offsets, same_group([*keys, "__cell"]))
    return both.select(*keys, value, "__w", (F.col("__before") + F.col("__in")).alias("__upto"), "__all", F.coalesce("__after", "__beyond").alias("__next"))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str) -> DataFrame:
    """The least value at which the cumulative weight reaches ``q`` of the whole: no interpolation. Weights not above 0 don't count."""
    rows = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    marked = running_weights(rows, keys, value, weight)
    return marked.where(F.col("__upto") >= F.col("__all") * q - 1e-9).groupBy(*keys).agg(F.min(value).alias(out))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str, tolerance: float = 1e-12) -> DataFrame:
    """The weighted median; where the weight is exactly halved between two values, their mean."""
    rows = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    marked = running_weights(rows, keys, value, weight)
    half = F.col("__all") / 2
    tie = (F.abs(F.col("__upto") - half) <= tolerance) & F.col("__next").isNotNull()
    pick = F.when(tie, (F.col(value) + F.col("__next")) / 2).otherwise(F.col(value))
    return marked.where(F.col("__upto") >= half - tolerance).groupBy(*keys).agg(F.min_by(pick, value).alias(out))


def location_scale(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``center`` (weighted median), ``scale`` (1.4826 weighted MAD), ``n_eff`` (sum of weights) and ``n_rows``."""
    center = weighted_median(df, keys, value, weight, "center")
    off = df.join(center, keys).withColumn("__off", F.abs(F.col(value) - F.col("center")))
    mad = weighted_median(off, keys, "__off", weight, "__mad")
    size = df.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(weight).alias("n_eff"), F.count(F.lit(1)).alias("n_rows"))
    return size.join(center, keys).join(mad, keys).select(*keys, "center", (F.col("__mad") * MAD_FACTOR).alias("scale"), "n_eff", "n_rows")


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the rank of each value in its group, equal values sharing the mean of their ranks; null for a null."""
    counts = running_weights(df.where(F.col(value).isNotNull()).withColumn("__one", F.lit(1)), keys, value, "__one")
    ranks = counts.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col(value).alias(f"__r_{value}"), (F.col("__upto") - (F.col("__w") - 1) / 2.0).alias(out))
    return df.join(ranks, same_group(keys) & (F.col(value) == F.col(f"__r_{value}")), "left").drop(*(f"__r_{k}" for k in keys), f"__r_{value}")


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "rho", least: int = 3) -> DataFrame:
    """Spearman's correlation by average ranks; null with fewer than ``least`` pairs or a constant side."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(both, keys, x, "__x"), keys, y, "__y")
    enough = (F.count(F.lit(1)) >= least) & (F.stddev_pop("__x") > 0) & (F.stddev_pop("__y") > 0)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.when(enough, F.corr("__x", "__y")).alias(out))


def rank_auc(df: DataFrame, keys: list[str], label: str, score: str, out: str = "auc") -> DataFrame:
    """The area under the ROC curve by average ranks; null unless both classes occur."""
    ranked = average_ranks(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*keys, label, score), keys, score, "__r")
    pos, n = F.count_if(F.col(label) == 1), F.count(F.lit(1))
    top = F.sum(F.when(F.col(label) == 1, F.col("__r"))) - pos * (pos + 1) / 2.0
    return ranked.groupBy(*keys).agg(F.when((pos > 0) & (pos < n), top / (pos * (n - pos))).alias(out))


def others_median_rows(df: DataFrame, keys: list[str], member: str, value: str, out: str, bucket: int = 1024) -> DataFrame:
    """For each member of each group the median of all other members' rows: ``keys``, ``member``, ``out``. No pair of members is formed.

    Leaving out a member's n rows moves the middle by at most n ranks. So a
    member looks only at the rows whose rank lies within that stretch, found by
    buckets of ranks, and takes its own out of them: as many rows in all as there are, twice.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, member, F.col(value).cast("double").alias("__v"))
    numbered = materialize(rows.withColumn("__one", F.lit(1)).withColumn("__cell", value_cell(F.col("__v"))), "rows")
    cells = numbered.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__c").over(group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col("__cell").alias("__r___cell"), before.alias("__o"), F.sum("__c").over(group).alias("__all"))
    inner = Window.partitionBy(*keys, "__cell").orderBy("__v", member)
    ranked = materialize(numbered.withColumn("__in", F.row_number().over(inner)).join(offsets, same_group([*keys, "__cell"])).select(*keys, member, "__v", "__all", (F.col("__o") + F.col("__in")).alias("__rank")), "ranked")
    own = ranked.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("__n"), F.max("__all").alias("__all")).withColumn("__m", F.col("__all") - F.col("__n")).where("__m > 0")
    low, high = F.floor((F.col("__m") + 1) / 2), F.floor(F.col("__m") / 2) + 1 + F.col("__n")
    asked = own.withColumns({"__low": low, "__high": high}).withColumn("__b", F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))))
    asked = asked.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col(member).alias("__who"), "__m", "__low", "__high", "__b")
    near = ranked.withColumn("__rb", F.floor(F.col("__rank") / bucket)).join(asked, same_group(keys) & (F.col("__rb") == F.col("__b"))).where(F.col("__rank").between(F.col("__low"), F.col("__high")))
    mine = ranked.join(own.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col(member).alias("__who"), low.alias("__low")), same_group(keys) & (F.col(member) == F.col("__who"))).where(F.col("__rank") < F.col("__low"))
    first = mine.groupBy(*keys, "__who").agg(F.count(F.lit(1)).alias("__lost")).select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col("__who").alias("__r___who"), "__lost")
    left = near.select(*keys, "__who", member, "__v", "__rank", "__m", "__low").where(F.col(member) != F.col("__who")).join(first, same_group([*keys, "__who"]), "left")
    place = F.col("__low") - 1 - F.coalesce("__lost", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys, "__who").orderBy("__rank"))
    placed = left.withColumn("__place", place)
    middle = placed.where((F.col("__place") == F.floor((F.col("__m") + 1) / 2)) | (F.col("__place") == F.floor(F.col("__m") / 2) + 1))
    return middle.groupBy(*keys, F.col("__who").alias(member)).agg(F.avg("__v").alias(out))
