"""Exact percentiles of very large columns by bisection, and mergeable summaries of parts.

A pass tests 255 midpoints of a value interval at once, which is eight levels of
bisection, and keeps for each group and percentile only the cell that holds its
rank. The first pass uses a grid that is the same for all data, so its counts of
separate days or partitions add up.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.staging import join_bounded, materialize

#: Cells of the fixed grid in each doubling of 1 + |value|. A cell's values lie within a factor 2 ** (1 / 64) of each other, in 1 + |value|.
CELLS_PER_DOUBLING = 64
WAYS = 256


def fixed_cell(value: Column) -> Column:
    """The cell of the fixed grid: a monotone function of the value."""
    size = F.floor(F.log2(1.0 + F.abs(value)) * CELLS_PER_DOUBLING)
    return F.when(value < 0, -size - 1).otherwise(size).cast("int")


def summarize(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Counts of finite values in the cells of the fixed grid, with each cell's least and greatest value.

    Result: ``keys``, ``cell``, ``n``, ``low``, ``high``. Its size a group is
    bounded by the grid (at most 131,072 cells, in practice some hundred), however
    many rows there are. Null, NaN and infinite values are not counted. Null keys
    form a group of their own.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("__v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("__w"))
    rows = rows.where("__v is not null and not isnan(__v) and abs(__v) < double('inf')")
    return rows.groupBy(*keys, fixed_cell(F.col("__v")).alias("cell")).agg(F.sum("__w").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))


def combine(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """The summary of all parts out of summaries of parts: counts add up. ``keys`` are those to keep."""
    return summaries.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _targets(cells: DataFrame, keys: list[str], percentiles: list[float]) -> DataFrame:
    """The cell in which each percentile's rank lies, and the values below it. Rank: ceil(q n), at least 1."""
    w = Window.partitionBy(*keys).orderBy("cell")
    counted = cells.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    # ceil(q n) in whole numbers, with q as written: 0.05 is 1 / 20.
    asked = [(q, *Fraction(str(q)).as_integer_ratio()) for q in percentiles]
    qs = counted.withColumn("__q", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(a).cast("decimal(20,0)").alias("a"), F.lit(b).cast("decimal(20,0)").alias("b")) for q, a, b in asked)))).withColumn("q", F.col("__q.q"))
    rank = F.greatest(F.expr("(cast(total as decimal(18,0)) * __q.a + __q.b - 1) div __q.b"), F.lit(1)).cast("bigint")
    held = qs.withColumn("rank", rank).where("rank <= upto and rank > upto - n")
    return held.select(*keys, "q", "total", "rank", (F.col("upto") - F.col("n")).alias("below"), "n", "low", "high")


def bounds(summary: DataFrame, keys: list[str], percentiles: list[float]) -> DataFrame:
    """Percentiles out of a combined summary alone.

    Result: ``keys``, ``q``, ``n_values``, ``low``, ``high``: the true percentile
    (the value at rank ceil(q n)) lies between ``low`` and ``high``, whose 1 + |x|
    differ by a factor of at most 2 ** (1 / 64), about 1.1 percent.
    """
    return _targets(summary, keys, percentiles).select(*keys, "q", F.col("total").alias("n_values"), "low", "high")


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    percentiles: list[float],
    part: list[str] | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Exact percentiles of each group: the finite value at rank ceil(q n).

    The fixed grid (``summary`` if it was made before, of parts named in
    ``part`` or not) gives each percentile an interval: only counts of cells are
    shuffled. Then each pass takes the values that lie in an open interval, counts
    them below 255 midpoints and narrows it, until its least and greatest
    value are the same. Each pass shortens every open interval by at least one
    distinct value, and as a rule to a 256th; the number of passes follows from
    the data, without a limit. Only intervals, never values, are gathered: one
    row for each group and percentile. Values outside of open intervals aren't
    shuffled, and those inside are counted by value before.

    Result: ``keys``, ``q``, ``n_values``, ``percentile``, ``error_bound`` (0.0:
    the interval is closed). Groups without a finite value give no row. Ties and
    repeated values count as often as they occur. Rows delivered twice must have
    been removed before. An empty table gives an empty result.
    """
    key = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, key)), F.col(value).cast("double").alias("v"))
    rows = rows.where("v is not null and not isnan(v) and abs(v) < double('inf')")
    values = materialize(rows.withColumn("n", F.lit(1).cast("bigint")), "values")
    if summary is None:
        first = summarize(values, key, "v", "n")
    else:
        first = combine(summary.select(*(F.col(k).alias(n) for k, n in zip(keys, key)), "cell", "n", "low", "high"), key)
    state = materialize(_targets(first, key, percentiles), "targets")
    hashed = lambda d: d.withColumn("__g", F.xxhash64(F.lit(0), *key))
    while True:
        still = state.where("low < high")
        if still.limit(1).count() == 0:
            break
        # Groups are joined by a hash of their keys, and compared with null equal to null.
        intervals = hashed(still.select(*key, F.col("low").alias("from"), F.col("high").alias("to")).distinct()).withColumnsRenamed({k: f"{k}j" for k in key})
        same = lambda d: d.where(reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}j")) for k in key], F.lit(True))).drop(*(f"{k}j" for k in key))
        # Intervals of a group don't overlap: they are cells of one partition of the values.
        inside = same(join_bounded(hashed(values.select(*key, "v", "n")), intervals, ["__g"])).where(F.col("v").between(F.col("from"), F.col("to")))
        values = materialize(inside.groupBy(*key, "from", "to", "v").agg(F.sum("n").alias("n")), "values")
        width = F.col("to") * 0.5 - F.col("from") * 0.5
        step = F.floor((F.col("v") * 0.5 - F.col("from") * 0.5) / width * WAYS)
        cell = F.when(F.col("v") <= F.col("from"), 0).when(F.col("v") >= F.col("to"), WAYS - 1).otherwise(F.least(F.greatest(step, F.lit(0)), F.lit(WAYS - 1)))
        counts = values.groupBy(*key, "from", "to", cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy(*key, "from", "to").orderBy("cell")
        upto = hashed(counts.withColumn("upto", F.sum("n").over(w))).select("__g", *(F.col(k).alias(f"{k}j") for k in key), "from", "to", "upto", F.col("n").alias("m"), F.col("low").alias("l"), F.col("high").alias("h"))
        asked = hashed(still).withColumnsRenamed({"low": "from", "high": "to"})
        closer = same(asked.join(upto, ["__g", "from", "to"])).where("rank <= below + upto and rank > below + upto - m")
        closer = closer.select(*key, "q", "total", "rank", (F.col("below") + F.col("upto") - F.col("m")).alias("below"), F.col("m").alias("n"), F.col("l").alias("low"), F.col("h").alias("high"))
        state = materialize(state.where("low = high").unionByName(closer), "targets")
    return state.select(*(F.col(n).alias(k) for k, n in zip(keys, key)), "q", F.col("total").alias("n_values"), F.col("low").alias("percentile"), (F.col("high") - F.col("low")).alias("error_bound"))
