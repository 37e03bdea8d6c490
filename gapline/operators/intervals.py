"""Overlapping and gapped intervals of an entity: periods of coverage and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD, GAP = "period", "gap"


def periods_and_gaps(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    shard_minutes: int = 120,
) -> DataFrame:
    """Merge the intervals of each entity and list the gaps between them.

    The merge has two levels. Intervals are clipped at the borders of time
    shards and merged within (entity, shard), so that an entity of any size is
    spread over its shards. Then only pieces that touch a shard border, and one
    summary a shard, are brought together by entity: touching pieces are joined
    into whole periods, and gaps that span shards are found.

    Result: ``keys``, ``span_kind`` (period or gap), ``span_start``, ``span_end``.
    Touching intervals are one period; a gap is the time between two successive
    periods of one entity. Rows with a null key or bound, or with a start not
    before the end, are no intervals and give nothing. Repeated, nested and tied
    intervals count once. An empty table gives an empty result. Other columns of
    ``df``, whatever their names, are ignored. The bounds must be zone-free
    timestamps. An interval costs as many rows as shards that it meets.
    """
    width = shard_minutes * 60_000_000
    key = [f"__k{i}" for i in range(len(keys))]
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, key)), us(start).alias("s"), us(end).alias("e")).where("s < e")
    for n in key:
        rows = rows.where(F.col(n).isNotNull())
    first, last = F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)
    pieces = (
        rows.withColumn("shard", F.explode(F.sequence(first, last)))
        .select(*key, "shard", F.greatest("s", F.col("shard") * width).alias("s"), F.least("e", (F.col("shard") + 1) * width).alias("e"))
        .groupBy(*key, "shard", "s")
        .agg(F.max("e").alias("e"))
    )

    inner = Window.partitionBy(*key, "shard").orderBy("s")
    reach = F.max("e").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    local = (
        pieces.withColumn("reach", reach)
        .withColumn("island", F.sum(F.when(F.col("reach") >= F.col("s"), 0).otherwise(1)).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "shard", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    marked = (
        local.withColumn("before", F.lag("e").over(inner))
        .withColumn("at_start", F.col("s") == F.col("shard") * width)
        .withColumn("at_end", F.col("e") == (F.col("shard") + 1) * width)
        .withColumn("is_last", F.lead("s").over(inner).isNull())
    )
    # One row out of each merged piece for every span that is final within its shard.
    inside = marked.select(
        *key,
        F.explode(
            F.filter(
                F.array(
                    F.when(~F.col("at_start") & ~F.col("at_end"), F.struct(F.lit(PERIOD).alias("kind"), F.col("s").alias("s"), F.col("e").alias("e"))),
                    F.when(F.col("before").isNotNull(), F.struct(F.lit(GAP).alias("kind"), F.col("before").alias("s"), F.col("s").alias("e"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("x"),
    ).select(*key, "x.kind", "x.s", "x.e")

    # The second level: a few pieces of each shard.
    edges = marked.where("before is null or is_last or at_start or at_end")
    across = Window.partitionBy(*key).orderBy("s")
    chained = edges.where("at_start or at_end").withColumn("fresh", F.when(F.lag("e").over(across) == F.col("s"), 0).otherwise(1))
    stitched = (
        chained.withColumn("chain", F.sum("fresh").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "chain")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select(*key, F.lit(PERIOD).alias("kind"), "s", "e")
    )
    shards = edges.groupBy(*key, "shard").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    between = (
        shards.withColumn("s", F.lag("last").over(Window.partitionBy(*key).orderBy("shard")))
        .where("s < first")
        .select(*key, F.lit(GAP).alias("kind"), "s", F.col("first").alias("e"))
    )
    time = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return (
        inside.unionByName(stitched)
        .unionByName(between)
        .select(*(F.col(n).alias(k) for k, n in zip(keys, key)), F.col("kind").alias("span_kind"), time("s").alias("span_start"), time("e").alias("span_end"))
    )
