"""A mixture of sources with given shares of the total size, by Pareto order sampling."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.staging import join_bounded, materialize

#: Most sources that targets may name.
MOST_SOURCES = 100_000
#: Most pairs of a source and a weight that the driver solves for the rates.
MOST_WEIGHTS = 100_000


@dataclass(frozen=True)
class SourcePlan:
    source: str
    target_share: float
    max_repeats: int
    available: int
    wanted: float
    rate: float


def _rate(sizes: list[tuple[float, int]], cap: int, wanted: float) -> float:
    """The rate r at which the sum of min(cap, r * weight) * size is ``wanted``. ``sizes``: (weight, size)."""
    low, high = 0.0, cap / min(w for w, _ in sizes)
    if wanted >= cap * sum(s for _, s in sizes):
        return high
    for _ in range(200):
        r = (low + high) / 2
        low, high = (r, high) if sum(min(cap, r * w) * s for w, s in sizes) < wanted else (low, r)
    return high


def plan_mixture(rows: list[tuple[str, float, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> list[SourcePlan]:
    """What each source must give. ``rows``: (source, weight, size); ``targets``: (source, share, repeats).

    Sources without size, share or repeats give nothing, and the others' shares
    are scaled to sum to 1. Without ``total``, it is the largest at which every
    source can hold its share within its repeats. With a ``total``, a source that
    can't hold its share gives all its repeats.
    """
    sizes: dict[str, list[tuple[float, int]]] = {}
    for source, weight, size in rows:
        sizes.setdefault(source, []).append((weight, size))
    have = {s: sum(x for _, x in v) for s, v in sizes.items()}
    usable = [(s, share, cap) for s, share, cap in targets if have.get(s, 0) > 0 and share > 0 and cap > 0]
    whole = sum(share for _, share, _ in usable)
    if total is None and usable:
        total = min(cap * have[s] / (share / whole) for s, share, cap in usable)
    plans = []
    for s, share, cap in targets:
        wanted = min(share / whole * total, cap * have[s]) if (s, share, cap) in usable else 0.0
        plans.append(SourcePlan(s, share, cap, have.get(s, 0), wanted, _rate(sizes[s], cap, wanted) if wanted > 0 else 0.0))
    return plans


def _plan_where_they_are(held: DataFrame, targets: list[tuple[str, float, int]], total: float | None, ways: int = 64, passes: int = 9) -> list[SourcePlan]:
    """As ``plan_mixture``, of any number of weights: each pass sums ``ways`` rates a source and keeps the stretch that holds what is wanted.

    ``held``: source, weight, size. Nine passes of 64 ways narrow a rate to a 2 ** 54th.
    """
    have = held.groupBy("source").agg(F.sum("size").alias("size"), F.min("weight").alias("least")).collect()
    sizes = plan_mixture([(r["source"], r["least"], r["size"]) for r in have], targets, total)
    least = {r["source"]: r["least"] for r in have}
    spans = {p.source: (0.0, p.max_repeats / least[p.source]) for p in sizes if p.wanted > 0}
    wanted = {p.source: (p.wanted, p.max_repeats, p.available) for p in sizes}
    full = {s for s in spans if wanted[s][0] >= wanted[s][1] * wanted[s][2]}
    for _ in range(passes):
        tried = [(s, i, low + (high - low) * i / ways, wanted[s][1]) for s, (low, high) in spans.items() if s not in full for i in range(1, ways + 1)]
        if not tried:
            break
        rates = held.sparkSession.createDataFrame(tried, "source string, i int, rate double, cap int")
        sums = held.join(F.broadcast(rates), "source").groupBy("source", "i").agg(F.sum(F.least(F.col("rate") * F.col("weight"), F.col("cap").cast("double")) * F.col("size")).alias("s")).collect()
        reached = {(r["source"], r["i"]): r["s"] for r in sums}
        for s in {t[0] for t in tried}:
            low, high = spans[s]
            i = next((i for i in range(1, ways + 1) if reached[s, i] >= wanted[s][0]), ways)
            spans[s] = (low + (high - low) * (i - 1) / ways, low + (high - low) * i / ways)
    return [SourcePlan(p.source, p.target_share, p.max_repeats, p.available, p.wanted, spans[p.source][1] if p.source in spans else 0.0) for p in sizes]


def _first_by_order(rows: DataFrame, group: str, order: str, size: str, wanted: str, ident: str) -> DataFrame:
    """``ident`` of the rows that come first in ``order`` until their sizes reach ``wanted`` of their group, to the nearest row.

    The cut is found in cells of the order, then in finer cells of the cut cell,
    and only the rows of one of those are sorted, so that a group of any size is
    never ordered in one task.
    """
    fine = F.floor((F.col(order) * 64 - F.floor(F.col(order) * 64)) * 65536)
    celled = rows.withColumns({"__c1": F.floor(F.col(order) * 64), "__c2": fine, "__base": F.lit(0).cast("bigint")})
    taken = []
    for cell in ("__c1", "__c2"):
        w = Window.partitionBy(group).orderBy(cell)
        cells = celled.groupBy(group, cell).agg(F.sum(size).alias("__s"), F.first("__base").alias("__b"), F.first(wanted).alias("__w"))
        cells = cells.withColumn("__upto", F.col("__b") + F.sum("__s").over(w)).withColumn("__before", F.col("__upto") - F.col("__s"))
        marked = join_bounded(celled, cells.select(group, cell, "__upto", "__before"), [group, cell])
        taken.append(marked.where(F.col("__upto") <= F.col(wanted)).select(ident))
        celled = marked.where((F.col("__upto") > F.col(wanted)) & (F.col("__before") <= F.col(wanted))).withColumn("__base", F.col("__before")).drop("__upto", "__before")
    w = Window.partitionBy(group).orderBy(order, ident).rowsBetween(Window.unboundedPreceding, 0)
    last = celled.withColumn("__upto", F.col("__base") + F.sum(size).over(w))
    # A row is taken if that brings the sum nearer to what is wanted.
    taken.append(last.where(F.col("__upto") - F.col(size) / 2 <= F.col(wanted)).select(ident))
    return taken[0].unionByName(taken[1]).unionByName(taken[2])


def uniform(ident: Column, seed: int) -> Column:
    """A number over 0 and under 1 that follows from the id and the seed alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def mix(
    df: DataFrame,
    targets: DataFrame,
    ident: str,
    source: str,
    size: str,
    weight: str | None = None,
    total: float | None = None,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``, each source
    once. Every item of a source is expected rate * weight times (at most
    max_repeats): the whole part of that is certain, and for the fraction p that
    remains items are ranked by Pareto order, random odds over inclusion odds
    (u / (1 - u)) / (p / (1 - p)), and taken from the first until the source's
    size is reached to the nearest item. The rate makes the source's size what
    its share of the total asks for; see ``plan_mixture`` for the total.

    Mixture: ``ident``, ``source``, ``size``, ``copies`` (at least 1). Report, a row
    for each target: ``source``, ``target_share``, ``max_repeats``,
    ``available_size``, ``mixed_size``, ``actual_share``, ``most_copies``. Items
    with a null id or source, of a source without target, or without size give
    nothing. Each item must be there once. The same seed gives the same mixture.
    Empty tables give an empty mixture, and a report with shares of 0.
    """
    goals = targets.select("source", "target_share", "max_repeats").distinct().limit(MOST_SOURCES + 1).collect()
    if len(goals) > MOST_SOURCES or len({g[0] for g in goals}) < len(goals):
        raise ValueError(f"targets name a source twice, or more than {MOST_SOURCES} sources")
    wide = df.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))
    items = materialize(wide.where("id is not null and size > 0 and weight > 0").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), "items")
    # One row for each source and weight. Weights that are too many to gather are solved for where they are.
    held = materialize(items.groupBy("source", "weight").agg(F.sum("size").alias("size")), "weights")
    if held.limit(MOST_WEIGHTS + 1).count() <= MOST_WEIGHTS:
        plans = plan_mixture([tuple(r) for r in held.collect()], [tuple(g) for g in goals], total)
    else:
        plans = _plan_where_they_are(held, [tuple(g) for g in goals], total)
    spark = df.sparkSession
    rates = spark.createDataFrame([(p.source, p.rate, int(p.max_repeats)) for p in plans if p.rate > 0], "source string, rate double, cap int")
    expected = items.join(F.broadcast(rates), "source").withColumn("expected", F.least(F.col("rate") * F.col("weight"), F.col("cap").cast("double")))
    sure = F.floor(F.col("expected") + 1e-9).cast("int")
    drawn = expected.select("id", "source", "size", sure.alias("sure"), F.greatest(F.col("expected") - sure, F.lit(0.0)).alias("p"))
    odds = F.log(uniform(F.col("id"), seed)) - F.log(1 - uniform(F.col("id"), seed)) - F.log("p") + F.log(1 - F.col("p"))
    certain = {r[0]: r[1] for r in drawn.groupBy("source").agg(F.sum(F.col("sure") * F.col("size"))).collect()}
    rest = spark.createDataFrame([(p.source, max(0.0, p.wanted - (certain.get(p.source) or 0))) for p in plans if p.rate > 0], "source string, rest double")
    open_items = materialize(drawn.where("p > 1e-9").join(F.broadcast(rest), "source").withColumn("order", odds), "open")
    more = _first_by_order(open_items, "source", "order", "size", "rest", "id").withColumn("more", F.lit(1))
    copies = drawn.join(more, "id", "left").withColumn("copies", F.col("sure") + F.coalesce("more", F.lit(0))).where("copies > 0")
    mixture = materialize(copies.select("id", "source", "size", "copies"), "mixture")
    held = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("mixed_size"), F.max("copies").alias("most_copies"))
    known = spark.createDataFrame([(p.source, p.target_share, int(p.max_repeats), int(p.available)) for p in plans], "source string, target_share double, max_repeats int, available_size bigint")
    report = known.join(held, "source", "left").withColumns({"mixed_size": F.coalesce("mixed_size", F.lit(0)), "most_copies": F.coalesce("most_copies", F.lit(0))})
    everything = F.sum("mixed_size").over(Window.partitionBy())
    report = report.withColumn("actual_share", F.when(everything > 0, F.col("mixed_size") / everything).otherwise(0.0))
    return mixture.withColumnsRenamed({"id": ident}), report
