"""Totals and averages over trailing periods, from segment trees per entity and time shard.

A shard is 64 days. Its tree is an array of 128 sums in heap order: node 1 is the
whole shard, the children of node i are 2i and 2i+1, and day d of the shard is
node 64+d. A trailing period of at most 64 days meets at most two shards and is
answered by at most ten nodes. A correction changes the seven nodes above its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

from gapline.staging import join_bounded, materialize

SHARD_DAYS = 64
LEVELS = 6
PARTS = ("sums", "counts", "rows")


def _day(column: Column) -> Column:
    return F.datediff(column, F.lit("1970-01-01").cast("date"))


def _sum_type(kind: DataType) -> str:
    """What values of a type are summed as: whole numbers as bigint, decimals exactly with their scale, all others as double."""
    if isinstance(kind, IntegralType):
        return "bigint"
    return f"decimal(38,{kind.scale})" if isinstance(kind, DecimalType) else "double"


def _zero(df: DataFrame, part: str) -> Column:
    """0 in the type of a tree's nodes."""
    return F.lit(0).cast(df.schema[part].dataType.elementType)


def covering_nodes(low: int, high: int) -> list[int]:
    """The fewest nodes of a shard's tree that cover its days low to high (none if low > high)."""
    found, a, b = [], max(low, 0) + SHARD_DAYS, high + SHARD_DAYS + 1
    while a < b:
        if a & 1:
            found.append(a)
            a += 1
        if b & 1:
            b -= 1
            found.append(b)
        a, b = a // 2, b // 2
    return found


def build_trees(df: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """One row a (entity, shard): ``sums``, ``counts`` and ``rows``, the segment trees of the shard.

    ``sums`` adds the values, ``counts`` the days that have a value, ``rows`` the
    days that have a row at all. Rows with a null entity or day have no place and
    are left out; a null value adds nothing. Several rows of one day add up; rows
    delivered twice must have been removed before. An empty table gives no trees.
    Sums keep what the value's type holds: whole numbers stay whole, decimals
    exact, all else is summed as double (NaN included: it isn't a missing value).
    """
    kind = _sum_type(df.schema[value].dataType)
    days = (
        df.select(F.col(entity).alias("entity"), _day(F.col(day)).alias("d"), F.col(value).cast(kind).alias("v"))
        .where("entity is not null and d is not null")
        .groupBy("entity", "d")
        .agg(F.coalesce(F.sum("v"), F.lit(0)).cast(kind).alias("v"), F.count("v").alias("n"))
    )
    leaf = F.struct(
        F.pmod("d", F.lit(SHARD_DAYS)).alias("leaf"),
        F.col("v").alias("sums"),
        F.when(F.col("n") > 0, 1).otherwise(0).cast("bigint").alias("counts"),
        F.lit(1).cast("bigint").alias("rows"),
    )
    # A shard has at most 64 days, so its list is bounded.
    out = days.groupBy("entity", F.floor(F.col("d") / SHARD_DAYS).cast("int").alias("shard")).agg(F.collect_list(leaf).alias("days"))
    zero = {part: F.lit(0).cast(kind if part == "sums" else "bigint") for part in PARTS}

    def leaves(part: str) -> Column:
        known = F.map_from_arrays(F.transform("days", lambda x: x["leaf"]), F.transform("days", lambda x: x[part]))
        return F.transform(F.sequence(F.lit(0), F.lit(SHARD_DAYS - 1)), lambda i: F.coalesce(F.try_element_at(known, i), zero[part]))

    def parents(part: str, depth: int) -> Column:
        below = f"{part}{depth + 1}"
        both = lambda i: F.col(below)[2 * i] + F.col(below)[2 * i + 1]
        return F.transform(F.sequence(F.lit(0), F.lit(2**depth - 1)), lambda i: both(i).cast(kind if part == "sums" else "bigint"))

    out = out.withColumns({f"{part}{LEVELS}": leaves(part) for part in PARTS})
    for depth in range(LEVELS - 1, -1, -1):
        out = out.withColumns({f"{part}{depth}": parents(part, depth) for part in PARTS})
    whole = lambda part: F.concat(F.array(zero[part]), *(F.col(f"{part}{k}") for k in range(LEVELS + 1)))
    return out.select("entity", "shard", *(whole(part).alias(part) for part in PARTS))


def correct_trees(trees: DataFrame, changes: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """The trees after late corrections: each row of ``changes`` sets the total of one day.

    Only the day's node and the six above it change. Shards without a correction
    pass through as they are: if the corrected shards' names are few (see
    ``join_bounded``), the trees aren't shuffled. A day corrected several times
    must come as one row. A null value leaves the day with a row but without a
    value. Corrections of an entity or shard without a tree make one. Values are
    cast to the type of the trees' sums.
    """
    kind = trees.schema["sums"].dataType.elementType
    leaf = F.pmod("d", F.lit(SHARD_DAYS)) + SHARD_DAYS
    new = materialize(
        changes.select(F.col(entity).alias("entity"), _day(F.col(day)).alias("d"), F.col(value).cast(kind).alias("v"))
        .where("entity is not null and d is not null")
        .withColumn("to", F.struct(leaf.cast("int").alias("leaf"), F.coalesce("v", F.lit(0).cast(kind)).alias("sums"), F.when(F.col("v").isNull(), 0).otherwise(1).cast("bigint").alias("counts"), F.lit(1).cast("bigint").alias("rows")))
        .groupBy("entity", F.floor(F.col("d") / SHARD_DAYS).cast("int").alias("shard"))
        .agg(F.collect_list("to").alias("to")),
        "corrections",
    )
    keys = ["entity", "shard"]
    blank = {part: F.array_repeat(_zero(trees, part), 2 * SHARD_DAYS) for part in PARTS}
    hit = join_bounded(trees, new, keys)
    fresh = new.join(trees.select(*keys), keys, "left_anti").select(*keys, *(blank[part].alias(part) for part in PARTS), "to")

    def after(part: str) -> Column:
        # Each correction gives its difference to its leaf and all ancestors: leaf, leaf/2, ..., 1.
        spread = F.flatten(
            F.transform(
                F.col("to"),
                lambda x: F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(x["leaf"].alias("leaf"), k.alias("up"), (x[part] - F.col(part)[x["leaf"]]).cast(trees.schema[part].dataType.elementType).alias("by"))),
            )
        )
        at = lambda y: F.floor(y["leaf"] / F.pow(F.lit(2.0), y["up"])).cast("int")
        cast = lambda x: x.cast(trees.schema[part].dataType.elementType)
        moved = lambda old, i: cast(old + F.aggregate(F.filter(spread, lambda y: at(y) == i), _zero(trees, part), lambda a, y: cast(a + y["by"])))
        return F.transform(F.col(part), moved)

    changed = hit.select(*keys, *PARTS, "to").unionByName(fresh).select(*keys, *(after(part).alias(part) for part in PARTS))
    return join_bounded(trees, new.select(*keys), keys, "left_anti").select(*keys, *PARTS).unionByName(changed)


def trailing_totals(trees: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """``total_N``, ``average_N`` and ``valued_days_N`` of each day from an entity's first to its last day.

    The N days end with and include the day. Days without a row or value, and days
    before the first, count 0; ``average_N`` is the total divided by N. Totals
    have the type of the trees' sums. Result:
    ``entity``, ``day`` and these three columns a window. The first and last day
    are those with a row in the trees, whatever its value. N is 1 to 64.
    """
    if not all(1 <= w <= SHARD_DAYS for w in windows):
        raise ValueError("a trailing period has 1 to 64 days")
    w = Window.partitionBy("entity").orderBy("shard")
    taken = F.filter(F.sequence(F.lit(0), F.lit(SHARD_DAYS - 1)), lambda i: F.col("rows")[i + SHARD_DAYS] > 0)
    # Shards without a tree lie between two that have one: each row also stands for those after it.
    spans = (
        trees.withColumns({"low": F.array_min(taken), "high": F.array_max(taken), "next": F.lead("shard").over(w), "first": F.lag("shard").over(w).isNull()})
        .withColumn("at", F.explode(F.sequence("shard", F.coalesce(F.col("next") - 1, "shard"))))
    )
    blank = {part: F.array_repeat(_zero(trees, part), 2 * SHARD_DAYS) for part in PARTS}
    here = spans.withColumns({part: F.when(F.col("at") == F.col("shard"), F.col(part)).otherwise(blank[part]) for part in PARTS})
    order = Window.partitionBy("entity").orderBy("at")
    both = here.withColumns({f"old_{part}": F.coalesce(F.lag(part).over(order), blank[part]) for part in ("sums", "counts")})
    start = F.when(F.col("first") & (F.col("at") == F.col("shard")), F.col("low")).otherwise(0)
    stop = F.when(F.col("next").isNull(), F.col("high")).otherwise(SHARD_DAYS - 1)
    days = both.withColumn("leaf", F.explode(F.sequence(start, stop)))

    def plan(w: int, previous: bool) -> Column:
        """For each day of a shard, the nodes that its period takes from this or the previous shard."""
        rows = [covering_nodes(SHARD_DAYS + i - w + 1, SHARD_DAYS - 1) if previous else covering_nodes(i - w + 1, i) for i in range(SHARD_DAYS)]
        return F.array(*(F.array(*map(F.lit, r)) if r else F.array().cast("array<int>") for r in rows))

    def total(part: str, w: int) -> Column:
        kind = trees.schema[part].dataType.elementType
        add = lambda tree, nodes: F.aggregate(nodes[F.col("leaf")], _zero(trees, part), lambda a, i: (a + F.col(tree)[i]).cast(kind))
        return (add(part, plan(w, False)) + add(f"old_{part}", plan(w, True))).cast(kind)

    out = [F.col("entity"), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("at") * SHARD_DAYS + F.col("leaf")).cast("int")).alias("day")]
    for n in windows:
        out += [total("sums", n).alias(f"total_{n}"), (total("sums", n) / n).alias(f"average_{n}"), total("counts", n).alias(f"valued_days_{n}")]
    return days.select(*out)
