"""Items of varying length into containers of fixed capacity, by linear grouping.

Everything that is decided one step after another works on the histogram of
lengths, which has at most as many entries as the capacity, whatever the number
of items. The items are then placed by their rank among items of equal length.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.staging import join_bounded, materialize

#: Shares of the capacity: items longer than this are large.
LARGE = 0.25
#: Groups into which the large items are cut.
GROUPS = 256
#: Groups for which configurations are optimised.
FEW = 24


def _configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (how many of each size in one container) and how often each is used, so that every need is met.

    ``sizes`` fall. Each round takes the longest size still needed, and with it
    the sizes that leave least room: a bounded knapsack, solved exactly, whose
    reachable sums are the bits of one number. The configuration is used as often
    as the needs allow, so each round ends a size or nearly so.
    """
    left = list(need)
    plan: list[tuple[tuple[int, ...], int]] = []
    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        room = capacity - sizes[first]
        reach, mask, layers = 1, (1 << (room + 1)) - 1, []
        for i in range(first, len(sizes)):
            s, most = sizes[i], min(left[i] - (i == first), room // sizes[i])
            if most > 0:
                layers.append((i, s, most, reach))
                for _ in range(most):
                    reach |= (reach << s) & mask
        config, rest = [0] * len(sizes), reach.bit_length() - 1
        config[first] = 1
        # Back from the shortest size: as few as possible of it, so that long ones are preferred.
        for i, s, most, before in reversed(layers):
            k = next(k for k in range(most + 1) if rest >= k * s and before >> (rest - k * s) & 1)
            config[i] += k
            rest -= k * s
        times = min(left[i] // k for i, k in enumerate(config) if k)
        for i, k in enumerate(config):
            left[i] -= k * times
        plan.append((tuple(config), times))
    return plan


def _dearest(prices: np.ndarray, sizes: list[int], capacity: int) -> np.ndarray:
    """The configuration of one container whose sizes are worth most."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        for i, s in enumerate(sizes):
            if s <= room and best[room - s] + prices[i] > best[room] + 1e-12:
                best[room], last[room] = best[room - s] + prices[i], i
    config, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        config[last[room]] += 1
        room -= sizes[last[room]]
    return config


def _optimised(sizes: list[int], need: list[int], capacity: int, steps: int = 2000) -> list[tuple[tuple[int, ...], int]]:
    """Configurations by linear programming over all of them, rounded down; what rounding leaves is filled by ``_configurations``.

    The programme asks for the fewest containers that meet the needs. Its columns
    are made as they are wanted: the prices of the sizes under the present
    configurations name the one that is worth more than a container, which
    enters, until there is none. Lengths are counted in at most 4,096 units,
    rounded up, so the work doesn't grow with the capacity.
    """
    unit = -(-capacity // 4096)
    small, room = [-(-s // unit) for s in sizes], capacity // unit
    if not sizes or max(small) > room:
        return _configurations(sizes, need, capacity)
    base = np.diag([float(room // s) for s in small])
    wanted = np.array(need, float)
    for _ in range(steps):
        prices = np.linalg.solve(base.T, np.ones(len(sizes)))
        config = _dearest(np.maximum(prices, 0), small, room)
        if config @ prices <= 1 + 1e-9:
            break
        uses, moved = np.linalg.solve(base, wanted), np.linalg.solve(base, config)
        ratio = np.where(moved > 1e-12, uses / np.where(moved > 1e-12, moved, 1), np.inf)
        base[:, int(ratio.argmin())] = config
    times = np.floor(np.maximum(np.linalg.solve(base, wanted), 0) + 1e-7).astype(int)
    left, plan = list(need), []
    for k in range(len(sizes)):
        config = base[:, k].round().astype(int)
        n = min([int(times[k]), *(left[i] // c for i, c in enumerate(config) if c)])
        if n > 0:
            plan.append((tuple(int(c) for c in config), n))
            left = [x - n * int(c) for x, c in zip(left, config)]
    return plan + _configurations(sizes, left, capacity)


def best_packing(histogram: dict[int, int], capacity: int, large: float = LARGE, groups: int = GROUPS, few: int = FEW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The better of two plans: few groups with optimised configurations, and many groups filled one after another; the former where they are equal."""
    return min(plan_packing(histogram, capacity, large, few, _optimised), plan_packing(histogram, capacity, large, groups), key=lambda p: p[1])


def plan_packing(histogram: dict[int, int], capacity: int, large: float = LARGE, groups: int = GROUPS, configure: Callable = _configurations) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the items of each length go, as segments, and the number of containers.

    Segment (length, first rank, last rank, first container, items per container,
    0): items of this length with ranks from first to last fill consecutive
    containers, so many to each. Large lengths are cut into groups of nearly equal
    numbers of items and rounded up to the longest of their group; few-size
    configurations are optimised; the actual items, longest first, take the slots
    of their group. Small items then go, longest first, where they leave least
    room. Lengths are 1 to ``capacity``.
    """
    segments: list[tuple[int, int, int, int, int, int]] = []
    containers = 0
    big = sorted((s for s in histogram if s > capacity * large), reverse=True)
    total = sum(histogram[s] for s in big)
    #: Containers with the same room: room -> list of (first, count).
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if total:
        per = -(-total // groups)
        cuts: list[list[tuple[int, int, int]]] = [[]]  # of each group: (length, first rank, count)
        filled = 0
        for s in big:
            rank, n = 0, histogram[s]
            while n:
                take = min(n, per - filled)
                cuts[-1].append((s, rank, take))
                rank, n, filled = rank + take, n - take, filled + take
                if filled == per:
                    cuts.append([])
                    filled = 0
        cuts = [c for c in cuts if c]
        sizes = [c[0][0] for c in cuts]
        # Neighbouring groups of one length are one size.
        merged: list[list[tuple[int, int, int]]] = []
        for c, s in zip(cuts, sizes):
            if merged and merged[-1][0][0] == s and c[-1][0] == s and merged[-1][-1][0] == s:
                merged[-1] = merged[-1] + c
            else:
                merged.append(list(c))
        sizes = [c[0][0] for c in merged]
        need = [sum(n for _, _, n in c) for c in merged]
        for config, times in configure(sizes, need, capacity):
            # Each slot of the configuration takes the next items of its group, one to a container.
            steps: list[list[tuple[int, int]]] = []  # of each slot: (length, containers), in order
            for g, k in enumerate(config):
                for _ in range(k):
                    wanted, parts = times, []
                    at = containers
                    while wanted:
                        s, rank, n = merged[g][0]
                        take = min(n, wanted)
                        segments.append((s, rank, rank + take - 1, at, 1, 0))
                        parts.append((s, take))
                        at, wanted = at + take, wanted - take
                        if take == n:
                            merged[g].pop(0)
                        else:
                            merged[g][0] = (s, rank + take, n - take)
                    steps.append(parts)
            # Runs of containers with the same room.
            at, done = containers, 0
            cursors = [[0, 0] for _ in steps]
            while done < times:
                run = min(steps[i][c[0]][1] - c[1] for i, c in enumerate(cursors))
                room = capacity - sum(steps[i][c[0]][0] for i, c in enumerate(cursors))
                rooms[room].append((at, run))
                for i, c in enumerate(cursors):
                    c[1] += run
                    if c[1] == steps[i][c[0]][1]:
                        c[0], c[1] = c[0] + 1, 0
                at, done = at + run, done + run
            containers += times
    keys = sorted(r for r in rooms if r)
    for s in sorted((s for s in histogram if s <= capacity * large), reverse=True):
        rank, n = 0, histogram[s]
        while n:
            i = bisect_left(keys, s)
            if i == len(keys):  # open as many new containers as these items fill
                fit = capacity // s
                fresh = max(1, n // fit)
                first, containers = containers, containers + fresh
                if not rooms[capacity]:
                    insort(keys, capacity)
                rooms[capacity].append((first, fresh))
                continue
            room = keys[i]
            first, count = rooms[room].pop()
            if not rooms[room]:
                keys.pop(i)
            each = min(room // s, n)
            used = min(count, n // each)
            segments.append((s, rank, rank + used * each - 1, first, each, 0))
            rank, n = rank + used * each, n - used * each
            for r, where in ((room, (first + used, count - used)), (room - s * each, (first, used))):
                if where[1] and r:
                    if not rooms[r]:
                        insort(keys, r)
                    rooms[r].append(where)
    return segments, containers


def pack(df: DataFrame, ident: str, length: str, capacity: int, large: float = LARGE, groups: int = GROUPS, part_rows: int = 500_000) -> DataFrame:
    """Pack the items of ``df`` into containers of ``capacity``, and never split one that fits.

    Result, one row a piece: ``ident``, ``piece`` (0 unless the item was longer
    than a container), ``piece_start`` (where the piece begins in its item),
    ``piece_length`` and ``container_id`` (from 0, without gaps). An item longer
    than the capacity is cut into pieces of exactly the capacity and a rest. Items
    without length (0, negative or null) take no room and are put into container
    0. Each ident must be there once; it may be null once. An empty table gives
    an empty result. The items of one length are ranked within parts of about
    ``part_rows`` rows, however many items share it: pieces of items longer than
    a container all have its length.
    """
    items = df.select(F.col(ident).alias("item"), F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0))
    pieces = materialize(
        items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .select("item", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("piece_start"), F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).alias("n")),
        "pieces",
    )
    # The most frequent length decides how many parts there are.
    hottest = pieces.groupBy("n").count().agg(F.max("count")).first()[0] or 0
    parts = max(64, -(-hottest // part_rows))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("n", "part").agg(F.count(F.lit(1)).alias("many")).where("n > 0")
    before = counts.withColumn("offset", F.sum("many").over(Window.partitionBy("n").orderBy("part")) - F.col("many"))
    # At most one number for each length up to the capacity.
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("n").agg(F.sum("many")).collect()}
    segments, _ = best_packing(histogram, capacity, large, groups)
    ordered = sorted(segments)
    # Segments of a length lie together: a number's place is sought among the ranks of its length.
    of_length = {}
    for i, (s, *_) in enumerate(ordered):
        first_i, _ = of_length.get(s, (i, i))
        of_length[s] = (first_i, i + 1)

    def place(batches):
        import pandas as pd

        rank0, first, each = (np.array([x[i] for x in ordered], dtype=np.int64) for i in (1, 3, 4))
        for n, rank in batches:
            sizes, ranks = n.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
            at = np.empty(len(sizes), np.int64)
            for s in np.unique(sizes):
                low, high = of_length[int(s)]
                mine = sizes == s
                at[mine] = low + np.searchsorted(rank0[low:high], ranks[mine], side="right") - 1
            yield pd.Series(first[at] + (ranks - rank0[at]) // each[at])

    import typing

    import pandas as pd

    place.__annotations__ = {"batches": typing.Iterator[tuple[pd.Series, pd.Series]], "return": typing.Iterator[pd.Series]}
    placed = (
        join_bounded(pieces.where("n > 0"), before.select("n", "part", "offset"), ["n", "part"])
        .withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("n", "part").orderBy("item", "piece")) - 1)
        .withColumn("container_id", F.pandas_udf(place, "bigint")(F.col("n"), F.col("rank")))
    )
    nothing = pieces.where("n = 0").withColumn("container_id", F.lit(0).cast("bigint"))
    out = ["item", "piece", "piece_start", "n", "container_id"]
    return placed.select(*out).unionByName(nothing.select(*out)).withColumnsRenamed({"item": ident, "n": "piece_length"})
