import random
from datetime import date, timedelta

from gapline.operators.trailing import build_trees, correct_trees, covering_nodes, trailing_totals

SCHEMA = "who string, at date, n bigint, entity int, sums string"


def brute(rows, windows=(7, 30)):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None and r[1] is not None}:
        own = [(d, n) for kk, d, n, *_ in rows if kk == k and d is not None]
        d, last = min(o[0] for o in own), max(o[0] for o in own)
        while d <= last:
            out[k, d] = tuple(sum(n or 0 for dd, n in own if d - timedelta(days=w) < dd <= d) for w in windows)
            d += timedelta(days=1)
    return out


def test_nodes_cover_exactly():
    for low in range(0, 64, 5):
        for high in range(low, 64, 3):
            leaves = []
            for n in covering_nodes(low, high):
                span = [n]
                while span[0] < 64:
                    span = [c for s in span for c in (2 * s, 2 * s + 1)]
                leaves += span
            assert sorted(leaves) == list(range(64 + low, 64 + high + 1))
    assert covering_nodes(5, 4) == []


def rows_of(seed):
    rng = random.Random(seed)
    return [(rng.choice("abc"), date(2023, 12, 1) + timedelta(days=rng.choice([rng.randint(0, 90), rng.randint(300, 340)])), rng.choice([None, 0, 5, 100]), 1, "x") for _ in range(120)]


def test_totals_equal_brute_force_over_missing_days_and_shards(spark):
    rows = [*rows_of(1), (None, date(2024, 1, 1), 5, 1, ""), ("a", None, 5, 1, ""), ("single", date(2024, 2, 29), None, 1, "")]
    got = trailing_totals(build_trees(spark.createDataFrame(rows, SCHEMA), "who", "at", "n")).collect()
    assert {(r.entity, r.day): (r.total_7, r.total_30) for r in got} == brute(rows)
    assert all(abs(r.average_30 - r.total_30 / 30) < 1e-12 for r in got)


def test_corrections_equal_a_rebuild(spark):
    rows = rows_of(2)
    days = sorted({(r[0], r[1]) for r in rows})
    fixed = {days[3]: 77, days[10]: None, ("b", date(2026, 6, 1)): 9, ("new", date(2024, 3, 3)): 4}
    trees = correct_trees(build_trees(spark.createDataFrame(rows, SCHEMA), "who", "at", "n"), spark.createDataFrame([(k, d, n, 1, "") for (k, d), n in fixed.items()], SCHEMA), "who", "at", "n")
    after = [r for r in rows if (r[0], r[1]) not in fixed] + [(k, d, n, 1, "") for (k, d), n in fixed.items()]
    again = build_trees(spark.createDataFrame(after, SCHEMA), "who", "at", "n")
    key = lambda df: sorted((r.entity, r.shard, r.sums, r.counts, r.rows) for r in df.collect())
    assert key(trees) == key(again)


def test_empty_table(spark):
    assert trailing_totals(build_trees(spark.createDataFrame([], SCHEMA), "who", "at", "n")).collect() == []


def test_fractions_and_decimals_are_kept(spark):
    from decimal import Decimal

    rows = [("a", date(2024, 1, 1), 0.7), ("a", date(2024, 1, 2), 1.9), ("a", date(2024, 3, 1), None)]
    got = {r.day: r for r in trailing_totals(build_trees(spark.createDataFrame(rows, "who string, at date, n double"), "who", "at", "n")).collect()}
    assert got[date(2024, 1, 2)].total_7 == 0.7 + 1.9 and abs(got[date(2024, 1, 2)].average_30 - 2.6 / 30) < 1e-12
    exact = [(k, d, None if n is None else Decimal(str(n))) for k, d, n in rows]
    trees = build_trees(spark.createDataFrame(exact, "who string, at date, n decimal(12,2)"), "who", "at", "n")
    assert {r.day: r.total_7 for r in trailing_totals(trees).collect()}[date(2024, 1, 2)] == Decimal("2.60")
    fixed = correct_trees(trees, spark.createDataFrame([("a", date(2024, 1, 1), Decimal("0.05"), "x")], "who string, at date, n decimal(12,2), sums string"), "who", "at", "n")
    assert {r.day: r.total_7 for r in trailing_totals(fixed).collect()}[date(2024, 1, 2)] == Decimal("1.95")
