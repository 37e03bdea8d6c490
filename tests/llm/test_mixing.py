import random

import pytest

from gapline.llm.mixing import mix, plan_mixture

ITEMS = "id bigint, source string, size bigint, weight double, copies int, rate int"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, items, targets, **kw):
    mixture, report = mix(spark.createDataFrame(items, ITEMS), spark.createDataFrame(targets, TARGETS), "id", "source", "size", **kw)
    return {r.id: r for r in mixture.collect()}, {r.source: r for r in report.collect()}


def items(seed=1):
    rng = random.Random(seed)
    return [(i, s, rng.randint(1, 300), rng.choice([1.0, 0.5]), 0, 0) for i, s in enumerate(["big"] * 2000 + ["mid"] * 300 + ["small"] * 20)]


GOALS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 5), ("gone", 0.05, 2)]


@pytest.mark.parametrize("weight", [None, "weight"])
def test_shares_and_repeats(spark, weight):
    rows = items()
    mixture, report = run(spark, rows, GOALS, weight=weight)
    size = {r[0]: r[2] for r in rows}
    caps = {g[0]: g[2] for g in GOALS}
    assert all(1 <= m.copies <= caps[m.source] and m.size == size[i] for i, m in mixture.items())
    total = sum(m.size * m.copies for m in mixture.values())
    for s, share, cap in GOALS[:3]:
        r = report[s]
        assert r.mixed_size == sum(m.size * m.copies for m in mixture.values() if m.source == s)
        assert abs(r.actual_share - share / 0.95) < 300 / total + 1e-9
    assert report["gone"].actual_share == 0 and report["gone"].mixed_size == 0
    assert report["small"].mixed_size == 5 * report["small"].available_size  # the source that binds


def test_same_seed_same_mixture_and_unequal_chances(spark):
    rows = [(i, "big", 10, 1.0 if i % 2 else 0.25, 0, 0) for i in range(4000)]
    goals = [("big", 1.0, 1)]
    one, _ = run(spark, rows, goals, weight="weight", total=10_000.0)
    two, _ = run(spark, rows[::-1], goals, weight="weight", total=10_000.0)
    other, _ = run(spark, rows, goals, weight="weight", total=10_000.0, seed=8)
    assert set(one) == set(two) != set(other)
    heavy = sum(i % 2 for i in one)
    assert abs(len(one) - 1000) <= 1 and abs(heavy - 800) < 60


def test_nulls_strangers_and_empty_tables(spark):
    rows = [(1, "a", 5, 1.0, 0, 0), (2, None, 5, 1.0, 0, 0), (None, "a", 5, 1.0, 0, 0), (3, "stranger", 5, 1.0, 0, 0), (4, "a", 0, 1.0, 0, 0), (5, "a", None, 1.0, 0, 0)]
    mixture, report = run(spark, rows, [("a", 1.0, 3)])
    assert {i: m.copies for i, m in mixture.items()} == {1: 3} and report["a"].actual_share == 1.0
    assert run(spark, [], [("a", 1.0, 3)])[1]["a"].actual_share == 0.0
    assert run(spark, rows, []) == ({}, {})
    with pytest.raises(ValueError):
        run(spark, rows, [("a", 0.5, 3), ("a", 0.5, 2)])


def test_a_total_that_a_source_cannot_reach():
    plans = {p.source: p for p in plan_mixture([("a", 1.0, 100), ("b", 1.0, 10)], [("a", 0.5, 1), ("b", 0.5, 2)], 100.0)}
    assert plans["a"].wanted == 50 and plans["b"].wanted == 20 and plans["b"].rate == 2.0
