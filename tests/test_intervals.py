import random
from datetime import datetime, timedelta

import pytest

from gapline.operators.intervals import periods_and_gaps

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, s timestamp_ntz, e timestamp_ntz, shard int, span_kind string"


def brute(rows):
    out = set()
    keys = {r[0] for r in rows if r[0] is not None}
    for k in keys:
        own = sorted((s, e) for kk, s, e, *_ in rows if kk == k and s is not None and e is not None and s < e)
        merged = []
        for s, e in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed,shard", [(1, 120), (2, 30), (3, 7)])
def test_random_intervals_equal_brute_force(spark, seed, shard):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        s = T0 + timedelta(minutes=rng.randint(0, 3000))
        rows.append((rng.choice(["a", "b", "c"]), s, s + timedelta(minutes=rng.choice([0, 1, 5, 30, 120, 240])), 1, "x"))
    assert run(spark, rows, shard_minutes=shard) == brute(rows)


def test_touching_nested_repeated_and_broken_rows(spark):
    m = lambda x: T0 + timedelta(minutes=x)
    rows = [
        ("a", m(0), m(120), 1, ""), ("a", m(120), m(240), 1, ""),  # touch at a shard border
        ("a", m(10), m(20), 1, ""), ("a", m(10), m(20), 1, ""), ("a", m(500), m(500), 1, ""), ("a", m(700), m(600), 1, ""),
        ("a", None, m(900), 1, ""), ("a", m(901), None, 1, ""), (None, m(0), m(1), 1, ""), ("a", m(300), m(301), 1, ""), ("b", m(5), m(6), 1, ""),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert ("a", "period", m(0), m(240)) in got and ("a", "gap", m(240), m(300)) in got


def test_one_long_interval_over_many_shards(spark):
    rows = [("a", T0, T0 + timedelta(days=30), 1, ""), ("a", T0 + timedelta(days=31), T0 + timedelta(days=32), 1, "")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == set()
