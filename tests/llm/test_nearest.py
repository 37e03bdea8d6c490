import random
from datetime import datetime, timedelta

from gapline.llm.nearest import nearest_in_time

LEFT = "w bigint, who string, at timestamp_ntz, bucket int"
RIGHT = "r bigint, who string, t timestamp_ntz, bucket int"
T0 = datetime(2024, 1, 1)


def run(spark, left, right, tolerance=300):
    out = nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["who"], "at", "t", "w", "r", tolerance).collect()
    assert len(out) == len({x.w for x in out})
    return {x.w: (x.r, x.seconds) for x in out}


def brute(left, right, tolerance=300):
    out = {}
    for w, who, at, _ in left:
        near = [(abs((t - at).total_seconds()), t, r) for r, k, t, _ in right if None not in (w, who, at, r, k, t) and k == who and abs((t - at).total_seconds()) <= tolerance]
        if near:
            _, t, r = min(near)
            out[w] = (r, (t - at).total_seconds())
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    at = lambda: T0 + timedelta(seconds=rng.randint(0, 40_000))
    left = [(i, rng.choice("ab"), at(), 0) for i in range(150)]
    right = [(i, rng.choice("abc"), at(), 0) for i in range(150)]
    assert run(spark, left + left, right + right) == brute(left, right)


def test_edges_ties_and_nulls(spark):
    s = lambda x: T0 + timedelta(seconds=x)
    left = [(1, "a", s(1000), 0), (2, "a", s(5000), 0), (3, None, s(0), 0), (4, "a", None, 0), (5, "b", s(0), 0), (None, "a", s(1000), 0)]
    right = [(10, "a", s(700), 0), (11, "a", s(1300), 0), (9, "a", s(1300), 0), (12, "a", s(5300.000001), 0), (13, None, s(0), 0), (14, "b", s(300), 0), (15, "b", None, 0)]
    assert run(spark, left, right) == {1: (10, -300.0), 5: (14, 300.0)} == brute(left, right)


def test_empty_tables(spark):
    assert run(spark, [], []) == {} == run(spark, [(1, "a", T0, 0)], [])
