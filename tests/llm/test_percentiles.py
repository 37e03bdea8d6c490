import math
import random

import pytest

from gapline.llm.percentiles import bounds, combine, exact_percentiles, fixed_cell, summarize

SCHEMA = "g string, day int, v double, cell int, n string"
QS = [0.01, 0.25, 0.5, 0.9, 1.0]


def brute(rows, key=lambda r: r[0]):
    out = {}
    for k in {key(r) for r in rows}:
        own = sorted(r[2] for r in rows if key(r) == k and r[2] is not None and math.isfinite(r[2]))
        for q in QS:
            if own:
                out[k, q] = own[max(math.ceil(round(q * len(own), 6)), 1) - 1]
    return out


def values(seed):
    rng = random.Random(seed)
    kinds = [lambda: float(rng.randint(0, 1)), lambda: rng.gauss(0, 1e-6), lambda: rng.lognormvariate(5, 4), lambda: -rng.lognormvariate(0, 9), lambda: rng.choice([1e308, -1e308, 5e-324, 0.0, -0.0]), lambda: 7.0]
    return [(k, rng.randint(1, 5), rng.choice(kinds)(), 1, "") for k in "abc" for _ in range(400)]


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_over_all_scales(spark, seed):
    rows = [*values(seed), *[("one", 1, 4.0, 1, "")], ("a", 1, None, 1, ""), ("a", 1, float("nan"), 1, ""), ("a", 1, float("inf"), 1, ""), ("none", 1, None, 1, "")]
    got = exact_percentiles(spark.createDataFrame(rows, SCHEMA), ["g"], "v", QS).collect()
    assert {(r.g, r.q): r.percentile + 0.0 for r in got} == {k: v + 0.0 for k, v in brute(rows).items()}
    assert all(r.error_bound == 0 for r in got)


def test_days_combine(spark):
    rows = values(3)
    df = spark.createDataFrame(rows, SCHEMA)
    days = summarize(df, ["g", "day"], "v")
    whole = combine(days, ["g"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, summarize(df, ["g"], "v").collect()))
    true = brute(rows)
    for r in bounds(whole, ["g"], QS).collect():
        assert r.low <= true[r.g, r.q] <= r.high
        assert (1 + abs(r.high)) <= (1 + abs(r.low)) * 2 ** (1 / 64) * (1 + 1e-9) or r.low < 0
    again = exact_percentiles(df, ["g"], "v", QS, summary=days)
    assert {(r.g, r.q): r.percentile + 0.0 for r in again.collect()} == {k: v + 0.0 for k, v in true.items()}


def test_cells_are_monotone(spark):
    import pyspark.sql.functions as F

    xs = sorted({s * x for s in (-1, 1) for x in (0.0, 1e-300, 0.5, 1.0, 3.0, 7.0, 15.0, 1e5, 1e300)})
    cells = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "v double").select(fixed_cell(F.col("v"))).collect()]
    assert cells == sorted(cells)


def test_null_groups_and_empty_table(spark):
    got = exact_percentiles(spark.createDataFrame([(None, 1, 2.0, 1, ""), (None, 1, 4.0, 1, ""), ("", 1, 9.0, 1, "")], SCHEMA), ["g"], "v", [0.5]).collect()
    assert {r.g: r.percentile for r in got} == {None: 2.0, "": 9.0}
    assert exact_percentiles(spark.createDataFrame([], SCHEMA), ["g"], "v", QS).collect() == []
