import random
from datetime import datetime, timedelta

import pytest

from gapline.operators.spikes import SpikeSettings, implausible_readings, in_sequence

SCHEMA = "record_id bigint, view_id bigint, subject_id string, sensor_file string, effective_timestamp timestamp_ntz, raw_value double, raw_validity double, t string, y string, hour string"
T0 = datetime(2024, 1, 1)


def rows(values, sensor="wHr_x", view=1, start=0, first=0, validity=None):
    return [(first + i, view, "p", sensor, T0 + timedelta(minutes=start + i), v, validity, "", "", "") for i, v in enumerate(values)]


def flags(spark, data):
    return {r.record_id: r for r in implausible_readings(spark.createDataFrame(data, SCHEMA)).collect()}


def test_rules_runs_and_excursions(spark):
    rng = random.Random(1)
    hr = [70 + rng.uniform(-3, 3) for _ in range(400)]
    hr[50] = 140.0  # one reading
    hr[100], hr[101] = 25.0, 24.0  # two readings
    for i in range(200, 240):
        hr[i] += 50  # a sustained change
    hr[300:307] = [71.5] * 7  # stuck
    hr[350], hr[351], hr[352] = None, float("nan"), 0.0
    hr[360:365] = [66.6] * 5
    got = flags(spark, rows(hr) + rows([0.0, 1.0, 0.5, None, float("inf")], "mActivity_x", 2, 0, 1000, 1.0) + rows([1.0], "mActivity_x", 3, 0, 2000, 2.0))
    assert {k for k, r in got.items() if r.excursion} == {50, 100, 101}
    assert {k for k, r in got.items() if r.stuck} == set(range(300, 307))
    assert {k for k, r in got.items() if r.impossible_value} == {352, 1002, 1004}
    assert {k for k, r in got.items() if r.impossible_validity} == {2000}


def test_repeated_deliveries_and_nulls(spark):
    data = rows([10.0] * 8, "mLight_x")
    data += data + [(900, None, None, None, None, None, None, "", "", ""), (901, None, "p", "wHr_x", None, -5.0, 7.0, "", "", ""), (902, 5, "p", "mLight_x", T0, -1.0, float("nan"), "", "", "")]
    got = flags(spark, data)
    assert {k for k, r in got.items() if r.stuck} == set(range(8))
    assert got[901].impossible_value and got[901].impossible_validity and got[902].impossible_value and not got[902].impossible_validity and 900 not in got


@pytest.mark.parametrize("hours", [1, 2, 5])
def test_sequence_across_shards_equals_brute_force(spark, hours):
    rng = random.Random(hours)
    data, rid = [], 0
    for view in (1, 2, 3):
        t = 0
        for _ in range(60):
            t += rng.choice([1, 5, 40, 90, 200])
            data.append((rid, view, t * 60_000_000, float(rng.choice([1, 1, 1, 2]))))
            rid += 1
    df = spark.createDataFrame([(i, v, t, x, x) for i, v, t, x in data], "record_id bigint, view_id bigint, t bigint, v double, y double")
    got = {r.record_id: r for r in in_sequence(df, SpikeSettings(shard_hours=hours)).collect()}
    for view in (1, 2, 3):
        own = sorted((t, i, x) for i, v, t, x in data if v == view)
        x = [o[2] for o in own]
        at = lambda k: x[k] if 0 <= k < len(x) else None  # noqa: E731, B023
        for k, (_, i, _) in enumerate(own):
            a = b = k
            while a > 0 and x[a - 1] == x[k]:
                a -= 1
            while b + 1 < len(x) and x[b + 1] == x[k]:
                b += 1
            r = got[i]
            assert (r.p1, r.p2, r.n1, r.n2, r.run_length) == (at(k - 1), at(k - 2), at(k + 1), at(k + 2), b - a + 1)


def test_empty_table(spark):
    assert flags(spark, []) == {}
