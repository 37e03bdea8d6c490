"""Hand and brute-force cases of phases, windows, episodes, further inference and checked joins."""

from datetime import date

import numpy as np
import pytest

from gapline.operators import episodes, external, inference, phases
from gapline.staging import join_bounded, materialize


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    big = spark.createDataFrame([(i % 7 if i % 11 else None, i) for i in range(500)], "k int, v int")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(4)], "k int, name string")
    one = join_bounded(big, small, ["k"], how)
    two = join_bounded(big, small, ["k"], how, salts=5, max_bytes=1)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_materialized_tables_lie_in_the_sessions_folder(spark):
    df = materialize(spark.createDataFrame([(1, None)], "a int, b string"), "x")
    assert f"{spark.conf.get('spark.checkpoint.dir')}/gapline/x-" in df.inputFiles()[0] and df.count() == 1
    assert df.schema.simpleString() == "struct<a:int,b:string>"


def test_median_of_the_others(spark):
    rng = np.random.default_rng(1)
    rows = [(g, f"m{i}", float(v)) for g, n in (("a", 7), ("b", 8), ("c", 2), ("d", 1)) for i, v in enumerate(rng.integers(0, 6, n))]
    out = {(r.g, r.m): r.o for r in phases.others_median(spark.createDataFrame(rows, "g string, m string, v double"), ["g"], "m", "v", "o").collect()}
    for g, m, _ in rows:
        others = [x[2] for x in rows if x[0] == g and x[1] != m]
        assert out[g, m] == (float(np.median(others)) if others else None)


def test_additive_repair_needs_every_template(spark):
    observed = spark.createDataFrame([("p", 10.0), ("q", 1.0)], "k string, observed_sum double")
    masks = spark.createDataFrame([("p", 15, 75), ("q", 0, 60)], "k string, mask_start int, mask_end int")
    template = spark.createDataFrame([("p", 0, 4.0), ("p", 1, 6.0), ("p", 2, 8.0), ("q", 0, 1.0)], "k string, phase_bin int, template double")
    out = {r.k: r.repaired_sum for r in phases.additive_repair(observed, masks, template, ["k"]).collect()}
    assert out == {"p": 10 + 2 + 6 + 4, "q": None}


def test_window_features_of_known_arrays(spark):
    df = spark.createDataFrame([("e", 0.0), ("e", 2.0), ("e", 4.0), ("e", None)], "k string, v double")
    r = external.window_features(df, ["k"], "v").first()
    assert (r.n, r.mean, r.median) == (3, 2.0, 2.0) and abs(r.sd - (8 / 3) ** 0.5) < 1e-12 and abs(r.p90 - 3.6) < 1e-12


def test_a_fifth_of_thirteen_records_is_two(spark):
    df = spark.createDataFrame([("x", i, i) for i in range(13)] + [("tiny", 0, 99)], "k string, t int, id int")
    out = external.index_masks(df, ["k"], "t", "id", "r").collect()
    block = sorted(r.id for r in out if r.in_block)
    assert len(block) == 2 and block[1] == block[0] + 1 and sum(r.in_scatter for r in out) == 2


def test_anchors_are_spaced(spark):
    rows = [("a", s) for s in (0, 100, 3599, 3600, 7000, 7300, 20_000)]
    assert sorted(r.anchor for r in external.spaced_anchors(spark.createDataFrame(rows, "s string, t bigint"), "s", "t", 3600).collect()) == [0, 3600, 7300, 20_000]


def brute_path(score, initial, transition, duration):
    steps, states = score.shape
    most = duration.shape[1]
    best = (-np.inf, None)

    def go(t, last, path, value):
        nonlocal best
        if t == steps:
            if value > best[0] + 1e-12:
                best = (value, path)
            return
        for s in range(states):
            come = initial[s] if last is None else transition[last, s]
            for d in range(1, min(most, steps - t) + 1):
                stay = np.logaddexp.reduce(duration[s, d - 1 :]) if t + d == steps else duration[s, d - 1]
                go(t + d, s, [*path, *[s] * d], value + come + stay + score[t : t + d, s].sum())

    go(0, None, [], 0.0)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    score = rng.standard_normal((6, 2))
    log = lambda m: np.log(m / m.sum(-1, keepdims=True))
    initial, transition, duration = log(rng.random(2) + 0.1), log(rng.random((2, 2)) + 0.1), log(rng.random((2, 3)) + 0.1)
    value, _ = brute_path(score, initial, transition, duration)
    path = episodes.viterbi(score, initial, transition, duration)
    # The path may be segmented in more than one way: its best value must be the best of all.
    got = -np.inf
    for cut in range(1 << 5):
        edges = [0, *[i + 1 for i in range(5) if cut >> i & 1], 6]
        runs = list(zip(edges, edges[1:]))
        if any(len(set(path[a:b])) > 1 or b - a > 3 for a, b in runs):
            continue
        v = initial[path[0]]
        for n, (a, b) in enumerate(runs):
            v += transition[path[a - 1], path[a]] if n else 0
            v += (np.logaddexp.reduce(duration[path[a], b - a - 1 :]) if b == 6 else duration[path[a], b - a - 1]) + score[a:b, path[a]].sum()
        got = max(got, v)
    assert abs(got - value) < 1e-9


def test_episodes_are_recovered():
    rng = np.random.default_rng(2)
    truth = np.repeat(rng.permutation(np.arange(40) % 3), 5)[:180]
    x = np.c_[truth * 4.0, -truth * 3.0] + rng.standard_normal((len(truth), 2)) * 0.4
    x[rng.random(x.shape) < 0.1] = np.nan
    parts = [x[:90], x[90:]]
    model = episodes.fit(parts, 3)
    path = np.concatenate([episodes.viterbi(episodes.emission(model, p), model.initial, model.transition, model.duration) for p in parts])
    assert episodes.segment_iou(truth, path, 3) > 0.95
    assert (episodes.certified(truth, [truth, (truth + 1) % 3], 3) == truth).all()
    assert episodes.select_states(parts, (3, 5)) == 3
    assert episodes.boundary_f1(np.array([1, 5, 9]), np.array([2, 5, 20])) == 4 / 6 and episodes.boundary_f1(np.array([]), np.array([])) == 1.0


def test_residual_correlation_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{i % 5}", date(2024, 1, 1), *map(float, rng.standard_normal(2)), float(i), float(i % 3)) for i in range(100)]
    rows = [(s, d, x + 0.1 * t, y + 0.2 * t - u, t, u) for s, d, x, y, t, u in rows]
    got = inference.residual_correlation(spark.createDataFrame(rows, "s string, d date, x double, y double, t double, u double"), "s", "x", "y", ["t", "u"]).first().r
    names, m = np.array([r[0] for r in rows]), np.array([r[2:] for r in rows])
    for s in set(names):
        m[names == s] -= m[names == s].mean(0)
    sums = np.zeros(3)
    for s in sorted(set(names)):
        own, rest = m[names == s], m[names != s]
        beta = np.linalg.lstsq(rest[:, 2:], rest[:, :2], rcond=None)[0]
        e = own[:, :2] - own[:, 2:] @ beta
        sums += [(e[:, 0] ** 2).sum(), (e[:, 1] ** 2).sum(), (e[:, 0] * e[:, 1]).sum()]
    assert abs(got - sums[2] / np.sqrt(sums[0] * sums[1])) < 1e-9


def test_calibration_of_exact_odds(spark):
    rows = [(y, p) for p, ones in ((0.2, 20), (0.5, 50), (0.8, 80)) for y in [1] * ones + [0] * (100 - ones)]
    r = inference.calibration(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
    assert abs(r.intercept) < 1e-6 and abs(r.slope - 1) < 1e-6
    assert inference.calibration(spark.createDataFrame([(1, 0.5)], "y int, p double"), "y", "p").first().slope is None
