"""Hand cases of the study's operators, and all registered SQL on the smallest tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gapline.functions.robust import location_scale, weighted_median, weighted_quantile
from gapline.operators import daily, diff, inference, masks, personal, repair
from gapline.sources import files

FOLDER = "/root/testdata/sf0.001"
REPAIR = "cell int, event_id int, t double, v double, gone boolean"


def series(spark, t, v, gone, **kw):
    df = spark.createDataFrame([(1, i, float(a), None if b is None else float(b), g) for i, (a, b, g) in enumerate(zip(t, v, gone))], REPAIR)
    rows = repair.repaired(df, ["cell"], "t", "v", "gone", **kw).orderBy("event_id").collect()
    return [r.repaired for r in rows], [r.repair_kind for r in rows]


def test_mean_and_majority(spark):
    assert series(spark, [0, 60, 120, 180], [2, None, 6, None], [False, True, False, True], method="mean")[0] == [2, 4, 6, 4]
    values, kinds = series(spark, [0, 1, 2, 3], [0, 1, None, None], [False, False, True, False], method="mean", binary=True)
    assert values == [0, 1, 0, None] and kinds == ["kept", "kept", "filled", "natural_gap"]


def test_locf_has_a_cap_and_real_donors(spark):
    values, kinds = series(spark, [0, 60, 120, 180, 240, 300, 360], [None, 2, None, None, None, None, 10], [True, False, True, True, True, True, False], method="locf", cap=180)
    assert values == [6, 2, 2, 2, 2, 6, 10] and kinds.count("fallback") == 2
    assert series(spark, [0, 2, 4, 6], [2, None, None, 10], [False, True, True, False], method="locf", cap=3)[0][2] == 6


def test_linear_never_extrapolates(spark):
    assert series(spark, [0, 2, 10], [0, None, 100], [False, True, False], method="linear")[0] == [0, 20, 100]
    assert series(spark, range(5), [None, 2, None, 6, None], [True, False, True, False, True], method="linear")[0] == [4, 2, 4, 6, 4]
    assert series(spark, [0, 1, 2, 3], [0, None, None, 12], [False, False, True, False], method="linear")[0] == [0, None, 8, 12]
    assert series(spark, [0, 1], [None, None], [True, True], method="linear")[1] == ["unresolved", "unresolved"]
    with pytest.raises(ValueError):
        series(spark, [0], [1], [False], method="linear", binary=True)


def test_median(spark):
    assert series(spark, [0, 1, 2, 3], [1, None, 3, 100], [False, True, False, False], method="median")[0][1] == 3


def test_weighted_order_statistics(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, 1.0), ("k", 3.0, 2.0), ("k", 9.0, 0.0), ("k", None, 5.0)], "k string, v double, w double")
    assert weighted_quantile(df, ["k"], "v", "w", 0.5, "q").first().q == 2.0
    assert weighted_median(df, ["k"], "v", "w", "m").first().m == 2.5
    r = location_scale(df, ["k"], "v", "w").first()
    assert (r.center, r.n_eff, r.n_rows) == (2.5, 4.0, 3) and abs(r.scale - 1.4826 * 0.5) < 1e-9


def test_supports_overlap_and_instants(spark):
    recs = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 20, 30)], "k int, a int, b int")
    for mask, hit in (((9, 10), [0]), ((10, 11), [10])):
        m = spark.createDataFrame([(1, "s", *mask)], "k int, scenario string, mask_start int, mask_end int")
        assert [r.a for r in masks.deleted_supports(recs, m, ["k"], "a", "b", ["scenario"]).collect()] == hit
    m = spark.createDataFrame([(1, "s", 9, 10)], "k int, scenario string, mask_start int, mask_end int")
    assert masks.deleted(recs, m, ["k"], "a", ["scenario"]).count() == 0


def test_mask_durations_and_repeatability(spark):
    cells = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", date(2024, 1, 1))], "subject_id string, day date")
    one = sorted(map(tuple, masks.block_masks(cells, ["subject_id", "day"], 2, "r").collect()))
    assert one == sorted(map(tuple, masks.block_masks(cells.repartition(3), ["subject_id", "day"], 2, "r").collect()))
    assert all(0 <= r[5] < r[6] <= 1440 for r in one) and {r[6] - r[5] for r in one if r[2] == "contiguous_20pct"} == {288}
    evening = masks.block_masks(cells, ["subject_id", "day"], 2, "r", (1080, 1440)).where("scenario = 'contiguous_20pct'").collect()
    assert {r.mask_end - r.mask_start for r in evening} == {72} and all(r.mask_start >= 1080 for r in evening)


def test_usage_midnight(spark):
    t = lambda d, h, m: datetime(2024, 1, d, h, m)
    df = spark.createDataFrame([(t(2, 0, 0),), (t(2, 0, 5),), (t(2, 0, 10),), (t(3, 0, 0),)], "ts timestamp_ntz")
    out = sorted((r.day, r.effective) for r in daily.interval_end(df, "ts", 10).collect())
    assert out == [(date(2024, 1, 1), t(1, 23, 55)), (date(2024, 1, 2), t(2, 0, 5)), (date(2024, 1, 2), t(2, 23, 55))]


def test_coverage_counts_bins_not_records(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 7.0, 5.0), (1, 12.0, -4.0)], "k int, m double, v double")
    r = daily.coverage(df, ["k"], "m", F.col("v") >= 0, (0, 60), 10).first()
    assert (r.observed_bins, r.longest_gap, r.records) == (1, 50, 3)


def test_conflicting_duplicates(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.0), (2, 0.0), (2, 1.0), (3, 2.0)], "t int, v double")
    assert sorted((r.t, r.v) for r in daily.drop_conflicting(df, ["t"], "v").collect()) == [(1, 0.0), (3, 2.0)]


def test_days_weigh_the_same(spark):
    d = [date(2024, 1, x) for x in (1, 2, 3)]
    df = spark.createDataFrame([("p", d[0], 1.0, 0.0)] * 3 + [("p", d[1], 2.0, 10.0), ("p", d[2], 3.0, 99.0)], "s string, d date, m double, v double")
    out = {r.d: r.donor_mean for r in repair.other_days(repair.day_profiles(df, "s", "d", "m", "v"), "s", "d").collect()}
    assert out[d[2]] == 5.0
    later = spark.createDataFrame([("p", date(2024, 1, 1), 1.0, 30.0), ("p", date(2024, 1, 8), 1.0, 0.0), ("p", date(2024, 1, 15), 1.0, 7.0)], "s string, d date, m double, v double")
    assert abs(repair.recent_days(repair.day_profiles(later, "s", "d", "m", "v"), "s", "d").first().recent_mean - 10) < 1e-9


def test_common_support_and_participants(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0, 4.0), (2, 10.0, 0.0, None), (3, 10.0, 2.0, 1.0)], "k int, M0 double, A double, B double")
    assert [r.gain_A for r in inference.common_gains(df, ["k"], "M0", ["A", "B"]).orderBy("k").collect()] == [5.0, None, 8.0]
    rows = [("a", 9.0)] * 101 + [("b", -3.0), ("c", 2.0), ("d", None)]
    r = inference.participant_summary(spark.createDataFrame(rows, "s string, v double"), "s", "v").first()
    assert (r.n_participants, r.median, r.n_positive) == (3, 2.0, 2)


def test_metrics_and_weights(spark):
    import math

    r = inference.prediction_metrics(spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75)], "k int, y int, p double"), ["k"], "y", "p").first()
    assert abs(r.log_loss + math.log(0.75)) < 1e-12 and r.brier == 0.0625 and r.balanced_accuracy == 1.0
    assert inference.prediction_metrics(spark.createDataFrame([(1, 1, 0.8)] * 2, "k int, y int, p double"), ["k"], "y", "p").first().balanced_accuracy is None
    w = inference.participant_weights(spark.createDataFrame([("a",)] * 3 + [("b",)], "s string"), "s").distinct().orderBy("s").collect()
    assert abs(w[0].weight - 2 / 3) < 1e-12 and w[1].weight == 2.0


def test_sign_flip_and_holm(spark):
    r = inference.sign_flip(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), "v").first()
    assert r.p_value == 0.25
    assert inference.sign_flip(spark.createDataFrame([], "v double"), "v").first().p_value is None
    df = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03), (1, "d", None)], "f int, n string, p double")
    out = {r.n: r.adjusted for r in inference.holm(df, ["f"], "p").collect()}
    assert abs(out["a"] - 0.04) < 1e-12 and abs(out["c"] - 0.09) < 1e-12 and abs(out["b"] - 0.09) < 1e-12 and out["d"] is None


def test_tolerance_is_not_equality(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-10), (2, None), (3, float("nan")), (4, 1.0)], "k int, v double")
    r = diff.compare_tables(a, b, ["k"], ["v"], absolute=1e-8).first()
    assert (r.n_equal, r.n_different, r.n_beyond_tolerance, r.n_unpaired) == (2, 1, 0, 1)
    assert diff.forbidden_columns(spark.createDataFrame([], "S1 int, value int, My_Oracle int")) == ["S1", "My_Oracle"]


def test_scores_are_cut(spark):
    df = spark.createDataFrame([("a", 100.0), ("b", 1.0)], "s string, v double")
    base = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 0.0)], "s string, center double, scale double")
    assert {r.s: r.z for r in personal.scores(df, base, ["s"], "v").collect()} == {"a": 5.0, "b": None}


def test_files_and_manifests(spark, tmp_path):
    import gzip

    import pyarrow as pa

    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    record = files.save(df, str(tmp_path / "out"), "t")
    files.seal(str(tmp_path / "out"), "one", [record])
    assert record["rows"] == 2 and files.broken(str(tmp_path / "out")) == []
    next((tmp_path / "out" / "t").glob("*.parquet")).write_bytes(b"no")
    assert len(files.broken(str(tmp_path / "out"))) == 1
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("a,b\n1,u\n")
    (tmp_path / "x.jsonl").write_text('{"a": 3}\n{"a": 4}\n')
    assert files.scan(spark, str(tmp_path / "x.csv.gz"), "csv", "a int, b string").collect()[0].b == "u"
    assert files.scan(spark, str(tmp_path / "x.jsonl"), "jsonl", "a int").count() == 2
    t = pa.table({"a": [1, 2, 3]})
    for name, writer in (("f", pa.ipc.new_file), ("s", pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / name), "wb") as sink, writer(sink, t.schema) as w:
            w.write_table(t)
    assert files.scan_arrow(spark, [str(tmp_path / "f"), str(tmp_path / "s")], "a bigint").count() == 6


def test_stream_of_daily_loads(spark, tmp_path):
    from gapline.streaming.daily_stream import stream_daily_loads

    rows = [(datetime(2024, 1, d, 12), 1, 2.0) for d in (1, 1, 2, 5)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id bigint, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, user_id bigint, value double").parquet(str(tmp_path / "in"))
    q = stream_daily_loads(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert sorted((r.n, r.total) for r in spark.table("daily").collect()) == [(1, 2.0), (1, 2.0), (2, 4.0)]


def _norm(rows, names):
    def one(v):
        if v is None or v != v:
            return None
        return repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    return sorted(str([one(r[names.index(c)]) for c in sorted(names)]) for r in rows)


def test_all_core_sql_agrees(spark):
    """Every core query with SQL, against DuckDB, on the smallest tables."""
    import glob
    import os

    import duckdb

    from gapline.plans import registry

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    queries, wrong = registry.queries(), []
    for name, sql in registry.oracles().items():
        got = queries[name](spark, FOLDER)
        rel = con.execute(sql)
        names = [c[0] for c in rel.description]
        if sorted(names) != sorted(got.columns) or _norm(rel.fetchall(), names) != _norm([tuple(r) for r in got.collect()], got.columns):
            wrong.append(name)
    assert wrong == []


def test_participants_weigh_the_same_in_each_fold(spark):
    import numpy as np

    from gapline.operators import models

    rng = np.random.default_rng(5)
    rows = [(p, float(a + shift), float(b), int(a * sign + b + rng.normal() > 0)) for p, n, shift, sign in (("a", 300, 2.0, -1), ("b", 20, 0.0, 1), ("c", 25, -1.0, 1), ("d", 15, 0.5, 1)) for a, b in rng.normal(size=(n, 2))]
    got = models.loso_logistic(spark.createDataFrame(rows, "s string, x double, z double, y int"), "s", "y", ["x", "z"]).collect()
    for person in "abcd":
        train, test = [r for r in rows if r[0] != person], [r for r in rows if r[0] == person]
        names = [r[0] for r in train]
        w = np.array([len(train) / (len(set(names)) * names.count(p)) for p in names])
        x, y, held = np.array([r[1:3] for r in train]), np.array([r[3] for r in train]), np.array([r[1:3] for r in test])
        mean = np.average(x, axis=0, weights=w)
        sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
        design = lambda v: np.column_stack([np.ones(len(v)), (v - mean) / sd])  # noqa: E731, B023
        d, beta, ridge = design(x), np.zeros(3), np.diag([0, 0.1, 0.1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-d @ beta))
            beta -= np.linalg.solve((d * (w * p * (1 - p))[:, None]).T @ d / w.sum() + ridge, d.T @ (w * (p - y)) / w.sum() + ridge @ beta)
        want = sorted(1 / (1 + np.exp(-design(held) @ beta)))
        assert np.allclose(sorted(r.probability for r in got if r.s == person), want, atol=1e-5)
        assert all(abs(r.prior - np.average(y, weights=w)) < 1e-9 for r in got if r.s == person)


@pytest.mark.parametrize("binary", [False, True])
def test_cross_day_repair_is_that_of_plain_loops(spark, binary):
    import random
    from statistics import fmean, median

    rng = random.Random(8)
    rows, i = [], 0
    for subject, many in (("p", 12), ("q", 4), ("r", 1)):
        for d in range(many):
            for slot in range(0, 48, 2):
                # Rare slots and sparse days, so that each tier is needed.
                if rng.random() < (0.15 if slot % 10 == 0 else 0.9 - 0.05 * d):
                    for _ in range(rng.randint(1, 2)):
                        v = None if rng.random() < 0.05 else float(rng.random() < 0.5) if binary else rng.randint(0, 50) / 4
                        i += 1
                        rows.append((i, subject, date(2024, 1, 3 + d + (d > 5)), slot * 30 + rng.randint(0, 29) + i / 1e5, v, rng.random() < 0.3))
    rows.append((i + 1, "z", date(2024, 1, 3), 5.0, 1.0, True))
    df = spark.createDataFrame(rows, "event_id long, s string, d date, m double, v double, gone boolean")
    got = {(r.event_id, r.method): (r.repaired, r.repair_tier, r.donors) for r in repair.cross_day(df, "s", "d", "m", "v", "gone", binary=binary).collect()}

    def profile(readings, how):
        slots = {}
        for _, _, _, m, v, _ in readings:
            slots.setdefault(int(m // 30), []).append(v)
        return {k: how(x) for k, x in slots.items()}

    want = {}
    for event, s, d, m, _, gone in rows:
        if not gone:
            continue
        slot = int(m // 30)
        days = {}
        for r in rows:
            if r[1] == s and r[2] != d and r[4] is not None:
                days.setdefault(r[2], []).append(r)
        weight = {x: 2.0 ** (-(d - x).days / 7) for x in days}

        def slot_of(pool, how=fmean, weights=None):
            got = [(profile(days[x], how)[slot], (weights or {}).get(x, 1.0)) for x in pool if slot in profile(days[x], how)]
            if len(got) < 2:
                return None
            return (median(v for v, _ in got) if how is median else sum(v * w for v, w in got) / sum(w for _, w in got)), len(got)

        def all_of(pool, weights=None):
            got = [(fmean(r[4] for r in days[x]), (weights or {}).get(x, 1.0)) for x in pool]
            return (sum(v * w for v, w in got) / sum(w for _, w in got), len(got)) if len(got) >= 2 else None

        week, past = [x for x in days if (x.weekday() >= 5) == (d.weekday() >= 5)], [x for x in days if x < d]
        kept = [r for r in rows if r[1] == s and r[2] == d and not r[5] and r[4] is not None]
        last = (fmean(r[4] for r in kept), 0) if kept else None
        mine, best = profile(kept, fmean), None
        for x in days:
            theirs = profile(days[x], fmean)
            both = set(mine) & set(theirs)
            if len(both) >= 12 and len(both) >= 0.5 * len(mine):
                key = (round(fmean(abs(mine[k] - theirs[k]) for k in both), 9), abs((x - d).days), x > d, x)
                best = min(best or key, key)
        near = min(days[best[3]], key=lambda r: (abs(r[3] - m), r[3])) if best else None
        copy = (near[4], 1) if near and abs(near[3] - m) <= 15 else None
        total = (all_of(days), 3)
        chains = {"all_day": [(all_of(days), 1)], "time_mean": [(slot_of(days), 1), total], "time_median": [(slot_of(days, median), 1), total], "weektype_mean": [(slot_of(week), 1), (slot_of(days), 2), total],
                  "weektype_median": [(slot_of(week, median), 1), (slot_of(days, median), 2), total], "past_time_mean": [(slot_of(past), 1), (all_of(past), 3)],
                  "past_recent_mean": [(slot_of(past, weights=weight), 1), (all_of(past, weight), 3)], "similar_copy": [(copy, 1), (slot_of(days), 2), total]}
        for method, chain in chains.items():
            if not (binary and "median" in method):
                hit = next(((x[0], t, x[1]) for x, t in [*chain, (last, 4)] if x), (None, None, None))
                want[event, method] = (float(hit[0] > 0.5), *hit[1:]) if binary and hit[0] is not None else hit
    assert got.keys() == want.keys() and {w[1] for w in want.values()} == {1, 2, 3, 4, None}
    for k, w in want.items():
        assert got[k][1:] == w[1:] and (got[k][0] is None if w[0] is None else abs(got[k][0] - w[0]) < 1e-9), (k, got[k], w)
    assert any(k[1] == "similar_copy" and w[1] == 1 for k, w in want.items())
