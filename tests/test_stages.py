import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.operators import contracts, diff, inference, perturbations, replays
from gapline.operators.episodes import aligned, assignment, segment_iou
from gapline.sources.files import broken, save, scan_arrow, seal
from gapline.sources.stages import fit_states, load_labels, mixed_value, read_stage, table_metadata, write_submission, write_table


def test_stage_is_read_behind_its_manifest(spark, tmp_path):
    first, second = tmp_path / "one", tmp_path / "two"
    for folder, parents in ((first, []), (second, [str(first / "manifest.json")])):
        folder.mkdir()
        seal(str(folder), folder.name, [save(spark.range(5).toDF("x"), str(folder), "t")], parents)
    assert read_stage(spark, str(second), "t").count() == 5 and broken(str(second)) == []
    with pytest.raises(KeyError):
        read_stage(spark, str(second), "other")
    part = next((first / "t").glob("*.parquet"))
    part.write_bytes(b"changed")
    # A stage isn't sound if one that it builds on isn't.
    assert len(broken(str(second))) == 1
    with pytest.raises(ValueError):
        read_stage(spark, str(second), "t")


def test_metadata_and_mixed_columns(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"x": [1, 2, 3]})
    for name, make in (("file", pa.ipc.new_file), ("stream", pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, make(f, table.schema) as w:
            w.write_table(table)
    assert scan_arrow(spark, [str(tmp_path / "file"), str(tmp_path / "stream")], "x bigint").count() == 6
    assert table_metadata(spark, str(tmp_path / "file"), "arrow") == {"rows": 3, "columns": [["x", "int64"]]}
    df = spark.createDataFrame([(1.5, None), (None, True)], "n double, f boolean")
    write_table(mixed_value(df, "n", "f").withColumn("nothing", F.lit(None)), str(tmp_path / "mixed"))
    assert table_metadata(spark, str(tmp_path / "mixed"), "parquet")["rows"] == 2
    got = spark.read.parquet(str(tmp_path / "mixed"))
    assert sorted(map(str, (r.observed for r in got.collect()))) == ["Row(number=1.5, flag=None)", "Row(number=None, flag=True)"]
    with pytest.raises(Exception, match="exists"):
        write_table(df, str(tmp_path / "mixed"))


def test_labels_break_their_contract(spark, tmp_path):
    good = "subject_id,lifelog_date,sleep_date,S1\na,2024-01-01,2024-01-02,1\na,2024-01-02,2024-01-03,\n"
    (tmp_path / "good.csv").write_text(good)
    assert load_labels(spark, str(tmp_path / "good.csv"), ["S1"]).count() == 2
    for bad in ("a,2024-01-03,2024-01-05,0\n", "a,2024-01-01,2024-01-02,0\n", "a,2024-01-03,2024-01-04,2\n", ",2024-01-03,2024-01-04,1\n"):
        (tmp_path / "bad.csv").write_text(good + bad)
        with pytest.raises(ValueError):
            load_labels(spark, str(tmp_path / "bad.csv"), ["S1"])


def test_submission_is_clipped_and_complete(spark, tmp_path):
    sample = spark.createDataFrame([(1,), (2,)], "id bigint")
    preds = spark.createDataFrame([(1, 0.0), (2, 0.4), (3, 0.5)], "id bigint, p double")
    write_submission(sample, preds, ["id"], ["p"], str(tmp_path / "out"), 0.01)
    assert next((tmp_path / "out").glob("*.csv")).read_text() == "id,p\n1,0.01\n2,0.4\n"
    for broken_ in (preds.where("id = 1"), preds.unionByName(preds)):
        with pytest.raises(ValueError):
            write_submission(sample, broken_, ["id"], ["p"], str(tmp_path / "none"))
    state = fit_states([("a", {"w": [1.0, 2.0]})], spark).first()
    assert json.loads(state.payload) == {"w": [1.0, 2.0]} and len(state.digest) == 64


def test_zoned_times_are_refused(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("no time",), (None,)], "t string")
    assert [str(r.parsed) for r in contracts.naive_timestamps(df, "t").collect()] == ["2024-01-01 10:00:00", "None", "None"]
    for text in ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00+09:00"):
        with pytest.raises(Exception, match="zone"):
            contracts.naive_timestamps(spark.createDataFrame([(text,)], "t string"), "t").collect()
    with pytest.raises(ValueError):
        contracts.naive_timestamps(spark.sql("select current_timestamp() as t"), "t")


def test_assignment_is_the_best_pairing():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 6):
        gain = rng.random((n, n)).round(2)
        best = max(sum(gain[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert abs(sum(gain[i, j] for i, j in enumerate(assignment(gain))) - best) < 1e-9
    reference, predicted = np.array([0, 0, 1, 1, 2, 2]), np.array([1, 1, 0, 0, 0, 0])
    # Two labels for three: the third counts as missed.
    assert abs(segment_iou(reference, predicted, 9) - (1 + 0.5) / 3) < 1e-9 and segment_iou(reference, reference, 3) == 1
    assert (aligned(reference, (reference + 1) % 3, 3) == reference).all()


def test_block_replay_equals_deleting_record_by_record(spark):
    import random

    rng = random.Random(2)
    rows, spans = [], []
    for v in range(6):
        wide = 600_000_000 if v % 2 else 0
        for i in range(40):
            t = rng.randint(0, 80) * 60_000_000
            rows.append((v, v * 100 + i, t, t + wide, float(rng.randint(0, 9)), rng.random() < 0.8))
        for m in range(4):
            at = 0
            for _ in range(rng.randint(0, 3)):
                a = at + rng.randint(1, 20) * 60_000_000
                at = a + rng.randint(1, 15) * 60_000_000
                spans.append((f"{v}-{m}", a, at))
    ts = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    framed = spark.createDataFrame(rows, "view_id bigint, record_id bigint, a bigint, b bigint, v double, ok boolean").select("view_id", "record_id", ts("a").alias("support_start"), ts("b").alias("support_end"), ts(F.expr("(a + b) div 2")).alias("effective_timestamp"), "v", "ok")
    masks = spark.createDataFrame([(v, f"{v}-{m}", "event_support" if v % 2 else "availability") for v in range(6) for m in range(4)], "view_id bigint, seed string, coverage_mode string")
    spans = spark.createDataFrame(spans, "seed string, m0 bigint, m1 bigint")
    fast = {(r.view_id, r.seed): (r.k, round(r.d, 6)) for r in replays.block_replay(framed, masks, spans).collect()}
    gone = replays.deleted_records(framed, masks, spans).join(framed.where("ok"), ["view_id", "record_id"]).groupBy("view_id", "seed").agg(F.count(F.lit(1)).alias("k"), F.sum("v").alias("d"))
    slow = {(r.view_id, r.seed): (r.k, round(r.d, 6)) for r in gone.collect()}
    assert {k: v for k, v in fast.items() if v[0]} == slow and len(slow) > 8


def test_left_out_medians_equal_brute_force(spark):
    import random
    import statistics

    from gapline.functions.robust import others_median_rows

    rng = random.Random(7)
    rows = [(g, rng.choice("abcd"), rng.choice([None, rng.randint(-5, 5) * 0.5, rng.random() * 100])) for g in ("x", None) for _ in range(80)]
    rows += [("x", "hot", rng.random() * 10) for _ in range(150)] + [("one", "a", 1.0)]
    got = {(r.g, r.m): r.med for r in others_median_rows(spark.createDataFrame(rows, "g string, m string, v double"), ["g"], "m", "v", "med", bucket=8).collect()}
    brute = {}
    for g, m in {(r[0], r[1]) for r in rows if r[2] is not None}:
        rest = [r[2] for r in rows if r[0] == g and r[1] != m and r[2] is not None]
        if rest:
            brute[g, m] = statistics.median(rest)
    assert got.keys() == brute.keys() and all(abs(got[k] - brute[k]) < 1e-9 for k in got)


def test_digests_see_schema_order_and_repeats(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a bigint, b string")
    one = diff.tree_digest(df, ["a", "b"]).first()
    assert one == diff.tree_digest(df.orderBy(F.desc("a")).repartition(3), ["a", "b"]).first() and one.n_rows == 50
    for other in (df.withColumn("a", F.col("a").cast("int")), df.unionByName(df.limit(1)), df.withColumn("b", F.when(F.col("a") != 7, F.col("b")))):
        assert diff.tree_digest(other, ["a", "b"]).first().digest != one.digest
    assert diff.differing_rows(df, df.unionByName(df.limit(2))).first() == (0, 2)


def test_sign_flips_beyond_enumeration(spark):
    rows = [("few", str(i), 1.0) for i in range(5)] + [("many", str(i), 1.0 if i % 2 else -1.0) for i in range(40)]
    got = {r.f: r for r in inference.family_inference(spark.createDataFrame(rows, "f string, s string, v double"), "f", "s", "v").collect()}
    assert got["few"].p_value == 2 / 32 and got["many"].p_value > 0.9 and got["few"].adjusted == 4 / 32
    assert inference.family_inference(spark.createDataFrame([], "f string, s string, v double"), "f", "s", "v").collect() == []


def test_applicability_weights_are_not_negative(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(400):
        a, b = rng.random(), rng.random()
        rows.append((rng.choice("pqr"), round(a, 1), round(b, 1), int(rng.random() < 0.1 + 0.8 * a)))
    fitted = perturbations.applicability_model(spark.createDataFrame(rows, "s string, a double, b double, y int"), "s", ["a", "b"], "y")
    assert set(fitted) == {"p", "q", "r"} and all(w[1] > 1 and 0 <= w[2] < w[1] for w in fitted.values())


def test_synthetic_episodes_follow_from_the_seed(spark):
    from gapline.operators.episodes import episode_batch

    one = episode_batch(spark, 5, people=3, days=2).orderBy("participant", "day", "bin").collect()
    assert len(one) == 3 * 2 * 48 and {r.state for r in one} == {0, 1, 2, 3}
    again = episode_batch(spark, 5, people=2, days=2).orderBy("participant", "day", "bin").collect()
    assert again == one[: len(again)] and any(r.d0 is None for r in one) and all(a.state != b.state or a.day != b.day or b.bin == a.bin + 1 for a, b in zip(one, one[1:]))
    far = episode_batch(spark, 5, people=3, days=2, shift=50.0).groupBy("participant").agg(F.avg("d1").alias("m")).collect()
    means = {r.participant: r.m for r in far}
    assert means[2] - means[1] > 40 and means[1] - means[0] > 40
