from gapline.operators.filling import fill, mine, real_day, real_text

SCHEMA = "id bigint, seed string, place string, who string, least int, greatest int"


def test_dependency_is_verified_and_used(spark):
    rows = [(1, "s", "x", "a", 0, 0), (2, "s", "x", None, 0, 0), (3, "s", "y", "a", 0, 0), (4, "t", "y", None, 0, 0), (5, None, "y", None, 0, 0), (6, "u", "z", "b", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mine(df, ["seed"], "who", "id").holds
    out = {r.id: (r.who, r.who_filled, r.who_source) for r in fill(df, "who", "id", [["seed"]]).collect()}
    assert out[2] == ("a", True, "dependency:seed") and out[4] == (None, False, "open") and out[5] == (None, False, "open") and out[1] == ("a", False, "observed")


def test_violated_or_unsupported_dependencies_fall_back_to_groups(spark):
    rows = [(1, "s", "x", "a", 0, 0), (2, "s", "x", "b", 0, 0), (3, "s", "x", None, 0, 0), (4, "t", "q", "c", 0, 0), (5, "t", "w", None, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    d = mine(df, ["seed"], "who", "id")
    assert d.violations == 1 and not d.holds
    out = {r.id: (r.who, r.who_source) for r in fill(df, "who", "id", [["seed"]], [["place"], ["seed"]]).collect()}
    assert out[3] == ("b", "group:place") and out[5] == ("c", "group:seed")
    alone = spark.createDataFrame([(1, "s", "x", "a", 0, 0), (2, "s", "x", None, 0, 0)], SCHEMA)
    assert not mine(alone, ["seed"], "who", "id").holds


def test_empty_and_all_missing(spark):
    assert fill(spark.createDataFrame([], SCHEMA), "who", "id", [["seed"]], [["place"]]).collect() == []
    out = fill(spark.createDataFrame([(1, "s", "x", None, 0, 0)], SCHEMA), "who", "id", [["seed"]], [["place"]]).collect()
    assert out[0].who_source == "open"


def test_stand_ins(spark):
    texts = [(x, n) for x, n in zip([None, "", "  ", "?", "N/A", "unknown", "-", "id0000000", "Na Li"], [None, 0, -1, 99999, 5, 7, 9, 11, 9999])]
    out = spark.createDataFrame(texts, "t string, n bigint").select(real_text("t").alias("t"), real_day("n", [9999, 99999]).alias("n")).collect()
    assert [r.t for r in out] == [None] * 7 + ["id0000000", "Na Li"]
    assert [r.n for r in out] == [None, None, None, None, 5, 7, 9, 11, None]


def test_real_values_that_look_like_stand_ins_stay(spark):
    rows = [("test", 9999), ("0", 99999), ("00x", 999), ("x", 1), ("Null Island", 9)]
    out = spark.createDataFrame(rows, "t string, n bigint").select(real_text("t").alias("t"), real_day("n").alias("n")).collect()
    assert [(r.t, r.n) for r in out] == rows


def test_one_bad_seed_leaves_no_other_mask_open(spark, tmp_path):
    from gapline.plans.core_queries import p3_filled_masks

    rows = [(1, "s", "anna"), (2, "s", "anna"), (3, "s", "not given"), (4, "s", None), (5, "t", "bert"), (6, "t", "bert"), (7, "t", None)]
    data = [(i, seed, "x", "y", 0, who, 3) for i, seed, who in rows]
    spark.createDataFrame(data, "mask_row_id bigint, seed string, primitive string, scenario string, draw int, subject_id string, sensor_day_id bigint").write.parquet(f"{tmp_path}/mask_intervals.parquet")
    out = {r.mask_row_id: (r.subject_id, r.subject_id_source) for r in p3_filled_masks(spark, str(tmp_path)).collect()}
    assert out[4] == ("anna", "group:seed") and out[7] == ("bert", "group:seed") and out[1] == ("anna", "observed")


def test_mining_finds_all_minimal_dependencies(spark):
    import itertools
    import random

    from gapline.operators.filling import mine_all

    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b, c = rng.randint(0, 20), rng.randint(0, 3), rng.randint(0, 5)
        rows.append((i, a, b, c, i, None if rng.random() < 0.2 else f"{a // 2}", None if rng.random() < 0.2 else f"{b}-{c}"))
    df = spark.createDataFrame(rows, "id bigint, a int, b int, c int, own bigint, one string, two string")
    for field, at in (("one", 5), ("two", 6)):
        brute = []
        for size in (1, 2):
            for d in itertools.combinations(range(1, 5), size):
                groups = {}
                for r in rows:
                    if r[at] is not None:
                        groups.setdefault(tuple(r[k] for k in d), []).append(r[at])
                again = sum(len(g) > 1 for g in groups.values())
                if all(len(set(g)) == 1 for g in groups.values()) and again >= 0.1 * len(groups) and again and not any(set(x) <= set(d) for x in brute):
                    brute.append(d)
        names = ("id", "a", "b", "c", "own")
        got = mine_all(df, field, "id", list(names[1:]), probe=7, groups=3)
        assert {d.determinant for d in got} == {tuple(names[k] for k in d) for d in brute}
        assert {d.determinant for d in mine_all(df, field, "id", list(names[1:]))} == {d.determinant for d in got}
    assert mine_all(df.where("false"), "one", "id", ["a", "b"]) == []


def test_support_is_counted_over_all_groups(spark):
    from gapline.operators.filling import Dependency, mine_all

    # The groups that a sample of one in 64 holds have one row each; all repeats lie in others.
    keys = [(r.id, r.h == 0) for r in spark.range(2000).selectExpr("id", "pmod(xxhash64(id), 64) h").collect()]
    single, twice = [k for k, hit in keys if hit], [k for k, hit in keys if not hit][:10]
    assert len(twice) >= 0.1 * (len(single) + len(twice)) and len(single) > 10
    rows = [(i, k, f"v{k % 7}") for i, k in enumerate(single + twice + twice)]
    got = mine_all(spark.createDataFrame(rows, "id bigint, a bigint, v string"), "v", "id", ["a"])
    assert got == [Dependency(("a",), "v", len(single) + 10, 10, 0)]
