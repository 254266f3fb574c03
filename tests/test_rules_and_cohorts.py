from collections import Counter

import pytest
from pyspark.sql import functions as F

from wavecohort.operators import cohort as C
from wavecohort.operators import rules as U
from wavecohort.operators import tables as T

SCHEMA = "status string, layout_cost double, detected_leads_count int, nonzero_leads_count int, einthoven_score double, avg_pixel_per_mm double, raw_lines_count int"
FEATURES = [c.split()[0] for c in SCHEMA.split(", ")]
SOUND = dict(zip(FEATURES, ("success", 0.07, 11, 12, 0.99, 12.5, 3)))


def beyond(side, limit):
    """A value just past a limit, and the limit itself, which is still allowed."""
    step = 1 if isinstance(limit, int) else 0.004
    return (limit - step if side == "below" else limit + step), limit


def judged(spark, **change):
    return U.quality_gate(spark.createDataFrame([tuple((SOUND | change).values())], SCHEMA)).first()


def test_each_gate_rule_acts_beyond_its_limit_only(spark):
    assert judged(spark).prediction == "accept"
    for feature, side, limit, level, reason in U.GATE:
        past, on = beyond(side, limit)
        r = judged(spark, **{feature: past})
        assert reason in r.reason_codes and r.prediction == ("reject" if level == "critical" else "warn")
        there = [of for f, s, at, of, why in U.GATE if f == feature and (on < at if s == "below" else on > at)]
        assert (judged(spark, **{feature: on}).prediction == "accept") == (not there)


def test_severe_risks_add_up_and_broken_records_are_rejected_first(spark):
    severe = {f: beyond(s, at)[0] for f, s, at, level, _ in U.GATE if level == "severe"}
    two = dict(list(severe.items())[:2])
    assert judged(spark, **two).prediction == "reject" and len(judged(spark, **two).reason_codes) == 2
    assert [judged(spark, **{f: v}).prediction for f, v in two.items()] == ["warn", "warn"]
    assert judged(spark, status="timeout", **two).reason_codes == ["digitization_failed"]
    assert all(judged(spark, **{f: None}).reason_codes == ["invalid_features"] for f in FEATURES[1:])
    assert judged(spark, layout_cost=-0.5).reason_codes == ["invalid_features"]


def test_manifest_rules_and_what_is_built(spark):
    good = ("case_7", "p1", "flat", "tune", "img/a.png", "0" * 64, " True ")
    names = ["case_id", "photo_id", "variant", "split", "path", "sha256", "phi_reviewed"]
    bad = {"case_id": "Ann", "variant": "wild", "split": None, "path": "../up", "sha256": "F" * 64, "phi_reviewed": "1"}
    rows = [good] + [tuple((dict(zip(names, good)) | {"case_id": f"case_{k}", "photo_id": f"q{k}", c: v}).values()) for k, (c, v) in enumerate(bad.items(), 20)]
    rows += [("case_50", "r", "flat", "tune", "x", "1" * 64, "true"), ("case_50", "s", "flat", "test", "y", "2" * 64, "true"), ("case_60", "p1", "flat", "test", "z", "3" * 64, "true")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, " + ", ".join(f"{c} string" for c in names))
    found = {(r.field, r.rule) for r in C.manifest_errors(df, ["flat"], ["tune", "test"], "^case_[0-9]+$").collect()}
    assert found == {("case_id", "pattern"), ("variant", "choice"), ("split", "choice"), ("path", "path"), ("sha256", "digest"), ("phi_reviewed", "flag"), ("split", "leak"), ("photo_id", "repeat")}
    files = spark.createDataFrame([(0, "0" * 64), (9, "3" * 64)], "k long, found string")
    built = C.built_manifest(df, files, "k", ["flat"], ["tune", "test"], "^case_[0-9]+$").collect()
    assert [r.case_id for r in built] == ["case_7"]  # the repeated photo is told of its least case, case_60


def test_places_within_groups_and_quantiles(spark):
    t = spark.range(700).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"))
    places = {}
    for r in C.top_by_hash(t, "id", 1, ["g"]).collect():
        places.setdefault(r.g, []).append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values()) and len(places) == 4
    v = spark.range(301).select(F.when(F.col("id") > 0, F.col("id") * F.col("id") % 97 / 7.0).alias("x"))
    want = [v.select(F.percentile("x", q)).first()[0] for q in (0.0, 0.1, 0.5, 0.77, 1.0)]
    assert C.quantiles(v, "x", [0.0, 0.1, 0.5, 0.77, 1.0]).first().edges == pytest.approx(want)
    assert C.quantiles(v.where("x is null"), "x", [0.5]).first().edges == []


def test_exclusive_members(spark):
    f = spark.createDataFrame([(1, "R", 0, 0.8, True), (1, "L", 1, 0.9, True), (1, "N", 2, 0.7, True), (2, "R", 0, 0.8, True), (2, "L", 1, 0.3, False)], "record_id int, class string, class_idx int, prob double, active boolean")
    g = spark.createDataFrame([("R", "block"), ("L", "block")], "class string, group string")
    kept = {(r.record_id, r["class"]): (r.kept, r.superseded_by) for r in U.exclusive(f, g).collect()}
    assert kept == {(1, "R"): (False, "L"), (1, "L"): (True, None), (1, "N"): (True, None), (2, "R"): (True, None), (2, "L"): (True, None)}


def test_promotion_tolerance_is_inclusive(spark):
    base = {"median_correlation": -0.02, "median_rmse_mv": 0.02, "median_snr_db": -1.0, "median_gain_error": 0.05, "failure_rate": 0.0, "reject_rate": 0.0, "runtime_increase": 0.25}
    schema = "category string, " + ", ".join(f"{k} double" for k in base)
    df = spark.createDataFrame([("a", *base.values()), ("b", *(base | {"median_snr_db": -1.001, "reject_rate": None}).values())], schema)
    assert {(r.category, r.metric) for r in U.promotion_violations(df, ["a", "b", "c"]).collect()} == {("b", "median_snr_db"), ("b", "reject_rate"), ("c", "category")}


def test_split_is_the_same_for_any_order_and_never_leaks(spark):
    rows = spark.range(300).select((F.col("id") % 40).alias("g"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("c"))
    one, two = (C.grouped_split(d, "g", "c", {"train": 0.6, "tune": 0.2, "test": 0.2}).collect() for d in (rows, rows.orderBy(F.desc("id")).repartition(7)))
    assert sorted(one) == sorted(two)
    sizes = {k: sum(r.split == k for r in one) for k in ("train", "tune", "test")}
    assert sum(sizes.values()) == 40 and abs(sizes["train"] - 24) <= 2
    assert C.split_leaks(rows.join(spark.createDataFrame(one), "g"), "g").isEmpty()


def test_largest_remainder(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 11)], "n int")
    got = df.select("n", *[c.alias(k) for k, c in C.allocate_groups(F.col("n"), {"a": 0.5, "b": 0.25, "c": 0.25}).items()]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 0), (2, 1, 1, 0), (3, 1, 1, 1), (10, 5, 3, 2), (11, 5, 3, 3)]


def test_folds_balance_and_keep_patients(spark):
    t = spark.range(480).select((F.col("id") % 400).alias("p"), (F.col("id") % 12 == 0).cast("int").alias("y"))
    f = C.group_folds(t, "p", 5)
    assert f.count() == 400
    rate = [r.positives for r in C.fold_summary(t.join(f.select("p", "fold"), "p"), "p").collect()]
    assert max(rate) - min(rate) <= 3


def test_guards_raise(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, split string")
    with pytest.raises(C.CohortError):
        C.unique(t, ["k"])
    with pytest.raises(C.CohortError):
        C.select_split(t, "train")
    with pytest.raises(C.CohortError):
        C.select_split(t, "test")
    with pytest.raises(C.CohortError):
        C.with_fold(t, spark.createDataFrame([(1, 0)], "k int, fold int"), "k").count()
    with pytest.raises(C.CohortError):
        C.exact_lock(t.where("k = 2"), spark.createDataFrame([(2, 1), (3, 1)], "k int, s int"), "k")
    with pytest.raises(T.SchemaError):
        T.strict_columns(t, ["k"])
    with pytest.raises(C.CohortError):
        T.label_vectors(spark.createDataFrame([(1, "[0,1]"), (2, "[0]")], "k int, l string"), "l", "k", 2)
    with pytest.raises(Exception, match="digest differs"):
        T.expect_hash(spark.createDataFrame([("aa", "bb")], "a string, b string"), "a", "b").collect()


def test_case_control_and_places(spark):
    t = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    picked = C.case_control(t, "id", 2.0)
    assert picked.where("y = 1").count() == 100 and picked.where("y = 0").count() == 200
    assert sorted(r.place for r in C.top_by_hash(t, "id", 1).collect()) == list(range(1, 1001))


def test_content_address_ignores_order_and_sees_change(spark):
    t = spark.range(500).select("id", F.col("id").cast("string").alias("s"))
    a, b, c = (C.content_address(d, ["s", "id"]).first().manifest_id for d in (t, t.orderBy(F.desc("id")).repartition(5), t.withColumn("s", F.when(F.col("id") == 7, "x").otherwise(F.col("s")))))
    assert a == b != c


def test_reports_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "k int, r array<string>")
    T.write_report(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        T.write_report(df, str(tmp_path / "r"))
    T.write_report(df, str(tmp_path / "r"), overwrite=True)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r/csv")).first().r == '["a"]'
    T.write_manifest(df, str(tmp_path / "m"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        T.write_manifest(df, str(tmp_path / "m"))


def test_files(spark, tmp_path):
    for name in ("10.png", "9.png", "b.png", "a.jpg", "a.png"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.stem for r in T.list_files(spark, str(tmp_path), "*.png").collect()] == ["9", "10", "a", "b"]
    cells = tmp_path / "cells"
    cells.mkdir()
    (cells / "armA_f3_s7.json").write_text('{"value": 0.5}')
    assert [(r.arm, r.fold, r.seed, r.value) for r in T.sweep_cells(spark, str(cells)).collect()] == [("armA", 3, 7, 0.5)]


def test_split_sizes_are_exact_for_any_signatures(spark):
    """30 groups of 30 different signatures, and mixes of common and rare ones: exact sizes, every category within its bound."""
    shares = {"train": 0.7, "tune": 0.15, "test": 0.15}
    names = [f"c{k}" for k in range(5)]
    cases = {
        "all different": {g: [n for k, n in enumerate(names) if (g + 1) >> k & 1] for g in range(30)},
        "one signature": {g: ["c0", "c1"] for g in range(17)},
        "rare ones": {g: ["c0"] + (["c1"] if g % 50 == 0 else []) + (["c2"] if g % 7 == 0 else []) for g in range(300)},
    }
    for name, groups in cases.items():
        rows = spark.createDataFrame([(g, c, v) for g, held in groups.items() for c in held for v in range(2)], "g int, c string, v int")
        found = {r.g: r.split for r in C.grouped_split(rows.repartition(5), "g", "c", shares).collect()}
        assert set(found) == set(groups), name
        sizes = Counter(found.values())
        assert sizes == Counter({k: v for k, v in C.share_totals(len(groups), shares).items() if v}), (name, sizes)
        for c in names:
            held = [found[g] for g in groups if c in groups[g]]
            runs = len({tuple(groups[g]) for g in groups if c in groups[g]})
            for split, share in shares.items():
                assert abs(held.count(split) - share * len(held)) <= 2 * runs, (name, c, split)
        rarest = min((c for c in names if any(c in h for h in groups.values())), key=lambda c: (sum(c in h for h in groups.values()), c))
        held = [found[g] for g in groups if rarest in groups[g]]
        assert abs(held.count("train") - 0.7 * len(held)) < 1, name
    assert C.share_totals(30, shares) == {"train": 21, "tune": 5, "test": 4} and C.share_totals(0, shares) == {"train": 0, "tune": 0, "test": 0}
    assert C.grouped_split(rows.limit(0), "g", "c", shares).count() == 0


def test_holdouts_have_the_size_asked_for(spark):
    """Layouts of three rows each get test rows as they come, and the total is exact."""
    rows = spark.createDataFrame([(k, f"l{k % 10}" if k % 10 else None) for k in range(30)], "id int, layout string")
    for share, want in ((0.15, 4), (0.5, 15), (7, 7), (0, 0), (30, 30)):
        out = C.proportional_holdout(rows, "layout", "id", share).collect()
        assert len(out) == 30 and sum(r.split == "test" for r in out) == want
        each = Counter(r.layout for r in out if r.split == "test")
        assert all(abs(each[f"l{k}" if k else None] - want / 10) < 1 for k in range(10))
    with pytest.raises(C.CohortError):
        C.proportional_holdout(rows, "layout", "id", 31)
    assert C.proportional_holdout(rows.limit(0), "layout", "id", 0.5).count() == 0
