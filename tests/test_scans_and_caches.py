import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.operators import caches as K
from wavecohort.operators import manifests as N
from wavecohort.operators import models as L
from wavecohort.operators import scans as A
from wavecohort.operators import signal as G
from wavecohort.operators import cohort as C


def test_csv_lines_are_good_or_rejected_with_a_reason(spark, tmp_path):
    lines = ["ecg_id,codes,age", "1,\"{'A': 100.0, 'B': 0}\",61", "2,,50", "x,{},40", ",{},40", "4,{'A': 1,30", "5,{'A': 'high'},30", "6,{'A': 1}{,30", "7,{},thirty", "8,{},30,9", "9,{},", '10,"{""N"": -.5e1}",7']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text(lines[0] + "\n")
    good, rejects = A.metadata_csv(spark, str(tmp_path), "ecg_id int, codes string, age int", "ecg_id", "codes")
    assert {r.ecg_id: r.codes for r in good.collect()} == {1: {"A": 100.0, "B": 0.0}, 2: None, 9: {}, 10: {"N": -5.0}}
    assert sorted((r.line.split(",")[0], r.reason) for r in rejects.collect()) == [("", "key"), ("4", "literal"), ("5", "literal"), ("6", "literal"), ("7", "value"), ("8", "line"), ("x", "value")]
    assert {r.file for r in rejects.collect()} == {"a.csv"}
    assert good.select("ecg_id").count() == good.count() == 4 and rejects.count() == 7  # whatever is selected


def test_literals_are_read_whole_or_not_at_all(spark):
    texts = ["{}", " { 'a' : 1. , \"it's\": +.5 , } ", "{'a': 1, 'a': 2}", "{'a: 3, b': 4e1}", "{'a': }", "{'a': 1 'b': 2}", "{'\\'': 1}", "{'a': 1}x", "", None, "{1: 2}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r.m for r in df.select("k", A.number_map(F.col("t")).alias("m")).orderBy("k").collect()]
    assert got == [{}, {"a": 1.0, "it's": 0.5}, {"a": 2.0}, {"a: 3, b": 40.0}] + [None] * 7


def test_sweep_files_and_rejects(spark, tmp_path):
    for name, text in {"armA_f3_s7.json": '{"ap": 0.5,\n "auroc": 1}', "armB_f0_s1.json": '{"ap": ', "other.json": '{"ap": 1, "auroc": 1}', "armB_f0_s2.json": '{"ap": 1}', "armB_f0_s3.json": '{"ap": "x", "auroc": 1}'}.items():
        (tmp_path / name).write_text(text)
    good, rejects = A.sweep_files(spark, str(tmp_path), "ap double, auroc double")
    assert [tuple(r) for r in good.collect()] == [("armA", 3, 7, 0.5, 1.0)]
    assert sorted((r.file.rpartition("/")[2], r.reason) for r in rejects.collect()) == [("armB_f0_s1.json", "json"), ("armB_f0_s2.json", "field"), ("armB_f0_s3.json", "json"), ("other.json", "name")]


WAYS = "k int, version string, mode string, digest string, hint string"


def test_a_refresh_makes_only_what_changed(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def make(rows):
        def count(batches):
            for b in batches:
                asked.add(len(b))
                yield b

        return rows.mapInPandas(count, rows.schema).where("k != 5").select("k", F.concat("digest", F.lit("!")).alias("value"), F.when(F.col("digest") == "bad", "broken").alias("error"))

    first = [(k, "1", "m", "bad" if k == 3 else "d", None) for k in range(6)]
    assert K.versions(spark, path) == [] and K.refresh(spark.createDataFrame(first, WAYS), path, "k", make) == 1 and asked.value == 6
    old = K.values(spark, path, "k")
    assert {r.k: (r.value, r.refresh) for r in old.collect()} == {k: ("d!", 1) for k in (0, 1, 2, 4)}
    assert {r.k: r.error for r in K.failures(spark, path, "k").collect()} == {3: "broken", 5: "left out"}
    second = [(0, "1", "m", "d", None), (1, "2", "m", "d", None), (2, "1", "m", "e", None), (3, "1", "m", "d", None), (4, "1", "m", "d", "h"), (7, "1", "m", "d", None)]
    asked.value = 0
    assert K.refresh(spark.createDataFrame(second, WAYS), path, "k", make) == 2 and asked.value == 5
    assert {r.k: (r.value, r.refresh) for r in K.values(spark, path, "k").collect()} == {0: ("d!", 1), 1: ("d!", 2), 2: ("e!", 2), 3: ("d!", 2), 4: ("d!", 2), 7: ("d!", 2)}
    assert K.failures(spark, path, "k").count() == 0
    assert old.count() == 4 and K.failures(spark, path, "k", 1).count() == 2  # older versions stay whole
    asked.value = 0
    assert K.refresh(spark.createDataFrame(second, WAYS), path, "k", make) == 3 and asked.value == 0
    with pytest.raises(K.CacheConflict):
        K._publish(spark, path, f"{path}/version-1", 3)
    with pytest.raises(C.CohortError):
        K.refresh(spark.createDataFrame(second + second[:1], WAYS), path, "k", make)


def test_tasks_of_a_cache_have_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "ROWS", 50, raising=False)
    path, plans = str(tmp_path / "cache"), []

    def make(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.select("k", F.concat("digest", F.lit("!")).alias("value"), F.when(F.col("k") % 7 == 0, "broken").alias("error"))

    for digest in ("d", "e"):
        K.refresh(spark.range(400).select(F.col("id").cast("int").alias("k"), F.lit("1").alias("version"), F.lit("m").alias("mode"), F.when(F.col("id") % 3 == 0, digest).otherwise("c").alias("digest"), F.lit(None).cast("string").alias("hint")), path, "k", make)
    found = K.values(spark, path, "k")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.k: (r.value, r.refresh) for r in found.collect()} == {k: ("e!", 2) if k % 3 == 0 else ("c!", 1) for k in range(400) if k % 7}
    assert found.rdd.getNumPartitions() == 1 + (400 + 134 + 39) // 50  # the first part, what changed, what had failed
    for p in plans[1:]:  # files are small enough to be broadcast, and partitions to be put together
        assert "SortMergeJoin" in p and "Broadcast" not in p and "ENSURE_REQUIREMENTS" not in p
    for folder in ("version-1", "version-2"):
        assert max(r["count"] for r in spark.read.parquet(f"{path}/{folder}").groupBy(F.input_file_name()).count().collect()) <= 100


def test_an_empty_cache_has_no_values(spark, tmp_path):
    path = str(tmp_path / "cache")
    K.refresh(spark.createDataFrame([], WAYS), path, "k", lambda rows: rows.select("k", F.lit(1).alias("value"), F.lit(None).cast("string").alias("error")))
    assert K.values(spark, path, "k").count() == 0


def _manifest(spark, change=lambda k, row: row, n=20, drop=(), more=()):
    rows = []
    for k in range(n):
        sha = f"{k:064x}"
        row = {"case_id": f"case{k:03}", "photo_id": f"p{k}", "variant": "front", "layout": "3x4", "device_model": f"d{k % 2}", "printer_model": "p", "photo_path": f"img/{k}.png", "photo_sha256": sha, "reference_type": "flatbed_scan", "reference_path": f"ref/{k}", "reference_sha256": sha, "split": ("tune", "test")[k % 2], "phi_reviewed": "true"}
        rows.append(change(k, row))
    names = [c for c in N.REQUIRED if c not in drop] + list(more)
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"{c} string" for c in names))


def found(df, **more):
    return {(r.subject, r.field, r.rule) for r in N.violations(df, **more).collect()}


def test_a_sound_manifest_breaks_no_rule(spark):
    m = _manifest(spark)
    assert found(m) == set()
    s = {(r.part, r.value): r.n for r in N.summary(m).collect()}
    assert s[("cases", "")] == 20 and s[("sources", "")] == 2 and s[("split_cases", "test")] == 10 and s[("variant", "front")] == 20


def test_rules_of_columns_and_of_the_set(spark):
    assert found(_manifest(spark, drop=["layout", "split"])) == {("", "layout", "missing"), ("", "split", "missing")}
    assert found(_manifest(spark, more=["barcode"])) == {("", "barcode", "forbidden")}
    empty = {("", "case_id", "too_few"), ("", "device_model", "too_few"), ("tune", "split", "empty_split"), ("test", "split", "empty_split")}
    assert found(_manifest(spark, n=0)) == empty
    assert found(_manifest(spark, lambda k, r: r | {"split": "tune", "device_model": "d"})) == {("", "device_model", "too_few"), ("test", "split", "empty_split")}


def test_a_split_is_empty_if_its_cases_are_in_others_too(spark):
    rules = N.SetRules(least_cases=1)
    shared = _manifest(spark, lambda k, r: r | {"case_id": f"case{k // 2:03}"}).withColumn("reference_sha256", F.lit("0" * 64))  # each case has a row in either split
    assert found(shared, rules=rules) == {(f"case{k:03}", "split", "leak") for k in range(10)} | {("tune", "split", "empty_split"), ("test", "split", "empty_split")}
    one = shared.unionByName(_manifest(spark, lambda k, r: r | {"case_id": "case099", "photo_id": "p99", "split": "tune"}, n=1))
    assert {x for x in found(one, rules=rules) if x[2] == "empty_split"} == {("test", "split", "empty_split")}


def test_every_error_of_rows_cases_and_files_is_told_at_once(spark):
    broken = {0: {"case_id": "Ann"}, 1: {"phi_reviewed": None}, 2: {"variant": "x"}, 3: {"reference_type": None}, 4: {"split": "other"}, 5: {"layout": " "}, 6: {"photo_path": "../a"}, 7: {"reference_sha256": "F" * 64}, 8: {"photo_id": "p9"}, 10: {"case_id": "case011", "split": "tune"}, 12: {"reference_path": "/x"}}
    rule = {(f"case{k:03}", c, r) for k, c, r in [(1, "phi_reviewed", "flag"), (2, "variant", "choice"), (3, "reference_type", "choice"), (4, "split", "choice"), (5, "layout", "empty"), (6, "photo_path", "path"), (7, "reference_sha256", "digest"), (11, "split", "leak"), (11, "reference_sha256", "references"), (12, "reference_path", "path")]}
    m = _manifest(spark, lambda k, r: r | broken.get(k, {}))
    assert found(m) == rule | {("Ann", "case_id", "pattern"), ("p9", "photo_id", "repeat"), ("", "case_id", "too_few")}
    files = spark.createDataFrame([(f"img/{k}.png", f"{k + (k == 13):064x}") for k in range(20) if k != 14] + [(f"ref/{k}", f"{k:064x}") for k in range(20)] * 2, "path string, found string")
    assert found(m, files=files) - found(m) == {("case013", "photo_sha256", "differs"), ("case014", "photo_path", "absent")}


def plain_newton(x, y, rounds=40):
    mean, std = x.mean(axis=0), x.std(axis=0)
    a = np.column_stack([(x - mean) / np.where(std > 0, std, np.inf), np.ones(len(x))])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, penalty = np.zeros(a.shape[1]), np.append(np.ones(x.shape[1]), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ beta))
        beta = beta - np.linalg.solve(a.T @ (a * (s * p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (s * (p - y)) + penalty * beta)
    return 1 / (1 + np.exp(-a @ beta))


def test_the_probe_is_the_newton_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 3, 0.1, 1, 0] + [0, 5, 0, 0, 2]
    y = (x[:, 0] + x[:, 1] - 5 + rng.normal(size=400) > 2.5).astype(float)
    rows = [(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))]
    broken = [(900, None, 1.0), (901, [1.0], 1.0), (902, [float("nan")] * 5, 0.0), (903, [1.0, None, 1.0, 1.0, 1.0], 0.0), (904, [float("inf")] * 5, 1.0), (905, [0.0] * 5, None), (906, [0.0] * 5, 7.0)]
    df = spark.createDataFrame(rows + broken, "k int, e array<double>, y double").repartition(7)
    probe = L.fit_probe(df, "e", "y")
    got = {r.k: r.prob for r in L.probe_scores(df, probe, "e").collect()}
    assert max(abs(got[k] - p) for k, p in enumerate(plain_newton(x, y))) < 1e-6
    assert got[900] is None and got[901] is None and got[903] is None and probe.weights[4] == 0
    assert 0.02 <= L.probe_cutoff(df.where("k < 400"), probe, "e", "y") <= 0.98
    with pytest.raises(ValueError):
        L.fit_probe(df.where("y = 1"), "e", "y")
    with pytest.raises(ValueError):
        L.fit_probe(df.where("k > 10000"), "e", "y")


def test_separable_classes_end_by_the_penalty(spark):
    df = spark.createDataFrame([([float(k)], int(k >= 50)) for k in range(100)], "e array<double>, y int")
    probe = L.fit_probe(df, "e", "y")
    assert probe.gradient < 1e-8 and probe.rounds < 30 and -probe.intercept / probe.weights[0] == pytest.approx(49.5, abs=0.5)


@pytest.mark.parametrize("rate,to", [(500, 100), (100, 73), (100, 250), (100, 100), (400, 1)])
def test_resampling_on_the_time_grid(spark, rate, to):
    values = [float((k * 37) % 11) for k in range(101)]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "s int, i long, mv double")
    m = int(len(values) / rate * to)
    want = np.interp(np.linspace(0, len(values) / rate, m, endpoint=False), np.arange(len(values)) / rate, values) if m else []
    assert [r.mv for r in G.resample_rate(df, ["s"], rate, to).orderBy("i").collect()] == pytest.approx(list(want))


def test_weights_of_a_subgroup_and_masked_labels(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("b", 1, None), ("c", None, 1)], "class string, y int, m int")
    assert sorted(r.w for r in df.select(C.subgroup_weight(F.col("y"), F.col("m"), 3).alias("w")).collect()) == [1, 1, 1, 1, 3]
    weights = spark.createDataFrame([("a", 2.0), ("b", None)], "class string, weight double")
    assert sorted((r["class"], r.y) for r in C.masked_labels(df.where("y is not null"), weights).collect() if r.y is not None) == [("a", 0), ("a", 1), ("a", 1)]
