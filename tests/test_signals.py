import math

import random

import pytest
from pyspark.sql import functions as F

from wavecohort.operators import arrays as A
from wavecohort.operators import beats as B
from wavecohort.operators import models as L
from wavecohort.operators import qrs as Q
from wavecohort.operators import signal as G


def series(spark, values, lead=0, record=1):
    return spark.createDataFrame([(record, lead, i, None if v is None else float(v)) for i, v in enumerate(values)], "record_id int, lead_idx int, i long, mv double")


BY = ["record_id", "lead_idx"]


def values(df):
    return [r.mv for r in df.orderBy("i").collect()]


def test_gaps_and_filling(spark):
    s = series(spark, [None, 1, None, 3, None, None, None, 7, None])
    assert sorted((r.start, r.end) for r in G.gaps(s, BY).collect()) == [(0, 1), (2, 3), (4, 7), (8, 9)]
    assert values(G.fill_gaps(s, BY, 1)) == [1, 1, 2, 3, 3, 3, 3, 7, 7]
    assert values(G.fill_gaps(s, BY, 9)) == [1, 1, 2, 3, 4, 5, 6, 7, 7]
    assert values(G.fill_gaps(series(spark, [None, None]), BY, 1)) == [0, 0]


def test_roll_is_found(spark):
    x = [math.sin(i / 7) + 0.3 * math.sin(i / 3) for i in range(200)]
    r = G.shifted_correlation(series(spark, x), series(spark, [0] * 12 + x[:188]), BY, 15).first()
    assert r["shift"] == 12 and r["corr"] == pytest.approx(1) and r["nrmse"] == pytest.approx(0, abs=1e-4)
    flat = G.shifted_correlation(series(spark, x), series(spark, [1] * 200), BY, 2).first()
    assert (flat["corr"], flat["nrmse"]) == (0, 1)


def test_consistent_limb_leads(spark):
    i, ii = [math.sin(k / 5) for k in range(120)], [math.cos(k / 9) for k in range(120)]
    leads = [i, ii, [b - a for a, b in zip(i, ii)], [-(a + b) / 2 for a, b in zip(i, ii)], [(2 * a - b) / 2 for a, b in zip(i, ii)], [(2 * b - a) / 2 for a, b in zip(i, ii)]]
    df = None
    for k, v in enumerate(leads):
        part = series(spark, v, k)
        df = part if df is None else df.union(part)
    assert G.limb_consistency(df).first().consistency == pytest.approx(1)
    assert G.derivation_residuals(df, 2).first().worst_residual == pytest.approx(0, abs=1e-6)


def test_neighbour_repairs_a_long_gap(spark):
    x = [math.sin(i / 6) for i in range(120)]
    y = [None if 40 <= i < 70 else 2 * v + 1 for i, v in enumerate(x)]
    df = series(spark, x, 0).union(series(spark, y, 1)).withColumnRenamed("lead_idx", "lead")
    n = spark.createDataFrame([(1, 0, 0)], "lead int, other int, rank int")
    out = {r.i: r.mv for r in G.repair_from_neighbours(df, n, 5).where("lead = 1").collect()}
    assert all(out[i] == pytest.approx(2 * x[i] + 1) for i in range(120))


def test_arrays(spark):
    one = spark.range(1)
    a = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = one.select(G.fitted(a, 2).alias("c"), G.fitted(a, 4).alias("p"), G.tiled(a, 5).alias("t"), G.tiled(F.array().cast("array<double>"), 2).alias("e")).first()
    assert (r.c, r.p, r.t, r.e) == ([1, 2], [1, 2, 3, 0], [1, 2, 3, 1, 2], [0, 0])


def test_resample_keeps_both_ends(spark):
    assert values(G.resample(series(spark, [0, 2, 4]), BY, 5)) == [0, 1, 2, 3, 4]


def test_overlay(spark):
    ink = spark.createDataFrame([(1, x, 10) for x in range(10)], "image_id int, x int, y int")
    near = spark.createDataFrame([(1, x, 13 if x < 5 else 14) for x in range(10)], "image_id int, x int, y int")
    r = G.ink_overlay(ink, near).first()
    assert r.precision == 0.5 and r.recall == 1
    gone = G.ink_overlay(ink, near.withColumn("image_id", F.lit(2))).collect()
    assert {(r.image_id, r.f1, r.residual) for r in gone} == {(1, 0.0, 1.0), (2, 0.0, 1.0)}


def pulses(spark, at, n, width=5):
    shape = [0.4, 1.2, 2.2, 1.2, 0.4]
    v = [0.0] * n
    for a in at:
        for k, x in enumerate(shape):
            v[a + k] += x
    return series(spark, v)


def test_pulse_train_rate(spark):
    at = list(range(100, 4900, 400))  # 75 a minute at 500 Hz
    beats = B.detect(pulses(spark, at, 5000), BY, 60, 125, 25)
    assert [r.r_i for r in beats.orderBy("r_i").collect()] == [a + 2 for a in at]
    assert B.rate(beats, BY, 500.0).first().bpm == pytest.approx(75)
    r = B.rr_statistics(beats, BY, 500.0).first()
    assert r.rr_mean_ms == pytest.approx(800) and r.rr_cv == pytest.approx(0) and r.regular
    assert B.autocorrelation_rate(pulses(spark, at, 5000), BY, 500.0, 150, 600).first().bpm == pytest.approx(75)


def test_irregular_train(spark):
    gaps = [400, 300, 520, 360, 480, 290, 450, 380]
    at = [50 + sum(gaps[:k]) for k in range(len(gaps) + 1)]
    r = B.rr_statistics(B.detect(pulses(spark, at, 4000), BY, 60, 125, 25), BY, 500.0).first()
    assert not r.regular and r.rr_cv > 0.16


def test_corrected_qt(spark):
    df = spark.createDataFrame([(400.0, 1.0, 0.0), (400.0, 0.5, 0.0), (400.0, 0.8, 0.2), (None, 1.0, 0.0)], "qt_ms double, rr_sec double, rr_cv double")
    rows = B.corrected_qt(df).collect()
    assert [r.formula for r in rows] == ["bazett", "fridericia", "fridericia", "n/a"]
    assert rows[0].preferred == pytest.approx(400) and rows[1].preferred == pytest.approx(400 / 0.5 ** (1 / 3))


def test_probe_and_batch_scores(spark):
    rows = [(i, [float((i * 7919 + k * 31) % 11) / 10 + (1.0 if k == 0 and i % 2 else 0.0) for k in range(8)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, e array<double>, y int")
    out = L.probe_scores(df, L.fit_probe(df, "e", "y"), "e").collect()
    assert sum((r.prob >= 0.5) == (r.y == 1) for r in out) > 190
    broken = df.withColumn("e", F.when(F.col("id") == 3, None).when(F.col("id") == 4, F.slice("e", 1, 2)).otherwise(F.col("e")))
    scored = {r.id: (r.valid, r.prob) for r in L.batch_scores(broken, "e", 8, L.mean_predictor).collect()}
    assert scored[3] == (False, None) and scored[4] == (False, None) and 0 < scored[5][1] < 1


def test_refractory_peaks_equal_a_plain_loop(spark):
    """Dense chains of peaks: the highest stays, all nearer than the distance go."""
    rng = random.Random(4)
    for trial in range(12):
        at, tops = 0, []
        for _ in range(60):
            at += rng.randrange(1, 9)
            tops.append((float(rng.randrange(5 if trial % 2 else 1000)), at))
        left, want = sorted(tops, reverse=True), []
        while left:
            want.append(left[0])
            left = [t for t in left[1:] if abs(t[1] - want[-1][1]) >= 10]
        df = spark.createDataFrame([(tops,)], "t array<struct<value:double,at:int>>")
        got = df.select(A.apart(F.col("t"), 10).alias("t")).first().t
        assert [(x.value, x.at) for x in got] == sorted(want, key=lambda t: t[1])


def test_peaks_runs_and_prominence(spark):
    of = lambda values, column: spark.createDataFrame([(values,)], "a array<double>").select(column(F.col("a")).alias("x")).first().x
    assert [(r.value, r["from"], r.to) for r in of([1.0, 1.0, 2.0, 1.0], A.runs)] == [(1, 0, 1), (2, 2, 2), (1, 3, 3)] and of([], A.runs) == []
    wave = [0.0, 3.0, 1.0, 2.0, 2.0, 2.0, 0.5, 5.0, 4.5, 4.8, 0.0, 9.0]
    assert [(p.value, p.at) for p in of(wave, A.peaks)] == [(3, 1), (2, 4), (5, 7), (4.8, 9)]
    plain = {}
    for v, at in ((3, 1), (2, 4), (5, 7), (4.8, 9)):
        left = next((k for k in range(at, -1, -1) if wave[k] > v), -1)
        right = next((k for k in range(at, len(wave)) if wave[k] > v), len(wave))
        plain[at] = v - max(min(wave[left + 1 : at + 1]), min(wave[at:right]))
    for least in (0.2, 0.3, 1.0, 1.01, 2.9, 4.6):
        assert [p.at for p in of(wave, lambda a: A.prominent(a, least))] == [at for at, p in plain.items() if p >= least]
    assert of([1.0, 2.0, 4.0, 8.0], A.gradient) == [1, 1.5, 3, 4] and of([3.0, 1.0], A.median) == 2 and of([], A.median) is None
    assert of([3.0, 3.0, 3.0], lambda a: A.smoothed(a, 3)) == [2, 3, 2]


def polyline(points, n, at=0):
    v = [0.0] * n
    for (a, x), (b, y) in zip(points, points[1:]):
        for k in range(a, b):
            v[at + k] = x + (y - x) * (k - a) / (b - a)
    return v


#: Corners of complexes at 500 Hz, in samples and mV, and what they are called.
COMPLEXES = {
    "r": [(0, 0), (25, 1.5), (50, 0)],
    "qs": [(0, 0), (25, -1.5), (50, 0)],
    "qr": [(0, 0), (12, -0.8), (30, 1.2), (50, 0)],
    "qrs": [(0, 0), (10, -0.6), (26, 1.4), (42, -0.7), (55, 0)],
    "rs": [(0, 0), (15, 0.9), (40, -1.2), (60, 0)],
    "rsr": [(0, 0), (12, 0.7), (28, -1.0), (46, 1.1), (60, 0)],
}


def test_six_patterns_from_lines(spark):
    beats, rows = [], []
    for name, points in COMPLEXES.items():
        v = polyline(points, 1500, 400)
        rows += [(name, 1, i, x) for i, x in enumerate(v)]
        beats.append((name, 1, 400 + 15, 0))
    df = spark.createDataFrame(rows, "record string, lead int, i long, mv double")
    b = spark.createDataFrame(beats, "record string, lead int, r_i long, beat_no int")
    by = ["record", "lead"]
    found = {r.record: r for r in Q.morphology(b, df, by, 500.0).collect()}
    assert {name: r.pattern for name, r in found.items()} == {name: name for name in COMPLEXES}
    assert {name: r.initial for name, r in found.items()} == {"r": "r", "rs": "r", "rsr": "r", "qs": "q", "qr": "q", "qrs": "q"}
    assert {name for name, r in found.items() if r.has_rs} == {"rs", "rsr", "qrs"} and found["r"].polarity == "positive" and found["qs"].polarity == "negative"
    assert found["rs"].rs_ms == pytest.approx((40 - 2) * 2, abs=6) and found["rs"].nadir_ms == pytest.approx(76, abs=6) and found["rs"].r_s == pytest.approx(0.75, abs=0.05)
    assert found["rsr"].taller is False and found["rs"].taller is None and found["r"].r_s is None and found["r"].nadir_ms is None
    assert not any(r.notched or r.s_notched for r in found.values())
    notched = polyline([(0, 0), (12, -0.9), (16, -0.4), (30, -1.5), (50, 0)], 1500, 400)
    one = spark.createDataFrame([("n", 1, i, x) for i, x in enumerate(notched)], df.schema)
    assert Q.morphology(spark.createDataFrame([("n", 1, 420, 0)], b.schema), one, by, 500.0).first().pattern == "qs"
    flat = spark.createDataFrame([("r", 1, i, 0.0) for i in range(1500)], df.schema)
    assert Q.morphology(b, flat, by, 500.0).count() == 0 and Q.morphology(b.limit(0), df, by, 500.0).count() == 0


def test_leads_and_features(spark):
    rows = []
    for record in (1, 2):
        for lead, name in (("II", "rs"), ("V1", "qr"), ("V6", "rs"), ("aVR", "qs")):
            v = [0.0] * 4000
            for at in range(300, 3600, 230):
                for k, x in enumerate(polyline(COMPLEXES[name], 60)):
                    v[at + k] = x if record == 1 or lead != "II" else 0.0
            rows += [(record, lead, i, x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "record int, lead string, i long, mv double")
    beats = B.detect(df, ["record", "lead"], 60, 125, 25)
    anchored = Q.anchor_beats(beats, df, "record", "lead", ["II", "V1"])
    found = {r.record: r for r in Q.record_features(anchored, df, "record", "lead", ["V1", "V6"], "V1", "V6", "aVR", 500.0).collect()}
    assert {k: r.anchor_lead for k, r in found.items()} == {1: "II", 2: "V1"}  # a flat lead is no anchor
    assert all(r.n_beats >= 14 and r.leads == 2 and r.v1.pattern == "qr" and r.v6.pattern == "rs" and r.avr.initial == "q" and r.rs_absent is False and r.max_rs_ms > 50 for r in found.values()), found


def test_p_wave_is_the_last_one_and_never_a_t_tail(spark):
    """A T wave's tail reaches the search window, higher than P: the later, smaller P counts; without P there is none."""
    fs, n = 500.0, 4000

    def lead(with_p):
        v = [0.0] * n
        for at in range(400, 3600, 300):
            for a, points in ((at, [(0, 0), (15, 2.0), (30, 0)]), (at + 60, [(0, 0), (70, 0.6), (135, 0)])) + (((at - 70, [(0, 0), (15, 0.3), (30, 0)]),) if with_p else ()):
                for k, x in enumerate(polyline(points, points[-1][0])):
                    v[a + k] += x
        return v

    rows = [(1, int(p), i, x) for p in (True, False) for i, x in enumerate(lead(p))]
    df = spark.createDataFrame(rows, "record int, lead int, i long, mv double")
    beats = spark.createDataFrame([(1, p, at + 15, k, at, at + 30) for p in (0, 1) for k, at in enumerate(range(400, 3600, 300))], "record int, lead int, r_i long, beat_no int, qrs_on long, qrs_off long")
    found = B.waves(beats, df, ["record", "lead"], fs).collect()
    with_p = [r for r in found if r.lead == 1]
    assert all(r.p_on is not None and abs(r.p_on - (r.qrs_on - 70)) <= 8 for r in with_p)
    assert all(abs(r.t_end - (r.qrs_on + 60 + 135)) <= 12 for r in with_p if r.t_end is not None) and sum(r.t_end is not None for r in with_p) >= 10
    assert all(r.p_on is None for r in found if r.lead == 0 and r.r_i > 500)


def test_rate_of_the_first_usable_lead(spark):
    rates = spark.createDataFrame([(1, "II", None, 90.0), (1, "V1", 80.0, 85.0), (1, "V2", 70.0, None), (2, "II", None, None), (2, "V2", None, 66.0), (2, "V1", None, 60.0), (3, "II", None, None)], "record int, lead string, bpm double, acf_bpm double")
    found = {r.record: (r.lead, r.bpm, r.basis) for r in B.lead_rate(rates, "record", "lead", ["II", "V1"]).collect()}
    assert found == {1: ("V1", 80.0, "beats"), 2: ("V1", 60.0, "autocorrelation")}


def joins(df):
    """How often a plan joins, and how often it broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Join "), plan.count("BroadcastExchange")


def test_resampling_needs_no_join_and_keeps_gaps_and_repeats(spark):
    df = spark.createDataFrame([("r", "a", i, float(v)) for i, v in [(0, 0), (1, 2), (3, 8), (3, 9), (4, 5)]] + [("r", "b", 3, 1.0), ("r", "b", 4, 2.0)], "record_id string, lead string, i long, mv double")
    got = G.resample(df, ["record_id", "lead"], 9)
    assert joins(got) == (0, 0)
    rows = sorted((r.lead, r.i, r.mv) for r in got.collect())
    # of a, what needs the sample 2 is left out, and 3 is there twice; b starts at 3
    assert rows == [("a", 0, 0.0), ("a", 1, 1.0), ("a", 6, 8.0), ("a", 6, 9.0), ("a", 7, 6.5), ("a", 7, 7.0), ("a", 8, 5.0), ("b", 6, 1.0), ("b", 7, 1.5), ("b", 8, 2.0)]


def test_shifts_meet_within_series_without_a_join(spark):
    by = ["record_id", "lead_idx"]
    x = [math.sin(k / 3) for k in range(40)]
    rows = lambda v, keep: spark.createDataFrame([("r", lead, i, y * (lead + 1)) for lead in (0, 1) for i, y in enumerate(v) if keep(i)], "record_id string, lead_idx int, i long, mv double")
    for keep in (lambda i: True, lambda i: i % 7 != 4):  # without and with gaps
        ref, pred = rows(x, lambda i: True), rows([0.0] * 2 + x[:38], keep)
        got = G.shifted_correlation(ref, pred, by, 3)
        assert joins(got) == (0, 0)
        assert sorted((r.lead_idx, r["shift"], round(r["corr"], 9)) for r in got.collect()) == [(0, 2, 1.0), (1, 2, 1.0)]
        cross = G.cross_correlations(ref, pred, 3)
        assert joins(cross) == (0, 0)
        assert sorted((r.a, r.b, r["shift"]) for r in cross.collect()) == [(a, b, 2) for a in (0, 1) for b in (0, 1)]
        assert {round(r.rmse, 9) for r in G.fidelity(ref, pred, by, got).collect()} == {0.0}


def test_ink_and_trace_meet_in_one_grouping(spark):
    px = lambda rows: spark.createDataFrame(rows, "image_id long, x long, y long")
    got = G.ink_overlay(px([(1, 0, 10), (1, 0, 10), (1, 0, 30), (2, 0, 5), (None, 0, 5)]), px([(1, 0, 13), (1, 0, 24), (1, 1, 10), (None, 0, 5)]))
    assert joins(got) == (0, 0) and got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    rows = sorted((r.image_id or 0, round(r.precision, 6), round(r.recall, 6), r.residual) for r in got.collect())
    assert rows == [(0, 0.0, 0.0, 1.0), (0, 0.0, 0.0, 1.0), (1, 0.333333, 1.0, 0.5), (2, 0.0, 0.0, 1.0)]
