import math
import random

import pytest
from pyspark.sql import functions as F

from wavecohort.operators import metrics as M
from wavecohort.operators import scoring as S
from wavecohort.operators import thresholds as H


def table(spark, y, s, c="a"):
    return spark.createDataFrame([(str(i), f"p{i // 2}", c, a, float(b)) for i, (a, b) in enumerate(zip(y, s))], "record_id string, patient_id string, class string, y int, prob double")


def plain_ranking(rows):
    """AUROC by counting pairs, and average precision by walking down the distinct scores."""
    ups, downs = [s for y, s in rows if y], [s for y, s in rows if not y]
    if not ups or not downs:
        return None, None
    won = sum((u > d) + (u == d) / 2 for u in ups for d in downs)
    precision = 0.0
    for cut in sorted({s for _, s in rows}, reverse=True):
        at = [y for y, s in rows if s >= cut]
        precision += sum(1 for y, s in rows if y and s == cut) / len(ups) * sum(at) / len(at)
    return won / len(ups) / len(downs), precision


def generated(seed, n, steps):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.3), rng.randrange(steps) / steps if steps else rng.random()) for _ in range(n)]


@pytest.mark.parametrize("steps", [7, 60, 0])
def test_rankings_equal_counted_pairs(spark, steps):
    """Few and many ties, and scores that are all distinct, so that ranges hold several of them."""
    groups = {g: generated(steps + k, n, steps) for k, (g, n) in enumerate((("big", 400), ("small", 9), (None, 150)))}
    df = spark.createDataFrame([(g, y, s) for g, rows in groups.items() for y, s in rows], "g string, y int, prob double")
    found = {r.g: r for r in M.operating_point(df.withColumn("class", F.lit("c")), ["g"], 0.4).collect()}
    report = {r.g: r for r in M.class_metrics(df, ["g"], 0.4).collect()}
    for g, rows in groups.items():
        auroc, ap = plain_ranking(rows)
        r, c = found[g], report[g]
        assert (r.tp, r.fp, r.tn, r.fn) == tuple(sum((s >= 0.4) == p and y == v for y, s in rows) for p, v in ((True, 1), (True, 0), (False, 0), (False, 1)))
        assert r.auroc == pytest.approx(auroc) and r.average_precision == pytest.approx(ap) and r.n == len(rows)
        assert (c.tp, c.fp, c.fn) == (r.tp, r.fp, r.fn) and c.brier == pytest.approx(sum((s - y) ** 2 for y, s in rows) / len(rows))
        bins = {}
        for y, s in rows:
            bins.setdefault(max(0, math.ceil(round(s * 10, 9)) - 1), []).append((y, s))
        assert c.ece == pytest.approx(sum(abs(sum(y - s for y, s in b)) for b in bins.values()) / len(rows))


def test_cutoff_rates_equal_counts(spark):
    rows = generated(11, 300, 0)
    df = spark.createDataFrame([("a", y, s) for y, s in rows], "class string, y int, prob double")
    at = H.rates_at(df, H.candidates(df, ["class"]), ["class"]).collect()
    values = sorted({s for _, s in rows})
    assert sorted(r.cutoff for r in at) == pytest.approx(sorted({min(max((a + b) / 2, 0.001), 0.999) for a, b in zip(values, values[1:])}))
    for r in at[::17]:
        assert (r.tp, r.fp) == (sum(y for y, s in rows if s >= r.cutoff), sum(1 - y for y, s in rows if s >= r.cutoff))


def test_nothing_predicted_is_zero(spark):
    r = M.operating_point(table(spark, [1, 0], [0.1, 0.1]), []).first()
    assert (r.f1, r.ppv, r.sensitivity, r.auroc) == (0, 0, 0, 0.5)


def test_threshold_is_inclusive(spark):
    assert M.operating_point(table(spark, [1, 0], [0.5, 0.4]), []).first().tp == 1


def test_one_class_has_no_ranking(spark):
    r = M.ranking(table(spark, [0, 0], [0.1, 0.9]), ["class"]).first()
    assert r.auroc is None and r.average_precision is None
    report = M.multilabel_report(table(spark, [0, 0], [0.1, 0.9])).first()
    assert report.n_eligible == 0 and report.macro_auroc == 0


def test_ties_count_half_and_precision_steps_over_them(spark):
    r = M.ranking(table(spark, [1, 0, 1, 0], [0.5, 0.5, 0.5, 0.2]), ["class"]).first()
    assert r.auroc == pytest.approx((2 + 2 * 0.5) / 4) and r.average_precision == pytest.approx(2 / 3)


def test_calibration_bins_close_on_the_right(spark):
    # 0 and 0.1 share the first bin
    assert M.calibration_error(table(spark, [0, 1], [0.0, 0.1]), ["class"]).first().ece == pytest.approx(0.45)
    assert M.calibration_error(table(spark, [0, 1], [0.1, 0.11]), ["class"]).first().ece == pytest.approx((0.1 + 0.89) / 2)


def test_vectors_against_plain_sums(spark):
    rng = random.Random(5)
    rows = [(r, rng.random(), rng.random()) for r in "uvw" for _ in range(40)]
    v = spark.createDataFrame(rows, "record_id string, a double, b double")
    for r in M.vector_comparison(v, ["record_id"]).collect():
        pairs = [(a, b) for k, a, b in rows if k == r.record_id]
        size = math.sqrt(sum(a * a for a, _ in pairs) * sum(b * b for _, b in pairs))
        assert r.cosine == pytest.approx(sum(a * b for a, b in pairs) / size)
        assert r.mean_abs_difference == pytest.approx(sum(abs(a - b) for a, b in pairs) / 40)
        assert r.agreement == pytest.approx(sum((a >= 0.5) == (b >= 0.5) for a, b in pairs) / 40)
    assert M.vector_comparison(v.withColumn("a", F.lit(0.0)), ["record_id"]).first().cosine == 0


def test_spearman(spark):
    d = spark.createDataFrame([("g", 1.0, 10.0), ("g", 2.0, 10.0), ("g", 3.0, 30.0), ("h", 1.0, 5.0), ("h", 1.0, 6.0)], "g string, x double, y double")
    r = {x.g: x.rho for x in M.spearman(d, ["g"], "x", "y").collect()}
    assert r["g"] == pytest.approx(math.sqrt(3) / 2) and r["h"] is None


def test_midranks_of_many_values(spark):
    values = [random.Random(8).randrange(90) for _ in range(300)]
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, x double")
    want = {v: sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values}
    assert all(r.rank == want[int(r.x)] for r in M.midranks(df, ["g"], "x", "rank").collect())


def test_rows_in_any_order_give_the_same(spark):
    t = table(spark, [1, 0, 1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.6, 0.2, 0.1])
    before = M.operating_point(t, ["class"]).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert M.operating_point(t.repartition(5).orderBy("prob"), ["class"]).collect() == before
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_cutoffs(spark):
    t = table(spark, [1, 1, 0, 0], [0.9, 0.7, 0.6, 0.1])
    assert sorted(r.cutoff for r in H.candidates(t, ["class"]).collect()) == pytest.approx([0.35, 0.65, 0.8])
    assert H.candidates(t.limit(1), ["class"]).first().cutoff == 0.5
    assert H.best_fbeta(t, ["class"]).first().cutoff == pytest.approx(0.65)
    assert H.at_sensitivity(t, ["class"], 0.9).first().specificity == 1.0
    never = table(spark, [0, 1], [0.9, 0.1])
    assert H.at_specificity(never, ["class"], 1.0).first().cutoff == pytest.approx(0.5)


def test_observed_cutoff_is_clipped_and_scored_again(spark):
    r = H.best_f1_observed(table(spark, [1, 0], [0.999, 0.99]), ["class"]).first()
    assert r.cutoff == 0.98 and r.f1 == pytest.approx(2 / 3)
    assert H.best_f1_observed(table(spark, [0, 0], [0.2, 0.3]), ["class"]).first().cutoff == 0.5


def test_crossfit_keeps_groups_together_and_differs_from_in_sample(spark):
    rows = [(1, 0.4 + 0.01 * (i % 50)) if i % 3 == 0 else (0, 0.2 + 0.01 * (i % 60)) for i in range(300)]
    t = table(spark, [y for y, _ in rows], [s for _, s in rows])
    r = H.crossfit(t, "patient_id", ["class"]).first()
    assert 0 < r.sensitivity <= 1 and 0 < r.specificity <= 1 and 0.2 < r.median_cutoff < 0.9
    assert H.crossfit(t.repartition(7), "patient_id", ["class"]).first() == r


def test_bootstrap_interval_holds_the_estimate_and_narrows(spark):
    def width(n):
        t = spark.range(n).select(F.col("id").alias("u"), (F.col("id") % 4 == 0).cast("int").alias("a"), F.lit(1).alias("b"))
        r = H.bootstrap_interval(t, "u", [], "a", "b", 300).first()
        assert r.low <= r.estimate <= r.high and r.n_units == n
        return r.high - r.low

    assert width(1600) < 0.7 * width(200)
    counts = spark.range(20000).select(H.poisson_one(H.draw(1, F.col("id"))).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
    assert counts[0] == pytest.approx(1, abs=0.03) and counts[1] == pytest.approx(1, abs=0.06)


def test_platt_fit(spark):
    t = spark.range(4000).select(F.lit("a").alias("class"), (H.draw(3, F.col("id")) * 0.98 + 0.01).alias("prob"), "id")
    p = 1 / (1 + F.exp(-(1.5 * S.logit(F.col("prob")) - 0.5)))
    r = H.platt_fit(t.withColumn("y", (H.draw(4, F.col("id")) < p).cast("int")), ["class"]).first()
    assert r.slope == pytest.approx(1.5, abs=0.15) and r.intercept == pytest.approx(-0.5, abs=0.15)
    inverted = H.platt_fit(t.withColumn("y", (H.draw(4, F.col("id")) >= p).cast("int")), ["class"]).first()
    assert inverted.slope is None
    assert H.platt_fit(t.withColumn("y", F.lit(0)), ["class"]).first().slope is None


def test_tiers(spark):
    rows = spark.createDataFrame([(9, 0.99, 0.9), (10, 0.8, 0.3), (10, 0.79, 0.9), (50, None, 0.5)], "positives int, auroc double, f1 double")
    assert [r.t for r in rows.select(H.assign_tier().alias("t")).collect()] == ["research_only", "validated", "provisional", "research_only"]


def test_one_pass_gives_the_rates_of_all_candidates(spark):
    """Rates at every candidate as counted anew: clipped midpoints, single and null scores, neighbouring doubles."""
    rng = random.Random(7)
    up = math.nextafter(0.4, 1)
    cases = {
        "mixed": [rng.choice([0.0, 1.0, 0.0002, 0.0005, 0.9993, 0.9999, rng.random()]) for _ in range(60)], "low": [0.0, 0.0001, 0.0004], "high": [0.9995, 0.9999, 1.0], "ends": [0.0, 1.0], "one": [0.7, 0.7], "small": [0.2],
        "null": [None, 0.3, 0.6, None], "nulls": [None, None], "near": [0.4, up, math.nextafter(up, 1), 0.9], "edge": [0.0005, 0.0015, 0.9985, 0.9995], "bounds": [0.001, 0.999],
    }
    rows = [(g, p, rng.randrange(2)) for g, ps in cases.items() for p in ps]
    df = spark.createDataFrame(rows, "g string, prob double, y int")
    found = {(r.g, r.cutoff): (r.tp, r.fp, r.p, r.q) for r in H.scanned(M.tie_table(df, ["g"]), ["g"]).collect()}
    want = {}
    for g, ps in cases.items():
        s = sorted({p for p in ps if p is not None})
        for c in {min(max((a + b) / 2, 0.001), 0.999) for a, b in zip(s, s[1:])} or {0.5}:
            hit = [y for k, p, y in rows if k == g and p is not None and p >= c]
            all_ = [y for k, _, y in rows if k == g]
            want[g, c] = (sum(hit), len(hit) - sum(hit), sum(all_), len(all_) - sum(all_))
    assert found == want
    again = {(r.g, r.cutoff): (r.tp, r.fp, r.p, r.q) for r in H.rates_at(df, H.candidates(df, ["g"]), ["g"]).collect()}
    assert again == want


def test_paired_differences(spark):
    """Groups of a few pairs, of ties and zeros, of equal differences, and of many pairs."""
    rng = random.Random(2)
    cases = {"few": [0.1, 0.2, -0.1], "six": [0.5, 0.2, -0.1, 0.4, 0.3, 0.6], "ties": [1.0, 1.0, -1.0, 2.0, 0.0, 3.0, None], "same": [0.25] * 6, "zero": [0.0] * 5, "many": [rng.gauss(0.15, 1) for _ in range(200)]}
    df = spark.createDataFrame([(g, d) for g, ds in cases.items() for d in ds], "g string, d double")
    found = {r.g: r for r in M.paired_test(df, ["g"], "d").collect()}
    assert found["few"].w_p is None and found["few"].n == 3 and found["few"].wins == 2
    assert found["six"].w == 1 and found["six"].w_p == pytest.approx(2 * 2 / 64)  # sums of at most 1: none, and the least rank
    assert found["ties"].n == 6 and found["ties"].w == 2 and found["ties"].w_p == pytest.approx(2 * 4 / 32)  # ranks 2, 2, 2, 4, 5: none, or one of the three
    assert found["same"].t is None and found["same"].t_p is None and found["same"].w_p == pytest.approx(2 / 64)
    assert found["zero"].w_p is None and found["zero"].w is None
    d = cases["many"]
    mean, sd = sum(d) / 200, (sum((x - sum(d) / 200) ** 2 for x in d) / 199) ** 0.5
    assert found["many"].t == pytest.approx(mean / (sd / 200**0.5)) and 0 < found["many"].t_p < 1
    z = (found["many"].w - 200 * 201 / 4) / (200 * 201 * 401 / 24) ** 0.5
    assert found["many"].w_p == pytest.approx(math.erfc(abs(z) / 2**0.5), abs=1e-9)
    one = M.paired_test(df.where("g = 'six'"), [], "d").first()
    assert one.w == 1 and one.t == pytest.approx(found["six"].t) and set(M.paired_test(df, [], "d").columns) == {"n", "wins", "mean", "sd", "t", "t_p", "w", "w_p"}


def test_replicate_vectors_equal_repeated_rows(spark):
    """Sums by replicate as from a row for each unit and replicate; null units, and more groups than a task holds."""
    rows = [(g, None if u == 3 else f"u{u}", float(u + g), 1.0) for g in range(7) for u in range(9)]
    df = spark.createDataFrame(rows, "g int, u string, a double, b double")
    each = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("w", H.poisson_one(H.draw(7, F.col("replicate"), F.col("u"))))
    want = {(r.g, r.replicate): (r.a, r.b) for r in each.groupBy("g", "replicate").agg(F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("b")).alias("b")).collect()}
    found = {(r.g, r.replicate): (r.a, r.b) for r in H.replicate_sums(df.coalesce(2), "u", ["g"], 20, 7, groups=2).collect()}
    assert found == want
    plan = H.replicate_sums(df, "u", ["g"], 20, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row is repeated for the replicates
    assert H.bootstrap_interval(df.limit(0), "u", ["g"], "a", "b").count() == 0 and H.bootstrap_interval(df.limit(0), "u", [], "a", "b").first().n_units == 0


def test_medians_without_buffers(spark):
    """Medians of several columns by group, as by sorting: nulls, ties, one value, none, and a null group."""
    rng = random.Random(5)
    rows = [(g, rng.choice([None, 1.0, 2.0, rng.random()]), rng.choice([3, None, rng.randrange(100)])) for g in ("a", "b", None) for _ in range(rng.randrange(30, 60))] + [("one", 4.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    found = {r.g: (r.mx, r.my) for r in M.medians(df, ["g"], {"mx": F.col("x"), "my": F.col("y")}).collect()}

    def plain(values):
        s = sorted(v for v in values if v is not None)
        return (s[(len(s) - 1) // 2] + (s[len(s) // 2] - s[(len(s) - 1) // 2]) / 2) if s else None

    assert found == {g: (plain([x for k, x, _ in rows if k == g]), plain([y for k, _, y in rows if k == g])) for g in ("a", "b", None, "one")}
    assert M.medians(df, [], {"m": F.col("x")}).first().m == plain([x for _, x, _ in rows])
