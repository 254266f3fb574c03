import itertools
import random

import pytest
from pyspark.sql import functions as F

from wavecohort.operators import distributions as D

#: Two-sided tail probabilities of Student's t: degrees of freedom, t, p. One and two degrees in closed form, others tabulated.
TABLE = [(1, 1.0, 0.5), (1, 12.706204736432095, 0.05), (2, 4.302652729911275, 0.05), (5, 2.570581835636305, 0.05), (10, 2.228138851964939, 0.05), (30, 2.750, 0.010000), (10, 0.0, 1.0)]


def test_student_t(spark):
    df = spark.createDataFrame(TABLE, "df int, t double, p double")
    for r in df.withColumn("got", D.t_two_sided(F.col("t"), F.col("df"))).collect():
        assert r.got == pytest.approx(r.p, abs=1e-9 if len(str(r.t)) > 8 or r.t in (0.0, 1.0) else 1e-5)
    one = spark.range(1)
    closed = lambda t: 1 - t / (2 + t * t) ** 0.5  # two degrees of freedom
    for t in (0.01, 0.5, 3.0, 40.0):
        assert one.select(D.t_two_sided(F.lit(t), F.lit(2)).alias("p")).first().p == pytest.approx(closed(t), rel=1e-9)
    for x, a in ((0.3, 2.0), (0.9, 7.0)):  # I_x(a, 1) = x ** a
        assert one.select(D.incomplete_beta(F.lit(a), F.lit(1.0), F.lit(x)).alias("p")).first().p == pytest.approx(x**a, rel=1e-12)
    large = one.select(D.t_two_sided(F.lit(1.959963985), F.lit(100_000)).alias("p"), D.t_two_sided(F.lit(None).cast("double"), F.lit(3)).alias("n"), D.t_two_sided(F.lit(1.0), F.lit(0)).alias("z")).first()
    assert large.p == pytest.approx(0.05, abs=3e-6) and large.n is None and large.z is None


def test_correlation_p(spark):
    row = spark.range(1).select(D.correlation_p(F.lit(0.5), F.lit(12)).alias("a"), D.correlation_p(F.lit(1.0), F.lit(5)).alias("b"), D.correlation_p(F.lit(0.3), F.lit(2)).alias("c"), D.correlation_p(F.lit(0.0), F.lit(9)).alias("d")).first()
    assert row.a == pytest.approx(0.0978, abs=1e-4) and row.b == 0 and row.c is None and row.d == pytest.approx(1)


def test_signed_ranks_equal_all_signs(spark):
    rng = random.Random(3)
    rows = []
    for n in (1, 2, 5, 6, 9):
        ranks = [float(k) for k in range(1, n + 1)] if n != 6 else [1.5, 1.5, 3.0, 5.0, 5.0, 5.0]
        signs = [rng.random() < 0.7 for _ in range(n)]
        w = min(sum(r for r, s in zip(ranks, signs) if s), sum(r for r, s in zip(ranks, signs) if not s))
        low = sum(sum(r for r, s in zip(ranks, some) if s) <= w for some in itertools.product((0, 1), repeat=n)) / 2**n
        rows.append(([int(2 * r) for r in ranks], float(w), min(1.0, 2 * low)))
    df = spark.createDataFrame(rows, "r array<int>, w double, p double")
    for r in df.withColumn("got", D.signed_rank_p(F.col("r"), F.col("w"))).collect():
        assert r.got == pytest.approx(r.p, abs=1e-12)
