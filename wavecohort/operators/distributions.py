"""p-values as columns: Student's t by the incomplete beta function, signed ranks by counting subsets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, some

#: Lanczos coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
ROUNDS = 400
#: Up to so many pairs the signed-rank distribution is counted out; beyond, it is normal.
EXACT_PAIRS = 50


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 0.5."""
    series = sum((F.lit(c) / (x + (k - 1)) for k, c in enumerate(LANCZOS) if k), F.lit(LANCZOS[0]))
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(x + 6.5) - (x + 6.5) + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function: ROUNDS pairs of terms, folded over the rounds' numbers."""
    sound = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(s: Column, term: Column) -> Column:
        d, c = 1 / sound(1 + term * s["d"]), sound(1 + term / s["c"])
        return let(F.struct(d.alias("d"), c.alias("c")), lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"), (s["h"] * t["d"] * t["c"]).alias("h")))

    def both(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(step(s, even), lambda t: step(t, odd))

    first = 1 / sound(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    rounds = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda m: m.cast("double"))
    return F.aggregate(rounds, start, both, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a and b from 0.5 on and x in [0, 1]: 10 digits for a and b up to about 10**5."""
    def of(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
        lower = front * _fraction(a, b, x) / a
        upper = 1 - front * _fraction(b, a, 1 - x) / b
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), lower).otherwise(upper)

    return let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x")), of)


def t_two_sided(t: Column, df: Column) -> Column:
    """The probability of a Student t at least as far from 0; null without degrees of freedom."""
    return F.when(t.isNotNull() & (df > 0), incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation of n pairs, by t with n - 2 degrees of freedom; null below three pairs."""
    sure = F.abs(rho) >= 1 - 1e-15
    return F.when(rho.isNotNull() & (n > 2), F.when(sure, 0.0).otherwise(t_two_sided(rho * F.sqrt((n - 2) / F.greatest(1 - rho * rho, F.lit(1e-300))), n - 2)))


def signed_rank_p(doubled: Column, w: Column) -> Column:
    """Two-sided p of the smaller rank sum ``w`` of pairs whose ranks, times two, are the integers of an array.

    Each sign is as likely as the other: the share of all subsets whose sum is at most w, twice, and at most 1. Subsets are
    counted by an array with a place for each sum, one rank after the other, so that midranks of ties are exact as well.
    """
    total = F.aggregate(doubled, F.lit(0), lambda s, r: s + r.cast("int"))

    def counted(size: Column) -> Column:
        none = F.transform(F.sequence(F.lit(0), size), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
        zeros = lambda n: F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k > 0), lambda k: F.lit(0.0))
        # half of the subsets hold the next rank: halves keep all numbers below 1
        return F.aggregate(doubled, none, lambda acc, r: F.zip_with(acc, F.concat(zeros(r.cast("int")), some(acc, 0, F.size(acc) - r.cast("int"))), lambda x, y: (x + y) / 2))

    tail = let(total, lambda size: F.aggregate(some(counted(size), 0, F.floor(2 * w + 1e-9).cast("int") + 1), F.lit(0.0), lambda s, x: s + x))
    return F.least(F.lit(1.0), 2 * tail)


def normal_two_sided(z: Column) -> Column:
    """The probability of a standard normal number at least as far from 0, by a series of positive terms."""
    def of(x: Column) -> Column:
        terms = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda k: k.cast("double")), F.struct(x.alias("term"), x.alias("sum")), lambda s, k: let(s["term"] * 2 * x * x / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))), lambda s: s["sum"])
        return F.when(x > 8, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * terms))

    return let(F.abs(z.cast("double")) / math.sqrt(2), of)
