"""Threshold selection and resampling over score tables.

Cutoffs of all groups are scanned in one cumulative pass over distinct scores, not once per cutoff.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import met, ratio, running, tie_table

LOWEST, HIGHEST, DEFAULT = 0.001, 0.999, 0.5


def candidates_of(ties: DataFrame, by: list[str]) -> DataFrame:
    """As ``candidates``, of a table with a row for each distinct score."""
    mid = running(ties.select(*by, "prob"), by, "prob", []).select(*by, ((F.col("prob") + F.col("prob_next")) / 2).alias("mid"))
    cut = F.least(F.greatest("mid", F.lit(LOWEST)), F.lit(HIGHEST))
    some = mid.where("mid is not null").select(*by, cut.alias("cutoff")).distinct()
    none = mid.groupBy(*by).agg(F.count("mid").alias("k")).where("k = 0").select(*by, F.lit(DEFAULT).alias("cutoff"))
    return some.unionByName(none)


def candidates(scores: DataFrame, by: list[str]) -> DataFrame:
    """Midpoints of neighbouring distinct scores, clipped; a group of fewer than two gets the default."""
    return candidates_of(scores.select(*by, "prob").distinct(), by)


def rates_of(ties: DataFrame, cutoffs: DataFrame, by: list[str]) -> DataFrame:
    """As ``rates_at``, of a tie table."""
    rows = ties.select(*by, F.col("prob").alias("cutoff"), "pos", "neg", F.lit(0).alias("is_cut")).unionByName(cutoffs.select(*by, "cutoff", F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(1).alias("is_cut")))
    rows = rows.groupBy(*by, "cutoff").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("is_cut").alias("is_cut"))
    run = running(rows, by, "cutoff", ["pos", "neg"]).where("is_cut = 1")
    run = run.select(*by, "cutoff", (F.col("pos_all") - F.col("pos_before")).alias("tp"), (F.col("neg_all") - F.col("neg_before")).alias("fp"), F.col("pos_all").alias("p"), F.col("neg_all").alias("q"))
    tp, fp, p, q = (F.col(c) for c in ("tp", "fp", "p", "q"))
    return run.withColumns({"sensitivity": ratio(tp, p), "specificity": ratio(q - fp, q), "precision": ratio(tp, tp + fp)})


def rates_at(scores: DataFrame, cutoffs: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """tp, fp, p, q (weighted negatives) and rates of ``prob >= cutoff`` for all cutoffs of each group."""
    return rates_of(tie_table(scores, by, weight), cutoffs, by)


def fbeta(beta: float = 1.0) -> Column:
    """F-beta of tp, fp and p; 0 where its denominator is."""
    b = beta * beta
    return ratio((1 + b) * F.col("tp"), b * F.col("p") + F.col("tp") + F.col("fp"))


def first_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__place = 1").drop("__place")


def scanned(ties: DataFrame, by: list[str]) -> DataFrame:
    """As ``rates_of`` at all ``candidates_of`` a tie table, from one running pass over it.

    What is at or above the midpoint after a score is all that comes after that score. A bound that midpoints are clipped
    to has what comes after the last score below it. A cutoff may be told by several rows, which are equal.
    """
    counted = ties.select(*by, "prob", "pos", "neg", F.when(F.col("prob").isNotNull(), 1.0).otherwise(0.0).alias("one"))
    run = running(counted, by, "prob", ["pos", "neg", "one"])
    prob, then, place, scores_ = F.col("prob"), F.col("prob_next"), F.col("one_before"), F.col("one_all")
    mid = (prob + then) / 2
    all_ = [F.col("pos_all").alias("tp"), F.col("neg_all").alias("fp")]
    after = [(F.col("pos_all") - F.col("pos_before") - F.col("pos")).alias("tp"), (F.col("neg_all") - F.col("neg_before") - F.col("neg")).alias("fp")]
    # neighbouring doubles have no midpoint between them: it is one of the two
    at_mid = [F.when(mid > prob, a).otherwise(F.col(f"{c}_all") - F.col(f"{c}_before")).alias(n) for a, c, n in zip(after, ("pos", "neg"), ("tp", "fp"))]
    none = [F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp")]
    last_below = lambda bound: (prob < bound) & (then.isNull() | (then >= bound)) & (scores_ >= 2)
    cut = lambda c, rates: F.struct((c if isinstance(c, Column) else F.lit(c)).cast("double").alias("cutoff"), *rates)
    cases = [
        F.when(mid.between(LOWEST, HIGHEST), cut(mid, at_mid)),
        F.when(last_below(LOWEST) & ((place > 0) | (mid < LOWEST)), cut(LOWEST, after)),
        F.when(last_below(HIGHEST) & then.isNotNull() & ((mid > HIGHEST) | (place + 2 < scores_)), cut(HIGHEST, after)),
        F.when((place == 0) & (prob >= HIGHEST) & (scores_ >= 2), cut(HIGHEST, all_)),
        F.when((scores_ == 1) & (prob >= DEFAULT), cut(DEFAULT, all_)).when((scores_ == 1) & (prob < DEFAULT), cut(DEFAULT, none)).when((scores_ == 0) & prob.isNull(), cut(DEFAULT, none)),
    ]
    found = run.select(*by, F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull())).alias("c"), F.col("pos_all").alias("p"), F.col("neg_all").alias("q"))
    tp, fp, p, q = (F.col(c) for c in ("tp", "fp", "p", "q"))
    return found.select(*by, "c.cutoff", "c.tp", "c.fp", "p", "q").withColumns({"sensitivity": ratio(tp, p), "specificity": ratio(q - fp, q), "precision": ratio(tp, tp + fp)})


def greatest_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The row of each group with the greatest ``order``; partial maxima, no sort."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("best"))
    return best.select(*by, "best.*")


def best_fbeta_of(ties: DataFrame, by: list[str], beta: float = 1.0) -> DataFrame:
    """As ``best_fbeta``, of a tie table."""
    at = scanned(ties, by).withColumn("score", F.round(fbeta(beta), 12))
    return greatest_by(at, by, F.col("score"), -F.col("cutoff"))


def best_fbeta(scores: DataFrame, by: list[str], beta: float = 1.0, weight: Column | None = None) -> DataFrame:
    """The cutoff of the greatest F-beta, the smallest among equals."""
    return best_fbeta_of(tie_table(scores, by, weight), by, beta)


def at_sensitivity(scores: DataFrame, by: list[str], floor: float) -> DataFrame:
    """The greatest specificity with at least that sensitivity; if none reaches it, the smallest cutoff."""
    at = scanned(tie_table(scores, by), by).withColumn("reached", F.col("sensitivity") >= floor)
    return greatest_by(at, by, F.col("reached"), F.when(F.col("reached"), F.col("specificity")), -F.col("cutoff"))


def at_specificity(scores: DataFrame, by: list[str], floor: float) -> DataFrame:
    """The greatest sensitivity with at least that specificity; if none reaches it, the largest cutoff."""
    at = scanned(tie_table(scores, by), by).withColumn("reached", F.col("specificity") >= floor)
    return greatest_by(at, by, F.col("reached"), F.when(F.col("reached"), F.col("sensitivity")), F.when(F.col("reached"), -F.col("cutoff")).otherwise(F.col("cutoff")))


def best_f1_observed(scores: DataFrame, by: list[str], least_precision: float = 0.30, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The observed score of the greatest F1 with enough precision, clipped and scored again; else the default with its F1.

    One running pass: rates at an observed score are what is not before it, and those at the bounds and at the default are
    sums of the same rows.
    """
    run = running(tie_table(scores, by), by, "prob", ["pos", "neg"])
    rates = run.withColumns({"tp": F.col("pos_all") - F.col("pos_before"), "fp": F.col("neg_all") - F.col("neg_before"), "p": F.col("pos_all")})
    score = F.round(fbeta(), 12)
    sound = (ratio(F.col("tp"), F.col("tp") + F.col("fp")) >= least_precision) & (F.col("p") > 0) & F.col("prob").isNotNull()
    best = F.max(F.when(sound, F.struct(score.alias("score"), (-F.col("prob")).alias("o"), "tp", "fp", F.col("prob").alias("cutoff")))).alias("best")
    at = lambda c, name: F.struct(F.coalesce(F.sum(F.when(F.col("prob") >= c, F.col("pos"))), F.lit(0.0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("prob") >= c, F.col("neg"))), F.lit(0.0)).alias("fp"), F.lit(float(c)).alias("cutoff")).alias(name)
    told = rates.groupBy(*by).agg(best, F.max("p").alias("p"), at(low, "low"), at(high, "high"), at(DEFAULT, "default"))
    own = F.struct("best.tp", "best.fp", "best.cutoff")
    chosen = F.when(F.col("best").isNull(), F.col("default")).when(F.col("best.cutoff") < low, F.col("low")).when(F.col("best.cutoff") > high, F.col("high")).otherwise(own)
    out = told.select(*by, "p", chosen.alias("c")).select(*by, "p", "c.cutoff", "c.tp", "c.fp")
    return out.select(*by, "cutoff", fbeta().alias("f1"))


def crossfit(scores: DataFrame, group: str, by: list[str], blocks: int = 5, repeats: int = 2, beta: float = 1.0) -> DataFrame:
    """F-beta cutoffs fitted on the other blocks and applied to the held-out one, pooled over blocks.

    Blocks are a hash of (repeat, group), so that a group is never split. One row for each ``by``: the rates pooled over
    blocks and averaged over repeats, and the median cutoff. All comes from one tie table of blocks: what a block is
    fitted on is the table of all blocks less its own.
    """
    block = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("repeat").cast("string"), F.col(group).cast("string"))), 1, 7), 16, 10).cast("int"), F.lit(blocks))
    rows = scores.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("block", block)
    keys = [*by, "repeat"]
    own = tie_table(rows, [*keys, "block"])
    each = lambda c, k: F.sum(F.when(F.col("block") == k, F.col(c)).otherwise(0.0))
    spread = own.groupBy(*keys, "prob").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.array(*[F.struct(F.lit(k).alias("held"), each("pos", k).alias("pos"), each("neg", k).alias("neg")) for k in range(blocks)]).alias("parts"))
    fit = spread.select(*keys, "prob", F.explode("parts").alias("part"), "all_pos", "all_neg").select(*keys, "part.held", "prob", (F.col("all_pos") - F.col("part.pos")).alias("pos"), (F.col("all_neg") - F.col("part.neg")).alias("neg")).where("pos + neg > 0")
    there = own.select(*keys, F.col("block").alias("held")).distinct()
    cut = best_fbeta_of(fit.join(there, [*keys, "held"]), [*keys, "held"], beta).select(*keys, F.col("held").alias("block"), "cutoff")
    active = F.col("prob") >= F.col("cutoff")
    some = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0.0))
    rates = own.join(cut, [*keys, "block"]).groupBy(*keys).agg(some(active, "pos").alias("tp"), some(~active, "neg").alias("tn"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    out = rates.groupBy(*by).agg(F.avg(ratio(F.col("tp"), F.col("p"))).alias("sensitivity"), F.avg(ratio(F.col("tn"), F.col("q"))).alias("specificity"))
    return out.join(cut.groupBy(*by).agg(F.percentile("cutoff", 0.5).alias("median_cutoff")), by)


def prevalence_weight(by_rows: DataFrame, by: list[str], target: float) -> DataFrame:
    """The weight of negatives that makes positives a ``target`` share; null where a class is missing."""
    c = by_rows.groupBy(*by).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return c.withColumn("weight", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("pos") * ((1 - target) / target) / F.col("neg")))


def alert_burden(sensitivity: Column, specificity: Column, prevalence: float, n: int = 1000) -> list[Column]:
    """Expected true and false alerts among ``n`` and alerts for each true one (null without any)."""
    true, false = sensitivity * prevalence * n, (1 - specificity) * (1 - prevalence) * n
    return [true.alias("true_alerts"), false.alias("false_alerts"), F.try_divide(true + false, true).alias("alerts_per_true")]


def assign_tier() -> Column:
    """Evidence tier of positives, auroc and f1. 10 positives, AUROC 0.80, F1 0.30."""
    lacking = (F.col("positives") < 10) | F.col("auroc").isNull() | F.col("f1").isNull()
    return F.when(lacking, "research_only").when((F.col("auroc") >= 0.80) & (F.col("f1") >= 0.30), "validated").otherwise("provisional")


def draw(seed: int, *parts: Column) -> Column:
    """A hash in [0, 1) of the seed and the parts, the same in any engine with md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / 2.0**52


def poisson_one(u: Column, most: int = 6) -> Column:
    """A Poisson(1) count from a uniform number, by its distribution function."""
    at, total, steps = 0.36787944117144233, 0.0, []
    for k in range(most):
        total += at
        steps.append(F.when(u >= total, 1).otherwise(0))
        at /= k + 1
    return sum(steps[1:], steps[0])


#: Thresholds of ``poisson_one``: its distribution function at 0 to 5.
POISSON = tuple(sum(0.36787944117144233 / math.factorial(j) for j in range(k + 1)) for k in range(6))


def replicate_sums(units: DataFrame, unit: str, by: list[str], replicates: int, seed: int, groups: int = 256) -> DataFrame:
    """(…by, replicate, a, b): sums of a and b over units, each weighed with its Poisson(1) draw for the replicate.

    A unit is read once: a task keeps two vectors with an entry for each replicate for each group it has met, at most
    ``groups`` at a time, and gives them out when it is full or done. What is shuffled are those vectors' entries, as
    many as tasks x groups x replicates, whatever the number of units. Draws are those of ``draw`` and ``poisson_one``.
    """
    keys = units.select(*by).schema.fields
    rows = units.select(*by, F.col(unit).cast("string").alias("__unit"), "a", "b")
    cut = np.array(POISSON)
    marks = [f"{seed}|{k}" for k in range(replicates)]

    def weights(name: str | None) -> np.ndarray:
        tail = "" if name is None else f"|{name}"
        u = [int(hashlib.md5((m + tail).encode()).hexdigest()[:13], 16) for m in marks]
        return np.searchsorted(cut, np.array(u, np.float64) / 2.0**52, "right").astype(np.float64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            n = len(held) * replicates
            columns = [pa.array([k[c] for k in held for _ in range(replicates)], schema.field(c).type) for c in range(len(keys))]
            sums = np.concatenate(list(held.values()), 1) if held else np.empty((2, 0))
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n, dtype=np.int32) % replicates), pa.array(sums[0]), pa.array(sums[1])], names=[*[f.name for f in keys], "replicate", "a", "b"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for *key, name, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                w = weights(name)
                at = held.setdefault(tuple(key), np.zeros((2, replicates)))
                at[0] += w * a
                at[1] += w * b
                if len(held) > groups:
                    yield told()
        if held:
            yield told()

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["replicate int", "a double", "b double"])
    return rows.mapInArrow(add, kinds).groupBy(*by, "replicate").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def bootstrap_interval(sums: DataFrame, unit: str, by: list[str], numerator: str, denominator: str, replicates: int = 500, seed: int = 7) -> DataFrame:
    """Percentile interval of sum(numerator) / sum(denominator) over resampled units (clusters).

    Rows are first summed by unit; a unit's weight in a replicate is a Poisson(1) hash draw, so that resampling is one
    aggregation (``replicate_sums``). Replicates without a denominator are left out, and their number is told.
    """
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    units = sums.groupBy(*by, unit).agg(total(numerator).alias("a"), total(denominator).alias("b"))
    each = replicate_sums(units, unit, by, replicates, seed).where("b > 0").withColumn("value", F.col("a") / F.col("b"))
    point = units.groupBy(*by).agg(F.try_divide(F.sum("a"), F.sum("b")).alias("estimate"), F.count("*").alias("n_units")) if by else units.agg(F.try_divide(F.sum("a"), F.sum("b")).alias("estimate"), F.count("*").alias("n_units"))
    ends = [F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count("*").alias("n_replicates")]
    return met(point, each.groupBy(*by).agg(*ends), by) if by else point.crossJoin(each.agg(*ends))  # one row each


def bootstrap_metric(scores: DataFrame, unit: str, metric, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of a metric of tie tables: ``metric(ties, by)`` gives a column ``value`` for each replicate.

    A unit's Poisson(1) draw weighs its scores, which are counted by unit and score before they are repeated for the
    replicates; a null value is a degenerate replicate and is left out.
    """
    counted = tie_table(scores, [unit])
    rows = counted.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = rows.withColumn("copies", poisson_one(draw(seed, F.col("replicate"), F.col(unit)))).where("copies > 0")
    ties = rows.groupBy("replicate", "prob").agg(F.sum(F.col("copies") * F.col("pos")).alias("pos"), F.sum(F.col("copies") * F.col("neg")).alias("neg"))
    value = metric(ties, ["replicate"]).where("value is not null")
    return value.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.5).alias("mid"), F.percentile("value", 0.975).alias("high"), F.count("*").alias("n_replicates"))


def platt_fit(scores: DataFrame, by: list[str], rounds: int = 12) -> DataFrame:
    """slope and intercept of a logistic fit of y on the score's logit, L2 on the slope (C = 1), by Newton's method.

    Each round is one aggregation of gradients and curvatures for all groups, written down before the next, so that
    only a row for each group is kept. A group of one class, or with a slope of 0 or less, gets nulls.
    """
    from .scoring import logit

    # equal scores are one weighted row; kept, as each round reads them
    x = scores.groupBy(*by, "prob").agg(F.sum(F.col("y").cast("double")).alias("pos"), F.count("*").cast("double").alias("n")).withColumn("x", logit(F.col("prob"))).persist()
    fit = x.groupBy(*by).agg(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.sum("pos").alias("p"), F.sum("n").alias("m"))
    # a row for each group; written down after the last round too: sums of doubles depend on their order, and what is
    # scanned several times must not have two values
    settled = lambda fit: scores.sparkSession.createDataFrame(fit.collect(), fit.schema)
    for k in range(rounds):
        fit = settled(fit) if k else fit
        q = 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
        w = F.col("n") * q * (1 - q)
        g = x.join(F.broadcast(fit), by).groupBy(*by, "a", "b", "p", "m").agg(F.sum((F.col("n") * q - F.col("pos")) * F.col("x")).alias("ga"), F.sum(F.col("n") * q - F.col("pos")).alias("gb"), F.sum(w * F.col("x") * F.col("x")).alias("haa"), F.sum(w * F.col("x")).alias("hab"), F.sum(w).alias("hbb"))
        ga, haa = F.col("ga") + F.col("a"), F.col("haa") + 1
        det = haa * F.col("hbb") - F.col("hab") * F.col("hab")
        fit = g.select(*by, F.when(det > 1e-12, F.col("a") - (F.col("hbb") * ga - F.col("hab") * F.col("gb")) / det).otherwise(F.col("a")).alias("a"), F.when(det > 1e-12, F.col("b") - (haa * F.col("gb") - F.col("hab") * ga) / det).otherwise(F.col("b")).alias("b"), "p", "m")
    fit = settled(fit)
    x.unpersist()
    sound = (F.col("p") > 0) & (F.col("p") < F.col("m")) & (F.col("a") > 0)
    return fit.select(*by, F.when(sound, F.col("a")).alias("slope"), F.when(sound, F.col("b")).alias("intercept"))
