"""Ranking, classification and agreement metrics over long score tables (…, y 0/1, prob).

``by`` names the columns of a group; metrics of all groups come from one pass. Scores are first aggregated to a tie table
(…, prob, pos, neg); what counts scores before others does so within ranges of scores, after the sums of the ranges
before them, so that no task sorts a whole group however many distinct scores it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .distributions import EXACT_PAIRS, correlation_p, normal_two_sided, signed_rank_p, t_two_sided

#: Ranges that a group's order is cut into.
RANGES = 32


def tie_table(scores: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Positives and negatives of each distinct score; ``weight`` weighs negatives."""
    neg = (1 - F.col("y")).cast("double") * (weight if weight is not None else F.lit(1.0))
    return scores.groupBy(*by, "prob").agg(F.sum(F.col("y").cast("double")).alias("pos"), F.sum(neg).alias("neg"))


def met(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Inner join in which null groups meet too; the columns of ``by`` stay those of ``df``."""
    other = other.select(*[F.col(c).alias(f"__other_{c}") if c in by else F.col(c) for c in other.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__other_{c}")) for c in by]
    return df.join(other, same).drop(*[f"__other_{c}" for c in by])


def running(df: DataFrame, by: list[str], key: str, sums: list[str]) -> DataFrame:
    """Adds for each of ``sums`` <name>_before (its sum over smaller keys of the group) and <name>_all, and key_next (the next key).

    df has one row for each key of a group; a null key comes first. Ranges end at approximate quantiles, so they are about
    equally large; they decide nothing but how the work is shared out.
    """
    cuts = df.groupBy(*by).agg(F.percentile_approx(key, [k / RANGES for k in range(1, RANGES)], 1000).alias("__cuts"))
    placed = met(df, cuts, by).withColumn("__range", F.when(F.col(key).isNull(), -1).otherwise(F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(key))), F.lit(0)))).drop("__cuts")
    ranges = placed.groupBy(*by, "__range").agg(F.min(key).alias("__least"), *[F.sum(c).alias(f"__{c}") for c in sums])
    order, whole = Window.partitionBy(*by).orderBy("__range"), Window.partitionBy(*by)  # RANGES + 1 rows at most
    ranges = ranges.select(*by, "__range", F.lead("__least").over(order).alias("__then"), *[c for s in sums for c in (F.coalesce(F.sum(f"__{s}").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"__{s}"), F.sum(f"__{s}").over(whole).alias(f"{s}_all"))])
    within = Window.partitionBy(*by, "__range").orderBy(key)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    out = met(placed, ranges, [*by, "__range"])
    out = out.withColumns({f"{c}_before": F.col(f"__{c}") + F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in sums} | {f"{key}_next": F.coalesce(F.lead(key).over(within), "__then")})
    return out.drop("__range", "__then", *[f"__{c}" for c in sums])


def medians(df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """(…by, a column for each name): exact medians of few large groups; nulls don't count, a group without a value has null.

    All columns are counted by value in one table, and places summed up within ranges, so that no buffer holds a group's
    values: a median is the value, or the mean of the two, whose places enclose the middle.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), c.cast("double").alias("v")) for name, c in columns.items()])).alias("m")
    values = df.select(*by, each).select(*by, "m.name", "m.v").groupBy(*by, "name", "v").agg(F.count("v").cast("double").alias("n"))
    run = running(values, [*by, "name"], "v", ["n"])
    middle = (F.col("n_all") - 1) / 2
    holds = lambda place: (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))
    low, high = (F.max(F.when(holds(place), F.col("v"))) for place in (F.floor(middle), F.ceil(middle)))
    ends = run.groupBy(*by, "name").agg(low.alias("low"), high.alias("high")).withColumn("median", F.col("low") + (F.col("high") - F.col("low")) / 2)
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("median"))).alias(name) for name in columns])


def _ranks() -> list[Column]:
    """Aggregates over a running tie table: p, q, u (pairs in order) and a (precision sums)."""
    pos, neg = F.col("pos"), F.col("neg")
    tp = F.col("pos_all") - F.col("pos_before")
    seen = tp + F.col("neg_all") - F.col("neg_before")
    return [F.sum(pos).alias("p"), F.sum(neg).alias("q"), F.sum(pos * (F.col("neg_before") + neg / 2)).alias("u"), F.sum(F.when(pos > 0, pos * tp / seen).otherwise(0.0)).alias("a")]


def _ranked() -> list[Column]:
    """n, positives, auroc and average_precision of what ``_ranks`` gave."""
    p, q = F.col("p"), F.col("q")
    both = (p > 0) & (q > 0)
    return [(p + q).cast("long").alias("n"), p.cast("long").alias("positives"), F.when(both, F.col("u") / (p * q)).alias("auroc"), F.when(both, F.col("a") / p).alias("average_precision")]


def ranking_of(ties: DataFrame, by: list[str]) -> DataFrame:
    """As ``ranking``, of a tie table."""
    return running(ties, by, "prob", ["pos", "neg"]).groupBy(*by).agg(*_ranks()).select(*by, *_ranked())


def ranking(scores: DataFrame, by: list[str]) -> DataFrame:
    """auroc and average_precision of each group, null where only one class occurs; n and positives."""
    return ranking_of(tie_table(scores, by), by)


def counts(active: Column) -> list[Column]:
    """tp, fp, tn, fn of a boolean prediction."""
    y = F.col("y") == 1
    return [F.count_if(active & y).alias("tp"), F.count_if(active & ~y).alias("fp"), F.count_if(~active & ~y).alias("tn"), F.count_if(~active & y).alias("fn")]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def with_rates(df: DataFrame) -> DataFrame:
    """Rates of a table with tp, fp, tn, fn; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns({
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "f1": f1(tp, fp, fn),
    })


def operating_point(scores: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts and rates at ``prob >= threshold``, with ranking metrics, from one tie table: one row for each group."""
    keys = by or ["__all"]
    ties = tie_table(scores if by else scores.withColumn("__all", F.lit(1)), keys)
    active, pos, neg = F.col("prob") >= threshold, F.col("pos"), F.col("neg")
    some = lambda c, x: F.sum(F.when(c, x).otherwise(0.0)).cast("long")
    at = running(ties, keys, "prob", ["pos", "neg"]).groupBy(*keys).agg(*_ranks(), some(active, pos).alias("tp"), some(active, neg).alias("fp"), some(~active, neg).alias("tn"), some(~active, pos).alias("fn"))
    return with_rates(at.select(*by, "tp", "fp", "tn", "fn", *_ranked()))


def brier() -> Column:
    return F.avg(F.pow(F.col("prob") - F.col("y"), 2))


def bin_of(prob: Column, bins: int = 10) -> Column:
    """The number of a score's right-closed bin; 0 lies in the first."""
    return sum((F.when(prob > k / bins, 1).otherwise(0) for k in range(1, bins)), F.lit(0))


def calibration_error(scores: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal right-closed bins."""
    part = scores.groupBy(*by, bin_of(F.col("prob"), bins).alias("bin")).agg(F.count("*").alias("k"), F.abs(F.avg("prob") - F.avg("y")).alias("gap"))
    return part.groupBy(*by).agg((F.sum(F.col("k") * F.col("gap")) / F.sum("k")).alias("ece"))


def class_metrics(scores: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Of each group n, positives, auroc, average_precision, tp, fp, fn, brier and ece: all from one tie table."""
    prob, pos, neg, n = F.col("prob"), F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    active = prob >= threshold
    run = running(tie_table(scores, by), by, "prob", ["pos", "neg"])
    some = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    part = run.groupBy(*by, bin_of(prob).alias("bin")).agg(
        *_ranks(), some(active, pos).alias("tp"), some(active, neg).alias("fp"), some(~active, pos).alias("fn"),
        F.sum(pos * F.pow(prob - 1, 2) + neg * prob * prob).alias("squares"), F.abs(F.sum(n * prob) - F.sum(pos)).alias("gap"),
    )
    whole = part.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("p", "q", "u", "a", "tp", "fp", "fn", "squares", "gap")])
    size = F.col("p") + F.col("q")
    return whole.select(*by, *_ranked(), "tp", "fp", "fn", (F.col("squares") / size).alias("brier"), (F.col("gap") / size).alias("ece"))


def multilabel_report(scores: DataFrame, by: list[str] | None = None, threshold: float = 0.5, min_positives: int = 1) -> DataFrame:
    """Macro and micro metrics over the eligible classes (min_positives <= positives < n) of each group.

    Without any eligible class all metrics are 0.
    """
    by = by or []
    per = class_metrics(scores, [*by, "class"], threshold)
    ok = (F.col("positives") >= min_positives) & (F.col("positives") < F.col("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda c: zero(F.avg(F.when(ok, c)))
    total = {c: F.sum(F.when(ok, F.col(c))) for c in ("tp", "fp", "fn")}
    aggregates = [
        F.count("*").alias("n_classes"), F.count_if(ok).alias("n_eligible"), mean(F.col("auroc")).alias("macro_auroc"), mean(F.col("average_precision")).alias("macro_ap"),
        mean(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), zero(f1(total["tp"], total["fp"], total["fn"])).alias("micro_f1"),
        mean(F.col("brier")).alias("macro_brier"), mean(F.col("ece")).alias("macro_ece"),
    ]
    return per.groupBy(*by).agg(*aggregates) if by else per.agg(*aggregates)


def vector_comparison(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", threshold: float = 0.5) -> DataFrame:
    """cosine (0 for a zero vector), mean_abs_difference and agreement at ``threshold`` of vectors in long form."""
    x, y = F.col(a), F.col(b)
    size = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return pairs.groupBy(*by).agg(ratio(F.sum(x * y), size).alias("cosine"), F.avg(F.abs(x - y)).alias("mean_abs_difference"), F.avg(((x >= threshold) == (y >= threshold)).cast("double")).alias("agreement"))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over pairs that are there; null where a side is constant, and never an error."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def midranks(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Adds average ranks of ``column`` in each group, from its distinct values."""
    counted = df.groupBy(*by, column).agg(F.count("*").alias("__times"))
    return met(df, midranks_of(counted, by, column, name), [*by, column])


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """rho of each group, null where a column is constant or there are fewer than two rows, and its two-sided p, null below three."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("__times"))
    rank = lambda c, name: midranks_of(pairs, by, c, name)
    ranked = met(met(pairs, rank(x, "__x"), [*by, x]), rank(y, "__y"), [*by, y])
    n, w, a, b = F.sum("__times"), F.col("__times"), F.col("__x"), F.col("__y")
    mean = (n + 1) / 2  # of midranks
    sums = ranked.groupBy(*by).agg(n.alias("n"), (F.min("__x") == F.max("__x")).alias("flat_x"), (F.min("__y") == F.max("__y")).alias("flat_y"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), mean.alias("mean"))
    spread = lambda c: F.col(c) - F.col("n") * F.col("mean") * F.col("mean")
    steady = (F.col("n") < 2) | F.col("flat_x") | F.col("flat_y")
    out = sums.select(*by, "n", F.when(~steady, spread("ab") / F.sqrt(spread("aa") * spread("bb"))).alias("rho"))
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def paired_test(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """n, wins, mean, sd, t, t_p, w and w_p of each group's paired differences; null differences are left out.

    t needs two pairs that are not all equal. Signed ranks leave out zeros: w is the smaller sum of midranks, w_p counts all
    signs out up to EXACT_PAIRS pairs and is normal, corrected for ties, beyond; null below five pairs or without a difference.
    """
    if not by:
        return paired_test(df.withColumn("__one", F.lit(1)), ["__one"], delta).drop("__one")
    rows = df.where(F.col(delta).isNotNull())
    sd = F.stddev_samp(delta)
    told = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(delta) > 0).alias("wins"), F.avg(delta).alias("mean"), F.when(F.count("*") > 1, sd).alias("sd"))
    told = told.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))).withColumn("t_p", t_two_sided(F.col("t"), F.col("n") - 1))
    sized = rows.where(F.col(delta) != 0).withColumn("size", F.round(F.abs(delta), 12))
    ranks = midranks_of(sized.groupBy(*by, "size").agg(F.count("*").alias("__times")), by, "size", "r")
    ranked = met(sized, ranks, [*by, "size"])
    few = met(ranked, sized.groupBy(*by).agg(F.count("*").alias("pairs")), by).withColumn("doubled", F.when(F.col("pairs") <= EXACT_PAIRS, F.round(2 * F.col("r")).cast("int")))
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0))
    sums = few.groupBy(*by).agg(F.first("pairs").alias("pairs"), F.least(side(F.col(delta) > 0), side(F.col(delta) < 0)).alias("w"), F.collect_list("doubled").alias("doubled"), F.sum(F.col("r") * F.col("r")).alias("squares"))
    m = F.col("pairs").cast("double")
    z = (F.col("w") - m * (m + 1) / 4) / F.sqrt(F.col("squares") / 4)  # the sum of squared midranks has the ties in it
    sums = sums.withColumn("w_p", F.when(F.col("pairs") <= EXACT_PAIRS, signed_rank_p(F.col("doubled"), F.col("w"))).otherwise(normal_two_sided(z)))
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], "w", "w_p")
    out = told.join(sums, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").drop(*[f"__{c}" for c in by])  # a row for each group
    return out.withColumn("w_p", F.when(F.col("n") >= 5, F.col("w_p")))


def midranks_of(counted: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Average ranks of the distinct values of ``column`` in a table that counts its rows in ``__times``."""
    values = counted.groupBy(*by, column).agg(F.sum("__times").cast("double").alias("__n"))
    return running(values, by, column, ["__n"]).select(*by, column, (F.col("__n_before") + (F.col("__n") + 1) / 2).alias(name))


def separation(scores: DataFrame, by: list[str]) -> DataFrame:
    """Median score of positives less that of negatives."""
    found = medians(scores, by, {f"__{v}": F.when(F.col("y") == v, F.col("prob")) for v in (0, 1)})
    return found.select(*by, (F.col("__1") - F.col("__0")).alias("separation"))