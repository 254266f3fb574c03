"""Cohorts: sampling, splitting, weighting, set operations and guards against leakage.

Every draw is an order by ``md5(seed|id)``: the same in any partitioning and in any engine with md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


from .metrics import met, running


class CohortError(ValueError):
    """A cohort that breaks its contract."""


def draw(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def guarded(df: DataFrame, bad: DataFrame, what: str) -> DataFrame:
    """``df``, if ``bad`` is empty; else an error that shows some of its rows.

    A guard runs a job when it is called, so that a broken cohort stops the program before anything is written.
    """
    rows = bad.limit(5).collect()
    if rows:
        raise CohortError(f"{what}: {rows}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return guarded(df, duplicate_keys(df, keys), f"repeated {keys}")


def select_fold(df: DataFrame, fold: int, holdout: bool, column: str = "fold") -> DataFrame:
    """One fold, or all others."""
    return df.where(F.col(column) == fold if holdout else F.col(column) != fold)


def select_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of an explicit split; nothing there is an error, found by a job when this is called."""
    if split not in ("tune", "test"):
        raise CohortError(f"split {split}")
    out = df.where(F.col(column) == split)
    if out.isEmpty():
        raise CohortError(f"no rows in split {split}")
    return out


def with_fold(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Left join of fold assignments; a row without one is an error."""
    out = df.join(folds, key, "left")
    return guarded(out, out.where("fold is null").select(key), "no fold")


def paired_keys(a: DataFrame, b: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Rows of two reports that do not match: a key only one has, or different digests."""
    x, y = a.select(*keys, F.col(digest).alias("da")), b.select(*keys, F.col(digest).alias("db"))
    return x.join(y, keys, "full_outer").where(~F.col("da").eqNullSafe(F.col("db")) | F.col("da").isNull())


def exact_lock(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """The rows of exactly the manifest's keys, with its columns; repeated or missing keys are errors."""
    unique(manifest, [key])
    out = df.join(manifest, key)
    missing = manifest.join(df, key, "left_anti").select(key)
    return guarded(unique(out, [key]), missing, "missing")


def pending(requested: DataFrame, done: DataFrame, poisoned: DataFrame, key: str) -> DataFrame:
    return requested.join(done, key, "left_anti").join(poisoned, key, "left_anti")


def allocate_groups(total: Column, shares: dict[str, float]) -> dict[str, Column]:
    """Largest-remainder counts of ``total`` by shares; equal remainders in the order given."""
    names = list(shares)
    exact = {k: total * v for k, v in shares.items()}
    floor = {k: F.floor(e) for k, e in exact.items()}
    left = total - sum((floor[k] for k in names), F.lit(0))
    rest = {k: F.round(exact[k] - floor[k], 9) for k in names}

    def place(k: str) -> Column:
        i = names.index(k)
        before = [F.when((rest[j] > rest[k]) | ((rest[j] == rest[k]) & F.lit(names.index(j) < i)), 1).otherwise(0) for j in names if j != k]
        return sum(before, F.lit(0))

    return {k: (floor[k] + F.when(place(k) < left, 1).otherwise(0)).cast("long") for k in names}


def share_totals(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Largest-remainder counts of a whole number; equal remainders in the order given."""
    exact = {k: round(total * v, 9) for k, v in shares.items()}
    out = {k: int(e) for k, e in exact.items()}
    for k in sorted(shares, key=lambda k: (out[k] - exact[k], list(shares).index(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def _taken(place: Column, part: int, whole: int) -> Column:
    """How many of the first ``place`` of ``whole`` places are dealt to a part that gets ``part`` of them, evenly spread."""
    return F.call_function("div", place.cast("decimal(19,0)") * F.lit(part).cast("decimal(18,0)"), F.lit(max(1, whole)).cast("decimal(18,0)"))


def dealt(position: Column, totals: dict[str, int]) -> Column:
    """The part that a position (from 1 on, up to the sum of ``totals``) goes to; parts are spread evenly over the positions.

    Parts are dealt in turn: the first takes every place at which its rounded-down share grows, the next does so with the
    places that are left. Totals are exact. Of any stretch of positions the first part gets its share, less or more than
    one; each later part less or more than two.
    """
    names, left = list(totals), sum(totals.values())
    out, place = None, position
    for k in names[:-1]:
        here = _taken(place, totals[k], left) > _taken(place - 1, totals[k], left)
        out = F.when(here, k) if out is None else out.when(here, k)
        place, left = place - _taken(place, totals[k], left), left - totals[k]
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def positions(df: DataFrame, key: str, by: str, seed: int) -> DataFrame:
    """Adds ``position``: rows in order of ``by`` (null first), and in hash order of ``key`` where that is equal, counted from 1.

    Values of ``by`` are a table much smaller than ``df``; its sizes are added up in order, rows are counted within ranges.
    """
    order = Window.orderBy(F.col(by).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(by).agg(F.count("*").alias("__n")).select(by, F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__first"))
    return met(top_by_hash(df, key, seed, [by]), sizes, [by]).withColumn("position", F.col("__first") + F.col("place")).drop("place", "__first")


def grouped_split(records: DataFrame, group: str, category: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """(group, split): no group is in two splits, the splits' sizes are the largest-remainder counts of all groups, and categories are shared out alike.

    Groups stand in order of their signature (their categories, the rarest first) and then of a hash; splits are dealt
    evenly along that order. So each signature, and each run of signatures that begin with the same rare categories, gets
    its share of each split within 2 (of the first split, within 1), and a category is off by no more than that for each
    run it is spread over. This is the parallel form of a greedy balance: sizes are as exact, the draw is another.
    Sizes are counted by a job when this is called.
    """
    pairs = records.select(group, category).distinct()
    often = pairs.groupBy(category).agg(F.count("*").alias("__often"))
    ranked = met(pairs, often, [category]).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__often", category))).alias("__all"))
    groups = ranked.select(group, F.array_join(F.transform("__all", lambda c: F.concat(F.lpad(c["__often"].cast("string"), 19, "0"), F.lit(":"), c[category].cast("string"))), "+").alias("signature"))
    return positions(groups, group, "signature", seed).select(group, dealt(F.col("position"), share_totals(groups.count(), shares)).alias("split"))


def split_leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def group_folds(df: DataFrame, group: str, k: int, positive: str = "y", seed: int = 42) -> DataFrame:
    """(group, fold): groups of equal positive counts are dealt to folds in hash order, back and forth."""
    each = df.groupBy(group).agg(F.sum(positive).alias("positives"), F.count("*").alias("n"))
    step = (F.col("place") - 1) % (2 * k)
    return top_by_hash(each, group, seed, ["positives"]).withColumn("step", step).select(group, "positives", "n", F.when(F.col("step") < k, F.col("step")).otherwise(2 * k - 1 - F.col("step")).cast("int").alias("fold"))


def fold_summary(df: DataFrame, group: str, positive: str = "y") -> DataFrame:
    return df.groupBy("fold").agg(F.count("*").alias("records"), F.countDistinct(group).alias("groups"), F.sum(positive).cast("long").alias("positives"), F.avg(F.col(positive).cast("double")).alias("rate"))


def proportional_holdout(df: DataFrame, layout: str, key: str, share: float | int, seed: int = 42) -> DataFrame:
    """Adds split tune or test: exactly ``share`` rows (a float: that share of all, rounded half to even) are test.

    Rows stand in order of layout and then of a hash, and test is dealt evenly along it: each layout, and all layouts up
    to any, has its share within 1. A count that is more than there are is an error; rows are counted by a job when this
    is called.
    """
    total = df.count()
    test = share if isinstance(share, int) else round(total * share)
    if test > total:
        raise CohortError(f"{test} of {total} rows")
    place = positions(df, key, layout, seed)
    return place.withColumn("split", dealt(F.col("position"), {"test": test, "tune": total - test})).drop("position")


def priority_sample(df: DataFrame, key: str, rules: list[tuple[str, Column, int]], seed: int = 42) -> DataFrame:
    """Rows chosen rule by rule, each used once and at most the rule's limit: key, rule.

    A rule's limit leaves rows to later rules, so rules are applied in order; their number is fixed.
    """
    left, out = df, None
    for name, cond, limit in rules:
        picked = left.where(cond).select(key).orderBy(draw(seed, F.col(key)), key).limit(limit).select(key, F.lit(name).alias("rule"))
        out = picked if out is None else out.unionByName(picked)
        left = left.join(picked, key, "left_anti")
    return out


def case_control(df: DataFrame, key: str, ratio: float, positive: str = "y", seed: int = 42) -> DataFrame:
    """All positives, and negatives in hash order up to the rounded ratio of them."""
    quota = df.agg(F.bround(F.sum(positive) * ratio).cast("long").alias("quota"))
    negatives = df.where(F.col(positive) == 0)
    place = top_by_hash(negatives, key, seed)
    return df.where(F.col(positive) == 1).unionByName(place.crossJoin(F.broadcast(quota)).where("place <= quota").drop("place", "quota"))  # quota is one row


def top_by_hash(df: DataFrame, key: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """Adds each row's place in hash order, of its group ``by`` if told, by a two-phase count: places within hash ranges after the ranges before them."""
    by = by or []
    ranged = df.withColumn("__h", draw(seed, F.col(key))).withColumn("__r", F.substring("__h", 1, 2))
    order = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "__r").agg(F.count("*").alias("__n"))  # 256 rows of a group at most
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__h", key))
    return met(ranged.withColumn("__w", within), before, [*by, "__r"]).withColumn("place", F.col("__w") + F.col("__before")).drop("__h", "__r", "__w", "__before")


def balanced_pick(df: DataFrame, key: str, category: str, n_categories: int, required: list, n: int, seed: int = 42) -> DataFrame:
    """``n`` keys that every category has: required ones first, then in hash order."""
    everywhere = in_all(df, key, category, n_categories)
    return everywhere.orderBy(F.when(F.col(key).isin(required), 0).otherwise(1), draw(seed, F.col(key)), key).limit(n)


def in_all(df: DataFrame, key: str, category: str, k: int) -> DataFrame:
    """Keys that occur in all ``k`` categories."""
    return df.groupBy(key).agg(F.countDistinct(category).alias("k")).where(F.col("k") == k).select(key)


def missing_pairs(df: DataFrame, key: str, category: str, categories: list[str]) -> DataFrame:
    """(key, category) pairs that are expected of each key but absent."""
    want = df.select(key).distinct().withColumn(category, F.explode(F.array(*map(F.lit, categories))))
    return want.join(df.select(key, category).distinct(), [key, category], "left_anti")


def one_per_entity(df: DataFrame, entity: str, key: str, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(draw(seed, F.col(key)), key)
    return df.withColumn("__p", F.row_number().over(w)).where("__p = 1").drop("__p")


def class_weights(labels: DataFrame, cap: float = 50.0, least: int = 10) -> DataFrame:
    """neg / pos of each class, capped; null for a class with too few positives."""
    c = labels.groupBy("class").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return c.withColumn("weight", F.when(F.col("pos") >= least, F.least(F.col("neg") / F.col("pos"), F.lit(cap))))


def subgroup_weight(label: Column, member: Column, weight: float) -> Column:
    """``weight`` for positives of a subgroup, 1 for all other rows, those with a null included."""
    return F.when((label == 1) & (member == 1), F.lit(float(weight))).otherwise(1.0)


def masked_labels(labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Labels whose class has no weight, or is unknown to ``weights`` (class, weight), as null: they teach nothing.

    ``weights`` has a row for each class and is broadcast.
    """
    held = weights.where(F.col("weight").isNotNull()).select("class", F.lit(True).alias("__held"))
    return labels.join(F.broadcast(held), "class", "left").withColumn("y", F.when(F.col("__held"), F.col("y"))).drop("__held")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row, ``edges``: exact linear-interpolated quantiles of a column, from counts of its distinct values.

    Values are counted, and their places summed up within ranges, so that no buffer holds them all; an edge is made of
    the one or two values whose places enclose it. No value: no edges.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"), F.lit(1).alias("one"))
    run = running(values, ["one"], "v", ["n"])
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col("n_all") - 1)).alias("at")) for k, q in enumerate(shares)]))
    near = run.select("v", "n", "n_before", at.alias("q")).select("v", "n", "n_before", "q.k", "q.at")
    holds = lambda place: (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))
    ends = near.groupBy("k", "at").agg(F.max(F.when(holds(F.floor("at")), F.col("v"))).alias("lo"), F.max(F.when(holds(F.ceil("at")), F.col("v"))).alias("hi"))
    edge = F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo"))
    return ends.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", edge.alias("e")))), lambda x: x["e"]).alias("edges"))


def quantile_strata(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Adds ``stratum``: right-closed bins between quantiles, so that equal values share a bin; equal edges are merged."""
    k = len(labels)
    edges = quantiles(df, column, [i / k for i in range(1, k)]).select(F.array_distinct("edges").alias("edges"))
    held = df.crossJoin(F.broadcast(edges))  # one row
    at = F.size(F.filter("edges", lambda e: F.col(column) > e))
    return held.withColumn("stratum", F.when(F.col(column).isNotNull(), F.element_at(F.array(*map(F.lit, labels)), at + 1))).drop("edges")


def content_address(df: DataFrame, columns: list[str]) -> DataFrame:
    """manifest_id and n: a digest of all rows that does not depend on their order."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)]), 256)
    # rows are digested in 4096 parts by their own digest first, so that no task holds them all
    parts = df.select(row.alias("r")).groupBy(F.substring("r", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("r")), ""), 256).alias("d"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("p", "d"))), ""), 256).alias("manifest_id"), F.sum("n").alias("n"))


def request_is_safe() -> Column:
    """Whether purpose, stage, split, manifest and evidence may go together."""
    none = F.col("split").isNull()
    dev = (F.col("purpose") == "development-baseline") & (F.col("stage") == "development") & ~F.col("has_manifest") & none
    tune = (F.col("purpose") == "threshold-tuning") & (F.col("stage") == "development") & F.col("has_manifest") & F.coalesce(F.col("split") == "tune", F.lit(False))
    holdout = (F.col("stage") == "holdout") & F.col("has_manifest") & F.coalesce(F.col("split") == "test", F.lit(False)) & F.coalesce(F.col("evidence") == "pre-registered", F.lit(False))
    external = (F.col("stage") == "external") & ~F.col("has_manifest") & none
    return dev | tune | ((F.col("purpose") == "locked-evaluation") & (holdout | external))


SHA_PATTERN = r"^[0-9a-f]{64}$"


def safe_path(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & ~c.startswith("/") & ~F.array_contains(F.split(c, "/"), ".."), F.lit(False))


def strict_true(c: Column) -> Column:
    """true only for the word true, in any case and with spaces around it."""
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def manifest_errors(df: DataFrame, variants: list[str], splits: list[str], id_pattern: str) -> DataFrame:
    """All violations: (case_id, field, rule), of rows and of groups (a case in two splits, a repeated photo).

    Rules: pattern, flag (not affirmed), choice (not among the allowed values), path, digest, leak and repeat.
    """
    sound = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        ("case_id", "pattern", sound(F.col("case_id").rlike(id_pattern))), ("path", "path", safe_path(F.col("path"))), ("phi_reviewed", "flag", strict_true(F.col("phi_reviewed"))),
        ("sha256", "digest", sound(F.col("sha256").rlike(SHA_PATTERN))), ("split", "choice", sound(F.col("split").isin(splits))), ("variant", "choice", sound(F.col("variant").isin(variants))),
    ]
    broken = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), ok.alias("ok")) for f, r, ok in checks]), lambda x: ~x["ok"])
    rows = df.select("case_id", F.explode(broken).alias("x")).select("case_id", "x.field", "x.rule")
    told = lambda found, field, rule: found.select("case_id", F.lit(field).alias("field"), F.lit(rule).alias("rule"))
    twice = df.groupBy("photo_id").agg(F.count("*").alias("n"), F.min("case_id").alias("case_id")).where("n > 1")
    return rows.unionByName(told(split_leaks(df, "case_id"), "split", "leak")).unionByName(told(twice, "photo_id", "repeat"))


def built_manifest(inventory: DataFrame, files: DataFrame, key: str, variants: list[str], splits: list[str], id_pattern: str) -> DataFrame:
    """The inventory's rows whose case breaks no rule and whose file is there with the digest told; sha256 is the file's own.

    files: (key, found), the digests of the files that exist. Repeated keys of files are one.
    """
    broken = manifest_errors(inventory, variants, splits, id_pattern).select("case_id").distinct()
    sound = inventory.join(broken, "case_id", "left_anti").join(files.select(key, "found").distinct(), key)
    return sound.where(F.lower("sha256") == F.lower("found")).withColumn("sha256", F.lower("found")).drop("found")
