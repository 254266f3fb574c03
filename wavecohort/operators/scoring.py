"""From scores to findings: joins with calibration tables, transforms, lists and training-table sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that both arms have."""
    return a.join(b, keys)


def unpivot_arms(df: DataFrame, arms: dict[str, str], keep: list[str]) -> DataFrame:
    """One row for each arm, with its score as ``prob``."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(c).alias("prob")) for k, c in arms.items()])).alias("a")).select(*keep, "a.arm", "a.prob")


def in_subgroups(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """A row for each overlapping subgroup that a row belongs to; a null mask is false."""
    return df.withColumn("subgroup", F.explode(F.filter(F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()]), lambda x: x.isNotNull())))


def combined_heads(scores: DataFrame, by: list[str]) -> DataFrame:
    """The greatest and the mean score of several classes as two heads; positive if any class is."""
    both = scores.groupBy(*by).agg(F.max("y").alias("y"), F.max("prob").alias("hi"), F.avg("prob").alias("lo"))
    return both.select(*by, "y", F.explode(F.array(F.struct(F.lit("max").alias("head"), F.col("hi").alias("prob")), F.struct(F.lit("mean").alias("head"), F.col("lo").alias("prob")))).alias("h")).select(*by, "y", "h.head", "h.prob")


def combine_views(scores: DataFrame, by: list[str]) -> DataFrame:
    """mean and greatest score over views."""
    return scores.groupBy(*by).agg(F.avg("prob").alias("mean"), F.max("prob").alias("hi"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, 0 for a zero vector."""
    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(d(a, a) * d(b, b))
    return F.when(size == 0, 0.0).otherwise(d(a, b) / size)


def is_active(threshold: Column) -> Column:
    """At least the class cutoff, or the general one where the class has none."""
    return F.col("prob") >= F.coalesce(F.col("class_threshold"), threshold)


def is_hidden_research(critical: list[str]) -> Column:
    return (F.col("tier") == "research_only") & ~F.col("class").isin(*critical)


def is_critical(active: Column, critical: list[str]) -> Column:
    return active & F.col("class").isin(*critical)


def with_calibration(df: DataFrame, calibration: DataFrame, default: float) -> DataFrame:
    """threshold and tier of each class; a class without an entry gets the default and is research_only."""
    out = df.join(F.broadcast(calibration), "class", "left")
    return out.withColumns({"threshold": F.coalesce("threshold", F.lit(default)), "tier": F.coalesce("tier", F.lit("research_only"))})


def collect_results(vectors: DataFrame, classes: list[str], calibration: DataFrame, threshold: float) -> DataFrame:
    """Active classes of probability vectors (record_id, probs), with their cutoff and tier."""
    names = F.array(*map(F.lit, classes))
    rows = vectors.select("record_id", F.posexplode("probs").alias("class_idx", "prob")).withColumn("class", F.element_at(names, F.col("class_idx") + 1))
    rows = rows.join(F.broadcast(calibration), "class", "left").where(is_active(F.lit(threshold)))
    return rows.select("record_id", "class", "class_idx", "prob", "class_threshold", F.coalesce("tier", F.lit("research_only")).alias("tier"))


def top_classes(scores: DataFrame, k: int, active: Column) -> DataFrame:
    """The ``k`` likeliest classes of each record, ties by index."""
    w = Window.partitionBy("record_id").orderBy(F.desc("prob"), "class_idx")
    return scores.withColumns({"place": F.row_number().over(w), "active": active}).where(F.col("place") <= k)


def logit(p: Column, margin: float = 1e-6) -> Column:
    c = F.least(F.greatest(p, F.lit(margin)), F.lit(1 - margin))
    return F.log(c / (1 - c))


def platt(prob: str = "prob") -> Column:
    """Sigmoid of slope * logit + intercept; classes without a slope stay as they are."""
    return F.when(F.col("slope").isNotNull(), 1 / (1 + F.exp(-(F.col("slope") * logit(F.col(prob)) + F.col("intercept"))))).otherwise(F.col(prob))


def consistency_penalty() -> Column:
    """Mean squared gap between a view's logit and the teacher's, or the clean one where there is no teacher."""
    return F.avg(F.pow(F.coalesce("teacher", "clean") - F.col("digitised"), 2))


def masked_loss() -> Column:
    """Mean weighted log-loss of logits ``z`` with weight ``w`` of positives; null labels are left out."""
    tail = F.log1p(F.exp(-F.abs("z")))
    return F.avg(F.when(F.col("y") == 1, F.col("w") * (tail + F.greatest(-F.col("z"), F.lit(0.0)))).when(F.col("y") == 0, tail + F.greatest("z", F.lit(0.0))))
