"""Rules over whole manifests: of columns, rows, files, cases and the set; every violation is told in one run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cohort import SHA_PATTERN, safe_path, strict_true

# The columns a matched-photo manifest must have, and those that would tell a patient.
REQUIRED = ["case_id", "photo_id", "variant", "layout", "device_model", "printer_model", "photo_path", "photo_sha256", "reference_type", "reference_path", "reference_sha256", "split", "phi_reviewed"]
FORBIDDEN = ["patient_name", "patient_id", "date_of_birth", "institution_id", "barcode"]


@dataclass(frozen=True)
class SetRules:
    """What a manifest must keep to; the defaults are fixed values of the locked contract."""

    variants: tuple[str, ...] = ("front", "angle", "lowlight", "difficult")
    reference_types: tuple[str, ...] = ("digital_waveform", "exported_image", "flatbed_scan")
    splits: tuple[str, ...] = ("tune", "test")
    required_splits: tuple[str, ...] = ("tune", "test")
    case_pattern: str = "^case[0-9]{3,}$"
    least_cases: int = 20
    least_sources: int = 2
    required: tuple[str, ...] = field(default=tuple(REQUIRED))
    forbidden: tuple[str, ...] = field(default=tuple(FORBIDDEN))


def row_checks(rules: SetRules) -> list[tuple[str, str, Column]]:
    """(column, rule, whether it is kept) of a single row."""
    among = lambda c, allowed: F.col(c).isin(*allowed)
    named = lambda c: F.length(F.trim(c)) > 0
    return [
        ("case_id", "pattern", F.col("case_id").rlike(rules.case_pattern)), ("phi_reviewed", "flag", strict_true(F.col("phi_reviewed").cast("string"))),
        ("variant", "choice", among("variant", rules.variants)), ("reference_type", "choice", among("reference_type", rules.reference_types)), ("split", "choice", among("split", rules.splits)),
        *[(c, "empty", named(c)) for c in ("layout", "device_model", "printer_model")],
        *[(f"{k}_path", "path", safe_path(F.col(f"{k}_path"))) for k in ("photo", "reference")], *[(f"{k}_sha256", "digest", F.col(f"{k}_sha256").rlike(SHA_PATTERN)) for k in ("photo", "reference")],
    ]


def _told(df: DataFrame, subject: Column, name: str, rule: str) -> DataFrame:
    return df.select(subject.cast("string").alias("subject"), F.lit(name).alias("field"), F.lit(rule).alias("rule"))


def file_violations(df: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """``absent`` for safe paths without a file, ``differs`` for a sound digest that isn't the file's. files: (path, found)."""
    rows = df.where(safe_path(F.col(f"{kind}_path"))).select("case_id", F.col(f"{kind}_path").alias("path"), F.col(f"{kind}_sha256").alias("told"))
    seen = files.groupBy("path").agg(F.max("found").alias("found"))
    rule = F.when(F.col("found").isNull(), "absent").when(F.col("told").rlike(SHA_PATTERN) & (F.col("told") != F.col("found")), "differs")
    rows = rows.join(seen, "path", "left").withColumn("rule", rule).where("rule is not null")
    return rows.select(F.col("case_id").cast("string").alias("subject"), F.when(F.col("rule") == "absent", f"{kind}_path").otherwise(f"{kind}_sha256").alias("field"), "rule")


def set_violations(df: DataFrame, rules: SetRules) -> DataFrame:
    """What no row can tell: too few cases or capture sources, and required splits without a case of their own.

    A case counts for a split if all its rows are in it. Three sums over cases and one count of sources make a single row,
    so that an empty table breaks every rule of this kind.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cases = df.groupBy(text("case_id").alias("c")).agg(F.min(text("split")).alias("lo"), F.max(text("split")).alias("hi"))
    own = [F.count_if((F.col("lo") == s) & (F.col("hi") == s)).alias(f"__{k}") for k, s in enumerate(rules.required_splits)]
    counted = cases.agg(F.count("*").alias("cases"), *own)
    sources = df.select(text("device_model").alias("d"), text("printer_model").alias("p")).distinct().agg(F.count("*").alias("sources"))
    checks = [("", "case_id", "too_few", F.col("cases") < rules.least_cases), ("", "device_model", "too_few", F.col("sources") < rules.least_sources)]
    checks += [(s, "split", "empty_split", F.col(f"__{k}") == 0) for k, s in enumerate(rules.required_splits)]
    found = F.filter(F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(f).alias("field"), F.lit(r).alias("rule"), bad.alias("bad")) for s, f, r, bad in checks]), lambda x: x["bad"])
    return counted.crossJoin(F.broadcast(sources)).select(F.explode(found).alias("x")).select("x.subject", "x.field", "x.rule")  # one row each


def violations(df: DataFrame, rules: SetRules = SetRules(), files: DataFrame | None = None) -> DataFrame:
    """(subject, field, rule) of everything that is wrong with a manifest.

    The subject is a case, for rules of rows and cases; a photo that repeats; a split without cases; or empty. Rules:
    ``missing`` and ``forbidden`` (columns), ``pattern``, ``flag``, ``choice``, ``empty``, ``path``, ``digest`` (rows; null
    keeps to none), ``absent`` and ``differs`` (files, if a table (path, found) is given), ``leak`` (a case in two splits),
    ``references`` (a case with two reference digests), ``repeat`` (a photo), ``too_few`` and ``empty_split`` (the set).
    Where a required column is missing, nothing else is looked at, as no row could keep to the rules.
    """
    spark = df.sparkSession
    wrong = [("", c, "missing") for c in rules.required if c not in df.columns]
    whole = not wrong
    wrong += [("", c, "forbidden") for c in rules.forbidden if c in df.columns]
    columns = spark.createDataFrame(wrong, "subject string, field string, rule string")
    if not whole:
        return columns
    kept = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok")) for f, r, ok in row_checks(rules)])
    rows = df.select(F.col("case_id").cast("string").alias("subject"), F.explode(F.filter(kept, lambda x: ~x["ok"])).alias("x")).select("subject", "x.field", "x.rule")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    two = lambda c: F.min(text(c)) != F.max(text(c))
    cases = df.groupBy("case_id").agg(two("split").alias("leak"), two("reference_sha256").alias("references"))
    photos = df.groupBy("photo_id").agg(F.count("*").alias("n")).where("n > 1")
    out = columns.unionByName(rows).unionByName(_told(cases.where("leak"), F.col("case_id"), "split", "leak")).unionByName(_told(cases.where("references"), F.col("case_id"), "reference_sha256", "references"))
    out = out.unionByName(_told(photos, F.col("photo_id"), "photo_id", "repeat")).unionByName(set_violations(df, rules))
    if files is not None:
        out = out.unionByName(file_violations(df, files, "photo")).unionByName(file_violations(df, files, "reference"))
    return out


def summary(df: DataFrame) -> DataFrame:
    """(part, value, n) of a sound manifest: distinct cases, references and sources, photos, and counts by split, variant and type."""
    one = lambda part, n: df.agg(n.alias("n")).select(F.lit(part).alias("part"), F.lit("").alias("value"), "n")
    by = lambda part, column, n: df.groupBy(F.col(column).alias("value")).agg(n.alias("n")).select(F.lit(part).alias("part"), "value", "n")
    pieces = [one("cases", F.countDistinct("case_id")), one("photos", F.count("*")), one("references", F.countDistinct("reference_sha256")), one("sources", F.countDistinct("device_model", "printer_model"))]
    pieces += [by("split_cases", "split", F.countDistinct("case_id")), by("variant", "variant", F.count("*")), by("reference_type", "reference_type", F.count("*"))]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out
