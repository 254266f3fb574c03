"""Scans of text files that keep what can't be read: good rows, and rejects with file, text and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import sweep_key

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
KEY = r"""(?:'[^'\\]*'|"[^"\\]*")"""
ENTRY = rf"{KEY}\s*:\s*{NUMBER}\s*"
LITERAL = rf"^\s*\{{\s*(?:{ENTRY}(?:,\s*{ENTRY})*,?\s*)?\}}\s*$"
CELL = r"(\w+)_f(\d+)_s(\d+)\.json(?:/[^/]*)?$"


def number_map(text: Column) -> Column:
    """A map from a dictionary literal of numbers, of a key's last number; null for anything else, escapes in keys included."""
    each = lambda group: F.regexp_extract_all(text, F.lit(f"({KEY})\\s*:\\s*({NUMBER})"), F.lit(group))
    keys, numbers = F.transform(each(1), lambda k: k.substr(F.lit(2), F.length(k) - 2)), each(2)
    own = F.array_distinct(keys)
    last = F.transform(own, lambda k: F.element_at(numbers, (F.size(keys) - F.array_position(F.reverse(keys), k) + 1).cast("int")).cast("double"))
    return F.when(text.rlike(LITERAL), F.map_from_arrays(own, last))


def parted(rows: DataFrame, reasons: list[tuple[str, Column]], told: list[Column], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that break nothing, and (…told, reason) of the others; the first reason that holds is told, null conditions don't hold."""
    reason = F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), name) for name, holds in reasons])
    rows = rows.withColumn("__reason", reason)
    return rows.where("__reason is null").select(*keep), rows.where("__reason is not null").select(*told, F.col("__reason").alias("reason"))


def metadata_csv(spark: SparkSession, path: str, schema: str, key: str, literal: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects (file, line, reason) of CSV files whose ``literal`` column holds dictionary literals.

    Reasons: ``line`` (a line with another number of fields), ``value`` (one that isn't of its column's type), ``key`` (no
    key) and ``literal`` (not a map of numbers and nothing else). An empty literal is a null map. Every column is read as
    text and cast here, so that a line is good or not by itself, whatever is selected. The line of a reject is its fields,
    joined by commas.
    """
    options = {"header": header, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__line", "columnPruning": False, "escape": '"'}
    fields = T.StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    rows = spark.read.options(**options).schema(", ".join(f"`{c}` string" for c in names) + ", __line string").csv(path)
    made = {f.name: F.col(f.name) if f.name == literal else F.col(f.name).try_cast(f.dataType) for f in fields}
    other = F.lit(False)
    for c in names:
        other = other | (F.col(c).isNotNull() & made[c].isNull())
    line = F.coalesce("__line", F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in names]))
    read = rows.withColumns({"__text": line, "__other": other, "__map": number_map(F.col(literal)), "__file": F.col("_metadata.file_name")})
    reasons = [("line", F.col("__line").isNotNull()), ("value", F.col("__other")), ("key", F.col(key).isNull()), ("literal", F.col(literal).isNotNull() & F.col("__map").isNull())]
    good, rejects = parted(read, reasons, [F.col("__file").alias("file"), F.col("__text").alias("line")], [*names, "__map"])
    return good.select(*[F.col("__map").alias(c) if c == literal else made[c].alias(c) for c in names]), rejects


def sweep_files(spark: SparkSession, path: str, schema: str, pattern: str = CELL) -> tuple[DataFrame, DataFrame]:
    """Cells (arm, fold, seed, …schema) and rejects (file, reason) of a sweep with a JSON file, or a folder of one, for each cell.

    Reasons: ``name`` (the path names no cell), ``json`` (no JSON, or a value of another type) and ``field`` (a declared
    field is missing). A file is one record, as the original writes it.
    """
    files = spark.read.options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__text", recursiveFileLookup=True)
    rows = files.schema(f"{schema}, __text string").json(path)
    names = [c for c in rows.columns if c != "__text"]
    at = F.col("_metadata.file_path")
    read = rows.select(*names, "__text", at.alias("__path"), *sweep_key(at, pattern))
    missing = F.lit(False)
    for c in names:
        missing = missing | F.col(c).isNull()
    return parted(read, [("name", F.col("arm") == ""), ("json", F.col("__text").isNotNull()), ("field", missing)], [F.col("__path").alias("file")], ["arm", "fold", "seed", *names])
