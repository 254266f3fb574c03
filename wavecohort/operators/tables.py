"""Scans, sinks, key derivations and small table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class SchemaError(ValueError):
    """A table whose columns are not the declared ones."""


def dict_literal(c: Column) -> Column:
    """A map of numbers from a dictionary literal with single or double quotes."""
    return F.from_json(F.translate(c, "'", '"'), "map<string,double>")


def label_vectors(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """Label vectors from JSON arrays; a repeated key or another length is an error."""
    from .cohort import guarded, unique

    out = df.withColumn("labels", F.from_json(column, "array<int>"))
    bad = out.where(F.col("labels").isNull() | (F.size("labels") != n)).select(key)
    return guarded(unique(out, [key]), bad, "label vector")


def strict_columns(df: DataFrame, declared: list[str]) -> DataFrame:
    """``df``, if its columns are exactly the declared ones, whatever their order."""
    missing, extra = sorted(set(declared) - set(df.columns)), sorted(set(df.columns) - set(declared))
    if missing or extra:
        raise SchemaError(f"missing {missing}, unexpected {extra}")
    return df.select(*declared)


def int16_frames(df: DataFrame, content: str, leads: int, samples: int, scale: float = 0.001) -> DataFrame:
    """(…, lead_idx, i, mv) of interleaved little-endian int16 frames; a frame of another size is left out with mv null."""
    size = 2 * leads * samples
    sound = df.where(F.octet_length(content) == size)
    byte = lambda at: F.conv(F.hex(F.substring(F.col(content), at, 1)), 16, 10).cast("int")
    rows = sound.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(leads * samples - 1))))
    low, high = byte(F.col("k") * 2 + 1), byte(F.col("k") * 2 + 2)
    value = low + high * 256
    return rows.withColumns({"lead_idx": F.col("k") % leads, "i": F.floor(F.col("k") / leads), "mv": F.when(value >= 32768, value - 65536).otherwise(value) * scale}).drop("k", content)


def oriented(df: DataFrame, column: str, leads: int) -> DataFrame:
    """(…, lead_idx, i, mv) of matrices stored leads by samples or samples by leads, told apart by their outer size."""
    rows = df.withColumn("__by_lead", F.size(column) == leads).select("*", F.posexplode(column).alias("__a", "__row")).select("*", F.posexplode("__row").alias("__b", "mv"))
    lead = F.when(F.col("__by_lead"), F.col("__a")).otherwise(F.col("__b"))
    at = F.when(F.col("__by_lead"), F.col("__b")).otherwise(F.col("__a"))
    return rows.select(*[c for c in df.columns if c != column], lead.alias("lead_idx"), at.alias("i"), "mv")


def fingerprints(df: DataFrame, content: str) -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def expect_hash(df: DataFrame, digest: str, expected: str) -> DataFrame:
    """Fails the job on a digest that differs from the expected one, in any case of letters."""
    differs = F.lower(F.col(digest)) != F.lower(F.col(expected))
    return df.where(F.when(differs, F.raise_error(F.concat(F.lit("digest differs: "), F.col(digest))).cast("boolean")).otherwise(True))


def natural_order(stem: str) -> list[Column]:
    """Numeric stems first, by number, then names."""
    number = F.expr(f"try_cast(`{stem}` as bigint)")
    return [number.isNull().asc(), number.asc(), F.col(stem).asc()]


def list_files(spark: SparkSession, path: str, pattern: str, most: int | None = None) -> DataFrame:
    """path and stem of the files that match, in natural order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    files = files.withColumn("stem", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).orderBy(*natural_order("stem"))
    return files.limit(most) if most is not None else files


def sweep_key(file: Column, pattern: str = r"(\w+)_f(\d+)_s(\d+)\.json$") -> list[Column]:
    """arm, fold and seed of a cell's file name."""
    return [F.regexp_extract(file, pattern, 1).alias("arm"), F.regexp_extract(file, pattern, 2).cast("int").alias("fold"), F.regexp_extract(file, pattern, 3).cast("int").alias("seed")]


def sweep_cells(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON file, with arm, fold and seed from its name."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select("*", *sweep_key(F.col("_metadata.file_name")))


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """The nested rows as JSON and a flat CSV, with arrays and structs as JSON cells; existing reports are kept unless told."""
    mode = "overwrite" if overwrite else "errorifexists"
    flat = [F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.write.mode(mode).json(f"{path}/json")
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(f"{path}/csv")


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def with_validity(df: DataFrame, sound: Column) -> DataFrame:
    """Adds ``valid`` in place of failing on a broken row."""
    return df.withColumn("valid", F.coalesce(sound, F.lit(False)))


def submission(df: DataFrame, threshold: float) -> DataFrame:
    """Adds decision: rows that are not valid are negative."""
    return df.withColumn("decision", F.when(F.col("valid") & (F.col("prob") >= threshold), 1).otherwise(0))


def cached(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` once: where a table is there already, it is read and ``df`` is not evaluated."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_submission(df: DataFrame, path: str, by: list[str]) -> None:
    """Decisions as CSV in ``path``/rows, and for each group n, positives and positive_rate as JSON in ``path``/metadata."""
    df.write.option("header", True).csv(f"{path}/rows")
    df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("decision").cast("long").alias("positives"), F.avg("decision").alias("positive_rate")).write.json(f"{path}/metadata")


def signal_state(df: DataFrame, values: str, length: int, peak: float, least: int) -> DataFrame:
    """Adds active (at least ``least`` samples beyond ``peak``) and sound (the full length, and no NaN) of saved signals."""
    active = F.size(F.filter(values, lambda x: F.abs(x.cast("double")) > F.lit(peak))) >= least
    return df.withColumns({"active": active, "sound": (F.size(values) == length) & F.forall(values, lambda x: ~F.isnan(x))})


def flat(df: DataFrame, paths: list[str]) -> DataFrame:
    """Fields of nested records as columns, each by its last name; what a missing struct would hold is null."""
    return df.select(*[F.col(p).alias(p.rpartition(".")[2]) for p in paths])


def code_labels(df: DataFrame, key: str, mapping: dict[str, int]) -> DataFrame:
    """(key, class_idx, y): codes mapped many to one; the presence of a code is what counts, unmapped codes are dropped."""
    names = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    held = F.transform("codes", lambda c: names[c])
    classes = F.array(*[F.lit(v) for v in sorted(set(mapping.values()))])
    return df.withColumn("__c", held).select(key, "__c", F.explode(classes).alias("class_idx")).select(key, "class_idx", F.array_contains(F.filter("__c", lambda x: x.isNotNull()), F.col("class_idx")).cast("int").alias("y"))


def leading_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def reference_key(category: Column, identifier: Column, prefix: str, stripped: str) -> Column:
    """The identifier with ``prefix`` before it in categories that begin with it, less that category's own prefix."""
    return F.when(category.startswith(prefix), F.concat(F.lit(stripped), F.regexp_replace(identifier, f"^{prefix}", ""))).otherwise(identifier)


def case_and_variant(stem: str) -> dict[str, Column]:
    """Both sides of the first double underscore; without one the variant is ``original``."""
    at = F.instr(stem, "__")
    return {"case_id": F.substring_index(stem, "__", 1), "variant": F.when(at > 0, F.expr(f"substring(`{stem}`, instr(`{stem}`, '__') + 2)")).otherwise("original")}


def layout_without_rhythm(layout: Column, mode: Column, of_mode: str) -> Column:
    return F.when(mode == of_mode, F.regexp_replace(layout, r"\+1R$", "")).otherwise(layout)


def known_hint(layout: Column) -> Column:
    return F.when(~F.lower(layout).isin("unknown", "auto", ""), layout)


def is_reusable(version: Column, mode: Column, digest: Column, hint: Column) -> Column:
    """A saved record that was made the same way: other sides are columns of the record."""
    return (F.col("status") == "success") & F.col("version").eqNullSafe(version) & F.col("mode").eqNullSafe(mode) & F.col("digest").eqNullSafe(digest) & F.col("hint").eqNullSafe(hint)


def match_layout(text: Column, chosen: Column) -> Column:
    """The layout named in a text; an explicit choice beats it."""
    found = F.when(F.contains(text, F.lit("3x4")), "3x4").when(F.contains(text, F.lit("6x2")), "6x2").when(F.contains(text, F.lit("12x1")), "12x1")
    return F.coalesce(chosen, found)


def cases_and_controls(df: DataFrame, cases: DataFrame, key: str, controls: DataFrame, best_by: str, k: int) -> DataFrame:
    """The given cases and the ``k`` best controls: key, role."""
    picked = df.join(cases, key, "left_semi").select(key, F.lit("failure").alias("role"))
    return picked.unionByName(controls.orderBy(F.desc(best_by), key).limit(k).select(key, F.lit("control").alias("role")))


def error_statistics(error: Column) -> list[Column]:
    """n, median, mean and the shares over 20 and within 5, rounded half to even."""
    return [F.count("*").alias("n"), F.bround(F.percentile(error, 0.5), 2).alias("median_error"), F.bround(F.avg(error), 2).alias("mean_error"), F.bround(F.avg((error > 20).cast("double")), 4).alias("over_20"), F.bround(F.avg((error <= 5).cast("double")), 4).alias("within_5")]


def early_stop(history: DataFrame, run: str, patience: int) -> DataFrame:
    """The best epoch of each run before ``patience`` epochs without a better or equal score have passed."""
    w = Window.partitionBy(run).orderBy("epoch")
    h = history.withColumns({"step": F.row_number().over(w), "best": F.max("score").over(w)})
    h = h.withColumn("at", F.max(F.when(F.col("score") == F.col("best"), F.col("step"))).over(w))
    h = h.withColumn("stop", F.min(F.when(F.col("step") - F.col("at") >= patience, F.col("step"))).over(Window.partitionBy(run)))
    kept = h.where(F.col("stop").isNull() | (F.col("step") <= F.col("stop")))
    return kept.groupBy(run).agg(F.max_by("epoch", F.struct(F.col("score"), (-F.col("epoch")).alias("e"))).alias("best_epoch"), F.max("score").alias("best_score"), F.count("*").alias("n_epochs"))
