"""A cache of preprocessed rows that is refreshed: only what changed is made again, and readers see whole versions.

A cache is a folder. ``part-n-…`` holds the values that the n-th refresh made, and ``version-n`` its manifest, a small row for
each key: how it was made (version, mode, digest, hint), its status and error, the refresh that made it and the part that has
its values. A version is written aside and published by one rename; published folders never change, so a reader of an older
version keeps it whole. The rename is atomic where the file system's is (HDFS, local disks).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cohort import unique
from .tables import is_reusable

MADE_BY = ["version", "mode", "digest", "hint"]
#: Rows in a task. Manifests take few bytes on disk and many in memory, so that sizes of files would have them broadcast.
ROWS = 500_000


class CacheConflict(RuntimeError):
    """Another refresh published the version first."""


def _paths(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop
    at = hadoop.fs.Path(path)
    return hadoop, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, in order; none where there is no cache."""
    _, at, files = _paths(spark, path)
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    return sorted(int(n[8:]) for n in names if n.startswith("version-") and n[8:].isdigit())


def _publish(spark: SparkSession, path: str, aside: str, version: int) -> None:
    hadoop, at, files = _paths(spark, path)
    options = spark._sc._gateway.new_array(getattr(hadoop.fs, "Options$Rename"), 0)
    target = hadoop.fs.Path(f"{path}/version-{version}")
    if files.exists(target):
        raise CacheConflict(f"version {version} of {path} is there already")
    hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(hadoop.fs.Path(aside), files.makeQualified(target), options)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(key, version, mode, digest, hint, status, error, refresh, part) of a version, the latest unless told."""
    last = version if version is not None else versions(spark, path)[-1]
    return spark.read.parquet(f"{path}/version-{last}")


def _spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` in ``n`` partitions by ``keys``, to be met by sorting: neither broadcast nor put together by bytes."""
    return df.repartition(n, *keys).hint("merge")


def pending(wanted: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Wanted rows that no successful record was made of in the same way."""
    held = made.where("status = 'success'").select(*[F.col(c).alias(f"__{c}") for c in (key, *MADE_BY)])
    met = wanted.join(held.hint("merge"), F.col(key) == F.col(f"__{key}"), "left")  # only the key is met: partitions by it are kept
    same = F.col(f"__{key}").isNotNull()
    for c in MADE_BY:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return met.where(~same).select(*wanted.columns)


def refresh(wanted: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Brings the cache at ``path`` up to ``wanted`` (key, version, mode, digest, hint, …) and gives the version published.

    ``make`` turns pending rows into (key, …values, error): a row with an error is a failure, kept with the reason and tried
    again at the next refresh; so is a row that ``make`` left out. Keys that are no longer wanted leave the new version. A
    repeated key is an error, rows without a key are left out. Nothing is published if the driver is lost: the next refresh
    starts anew in a part of its own. If two refreshes race, the second raises ``CacheConflict`` and its part is never read.
    """
    spark = wanted.sparkSession
    have = versions(spark, path)
    version = have[-1] + 1 if have else 1
    old = manifest(spark, path) if have else None
    wanted = wanted.where(F.col(key).isNotNull())
    n = 1 + max(wanted.count(), old.count() if have else 0) // ROWS
    wanted = unique(_spread(wanted, n, key), [key])
    if have:
        old = _spread(old.where("status = 'success'"), n, key)
    own = uuid.uuid4().hex
    part = f"part-{version}-{own}"
    make(pending(wanted, old, key) if have else wanted).write.parquet(f"{path}/{part}")
    made = _spread(spark.read.parquet(f"{path}/{part}").select(F.col(key).alias("__key"), F.col("error").alias("__error"), F.lit(True).alias("__made")), n, "__key")
    rows = wanted.select(key, *MADE_BY)
    if have:
        rows = rows.join(old.select(key, *[F.col(c).alias(f"__{c}") for c in MADE_BY], "status", F.col("refresh").alias("__refresh"), F.col("part").alias("__part")), key, "left")
        rows = rows.withColumn("__kept", F.coalesce(is_reusable(*[F.col(f"__{c}") for c in MADE_BY]), F.lit(False)))
    else:
        rows = rows.withColumns({"__kept": F.lit(False), "__refresh": F.lit(None).cast("int"), "__part": F.lit(None).cast("string")})
    rows = rows.join(made, (F.col(key) == F.col("__key")) & ~F.col("__kept"), "left")
    error = F.when(~F.col("__kept"), F.when(F.col("__made").isNull(), "left out").otherwise(F.col("__error")))
    rows = rows.select(key, *MADE_BY, F.col("__kept"), F.col("__refresh"), F.col("__part"), error.alias("error"))
    status = F.when(F.col("error").isNull(), "success").otherwise("failed")
    refresh = F.when(F.col("__kept"), F.col("__refresh")).otherwise(version)
    rows = rows.select(key, *MADE_BY, status.alias("status"), "error", refresh.alias("refresh"), F.when(F.col("__kept"), F.col("__part")).when(F.col("error").isNull(), part).alias("part"))
    aside = f"{path}/.making-{own}"
    rows.write.parquet(aside)
    _publish(spark, path, aside, version)
    return version


def values(spark: SparkSession, path: str, key: str, version: int | None = None) -> DataFrame:
    """(key, …values, refresh) of what succeeded, each from the part that made it; parts that hold nothing current aren't read."""
    rows = manifest(spark, path, version).where("status = 'success'")
    parts = sorted((r["refresh"], r["part"]) for r in rows.select("refresh", "part").distinct().collect())  # a row for each refresh
    rows = rows.select(key, "refresh")
    out = None
    for k, p in parts:
        held = spark.read.parquet(f"{path}/{p}").drop("error").withColumn("refresh", F.lit(k))
        out = held if out is None else out.unionByName(held, allowMissingColumns=True)
    if out is None:
        return rows
    n = 1 + max(rows.count(), out.count()) // ROWS
    return _spread(out, n, key, "refresh").join(_spread(rows, n, key, "refresh"), [key, "refresh"]).select(*out.columns)


def failures(spark: SparkSession, path: str, key: str, version: int | None = None) -> DataFrame:
    """(key, error) of rows that could not be made."""
    return manifest(spark, path, version).where("status = 'failed'").select(key, "error")
