"""Columns over the samples of a short window, held as an array in one row: means, peaks, runs and slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used, also inside functions of elements."""
    return F.get(F.transform(F.array(value), body), 0)


def worked_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds or replaces columns that are worked out once a row.

    A projected column would be put in place of its name wherever it is used, in functions of elements as well, and be
    worked out for each element; what an ``explode`` of one row gives is not.
    """
    held = df.withColumn("__held", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return held.select(*[c for c in df.columns if c not in columns], *[F.col("__held")[n].alias(n) for n in columns])


def some(a: Column, start: Column | int, count: Column) -> Column:
    """``count`` elements from place ``start`` (from 0) on; none, if count is not above 0."""
    return F.slice(a, F.greatest(F.lit(0), start if isinstance(start, Column) else F.lit(start)) + 1, F.greatest(F.lit(0), count))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def median(a: Column) -> Column:
    """The middle value, or the mean of the two; null for no values."""
    return let(F.sort_array(a), lambda s: F.when(F.size(s) > 0, (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2))


def smoothed(a: Column, width: int) -> Column:
    """Means of ``width`` elements around each, with zeros beyond the ends; as it is, if shorter than that."""
    half = width // 2
    mean = lambda a: F.transform(a, lambda x, k: F.round(total(some(a, k - half, F.least(k + half, F.size(a) - 1) - F.greatest(k - half, F.lit(0)) + 1)) / width, 9))
    return let(a, lambda a: F.when(F.size(a) < width, a).otherwise(mean(a)))


def differences(a: Column) -> Column:
    return let(a, lambda a: F.zip_with(some(a, 1, F.size(a) - 1), some(a, 0, F.size(a) - 1), lambda x, y: x - y))


def gradient(a: Column) -> Column:
    """Slopes: half the distance of both neighbours, at the ends the distance to the one there is."""
    slope = lambda a, x, k: F.when(k == 0, F.get(a, F.lit(1)) - x).when(k == F.size(a) - 1, x - F.get(a, k - 1)).otherwise((F.get(a, k + 1) - F.get(a, k - 1)) / 2)
    return let(a, lambda a: F.transform(a, lambda x, k: slope(a, x, k)))


def first_place(a: Column, holds) -> Column:
    """Place, from 0, of the first element for which ``holds``; null if there is none."""
    return let(F.array_position(F.transform(a, holds), True), lambda at: F.when(at > 0, at - 1))


def last_place(a: Column, holds) -> Column:
    return let(F.array_position(F.reverse(F.transform(a, holds)), True), lambda at: F.when(at > 0, F.size(a) - at))


def place_of_min(a: Column) -> Column:
    """Place of the first least element; null for no elements."""
    return let(a, lambda a: let(F.array_position(a, F.array_min(a)), lambda at: F.when(at > 0, at - 1)))


def runs(a: Column) -> Column:
    """Maximal runs of equal elements, in order: structs of value, from and to (places from 0)."""
    starts = lambda a: F.filter(F.transform(a, lambda x, k: F.when((k == 0) | (x != F.get(a, k - 1)), k)), lambda k: k.isNotNull())
    run = lambda a, s, k, j: F.struct(F.get(a, k).cast("double").alias("value"), k.alias("from"), (F.coalesce(F.get(s, j + 1), F.size(a)) - 1).alias("to"))
    return let(a, lambda a: let(starts(a), lambda s: F.transform(s, lambda k, j: run(a, s, k, j))))


def peaks(a: Column) -> Column:
    """Local maxima, in order: structs of value and at. A plateau is one, at its middle (rounded down); the ends are none."""
    high = lambda r, x, k: F.when((F.get(r, k - 1)["value"] < x["value"]) & (F.get(r, k + 1)["value"] < x["value"]), F.struct(x["value"].alias("value"), F.floor((x["from"] + x["to"]) / 2).cast("int").alias("at")))
    return let(runs(a), lambda r: F.filter(F.transform(r, lambda x, k: high(r, x, k)), lambda x: x.isNotNull()))


def prominent(a: Column, least: float) -> Column:
    """``peaks`` whose prominence is at least that: what must be given up to reach a higher element, or the array's end, on either side."""
    def low(side: Column, high: Column) -> Column:  # elements away from the peak: the least one before a higher one
        return let(side, lambda side: F.array_min(some(side, 0, F.coalesce(first_place(side, lambda x: x > high), F.size(side)))))

    def prominence(a: Column, p: Column) -> Column:
        return p["value"] - F.greatest(low(F.reverse(some(a, 0, p["at"])), p["value"]), low(some(a, p["at"] + 1, F.size(a)), p["value"]))

    return let(a, lambda a: F.filter(peaks(a), lambda p: prominence(a, p) >= least))


def apart(tops: Column, distance: int) -> Column:
    """Of structs (value, at) those that stay when the highest is taken first and all nearer than ``distance`` to it go, and so on; of equals the later one is taken first. In order of place."""
    order = F.reverse(F.array_sort(tops))
    kept = F.aggregate(order, F.slice(tops, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["at"] - x["at"]) < distance), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(kept, lambda x, y: (x["at"] - y["at"]).cast("int"))
