"""Shapes of beats: what a QRS complex looks like in a lead, in a record, and to wide-complex criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .beats import around

#: Shares of the largest deflection that begin and end a complex, that count as a deflection, and at which the initial one ends.
ACTIVE, DEFLECTION, FOOT, NOTCH = 0.12, 0.18, 0.08, 0.08
#: Fixed values, in seconds: window before and after the beat, baseline window, least window, slope window, notch window, gap before a second r.
BEFORE, AFTER, BASE_FROM, BASE_TO, LEAST, SLOPE, SPAN, GAP = 0.06, 0.23, 0.22, 0.08, 0.08, 0.04, 0.08, 0.012

#: What complexes, their beginnings and their polarity are called.
NAMES = {"pattern": ("r", "qs", "qr", "qrs", "rs", "rsr"), "initial": ("r", "q"), "polarity": ("positive", "negative")}


def _notched(down: Column) -> Column:
    """Whether a downstroke, turned upward, goes down and then up again by more than NOTCH of its height."""
    turns = lambda d, height: F.exists(F.zip_with(A.some(d, 0, F.size(d) - 1), A.some(d, 1, F.size(d) - 1), lambda x, y: (x < -NOTCH * height) & (y > NOTCH * height)), lambda x: x)
    told = lambda down, d, height: (F.size(d) >= 3) & (height > 1e-9) & turns(d, height)
    return F.coalesce(A.let(down, lambda down: A.let(F.array_max(down) - F.array_min(down), lambda height: A.let(A.differences(down), lambda d: told(down, d, height)))), F.lit(False))


def pattern(signs: Column, second_r: Column) -> Column:
    """The complex's name by the signs of its runs, in order (1: up, -1: down): r, qs, qr, qrs, rs or, with a late second r, rsr."""
    n = F.size(signs)
    up = F.get(signs, 0) > 0
    return F.when(n == 0, None).when(up & (n == 1), "r").when(up, F.when(second_r, "rsr").otherwise("rs")).when(n == 1, "qs").when(n == 2, "qr").otherwise("qrs")


def morphology(beats: DataFrame, df: DataFrame, by: list[str], fs: float) -> DataFrame:
    """The shape of each beat (…, r_i, beat_no) in samples (…, i from 0 on, mv).

    A beat's window is one array: smoothed by five, against the median before the beat, and cut to what reaches ACTIVE of
    its largest deflection. Samples beyond DEFLECTION become runs of one sign, and these tell the pattern. Columns: qrs_ms,
    pattern, initial (r or q), initial_ms, polarity, has_rs, rs_ms, nadir_ms, r_s, vi_vt, taller (the first r is taller
    than the last), notched (an initial downstroke), s_notched. Beats with too small a window or without any deflection
    are left out.
    """
    keys = [*by, "r_i", "beat_no"]
    n = lambda seconds: int(seconds * fs)
    ms = lambda samples: samples / fs * 1000
    gap, slope, span = max(2, n(GAP)), max(n(SLOPE), 1), max(n(SPAN), 3)
    near = around(beats.select(*keys), df, by, n(BASE_FROM), n(AFTER) - 1)
    held = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "mv"))).alias("all"))
    r, first = F.col("r_i"), F.greatest(F.col("r_i") - n(BASE_FROM), F.lit(0))
    of = lambda holds: F.transform(F.filter("all", lambda x: holds(x["i"])), lambda x: x["mv"])
    d = A.worked_out(held, {"seg": of(lambda i: i >= r - n(BEFORE)), "base": A.median(of(lambda i: (i >= first) & (i < F.greatest(first + 1, r - n(BASE_TO)))))})
    d = A.worked_out(d.where(F.size("seg") >= n(LEAST)), {"seg": F.transform(A.smoothed(F.col("seg"), 5), lambda x: F.round(x - F.col("base"), 9))})
    d = A.worked_out(d, {"peak": F.array_max(F.transform("seg", F.abs))}).where("peak > 1e-6")
    active = lambda x: F.abs(x) >= ACTIVE * F.col("peak")
    d = A.worked_out(d, {"on": A.first_place(F.col("seg"), active), "off": A.last_place(F.col("seg"), active)}).where("off > on")
    d = A.worked_out(d, {"q": A.some(F.col("seg"), F.col("on"), F.col("off") - F.col("on") + 1)})
    d = A.worked_out(d, {"cut": DEFLECTION * F.array_max(F.transform("q", F.abs))})
    q, cut, size = F.col("q"), F.col("cut"), F.size("q")
    signs = F.transform(q, lambda x: F.when(x > cut, 1).when(x < -cut, -1).otherwise(0))
    # runs of either sign; what is between two of the same sign does not part them
    d = A.worked_out(d, {"runs": F.filter(A.runs(signs), lambda x: x["value"] != 0)})
    place = lambda sign: F.get(F.filter("runs", lambda x: x["value"] == sign), 0)["from"]
    merged = F.filter(F.transform("runs", lambda x, k: F.struct(x["value"].alias("value"), F.coalesce(F.get(F.col("runs"), k - 1)["value"] == x["value"], F.lit(False)).alias("same"))), lambda x: ~x["same"])
    d = A.worked_out(d, {"up": place(1), "down": place(-1), "signs": F.transform(merged, lambda x: x["value"])})
    up, down = F.col("up"), F.col("down")
    both = up.isNotNull() & down.isNotNull()
    d = A.worked_out(d, {"nadir": A.place_of_min(q), "s_at": up + A.place_of_min(A.some(q, up, size))})
    s_at, nadir = F.col("s_at"), F.col("nadir")
    late = F.filter(F.transform(q, lambda x, k: F.when((k > s_at + gap) & (x > cut), x)), lambda x: x.isNotNull())
    d = A.worked_out(d, {"late": F.coalesce(late, F.array().cast("array<double>")), "sign": F.get("signs", 0), "has_rs": both & F.exists("runs", lambda x: (x["value"] < 0) & (x["to"] > up)) & (F.get(q, s_at.cast("int")) < -cut)})
    lasting = F.transform(q, lambda x: x * F.col("sign"))
    at_first = F.least(F.coalesce(up, down), F.coalesce(down, up))
    end = at_first + 1 + A.let(lasting, lambda v: A.let(FOOT * F.array_max(v), lambda foot: A.first_place(A.some(v, at_first + 1, size), lambda x: x <= foot)))
    high, low = F.array_max(q), F.array_min(q)
    flip = lambda a: F.transform(a, lambda x: -x)
    vi, vt = F.abs(F.get(q, F.lit(slope)) - F.get(q, F.lit(0))), F.abs(F.get(q, size - 1) - F.get(q, size - slope - 1))
    start = F.greatest(nadir - span, F.lit(0))
    return d.select(
        *keys, ms(size - 1).alias("qrs_ms"), pattern(F.col("signs"), F.size("late") > 0).alias("pattern"), F.when(F.col("sign") > 0, "r").when(F.col("sign") < 0, "q").alias("initial"),
        F.when(F.col("sign").isNotNull(), ms(F.coalesce(end, size))).alias("initial_ms"), F.when(F.abs(high) >= F.abs(low), "positive").otherwise("negative").alias("polarity"),
        F.coalesce("has_rs", F.lit(False)).alias("has_rs"), F.when(F.col("has_rs"), ms(s_at - up)).alias("rs_ms"), F.when(down.isNotNull(), ms(nadir)).alias("nadir_ms"),
        F.when(both & (F.abs(low) > 1e-9), high / F.abs(low)).alias("r_s"), F.when((size > 2 * slope) & (vt > 1e-9), vi / vt).alias("vi_vt"),
        F.when(both & (F.size("late") > 0), F.array_max(A.some(q, up, s_at - up + 1)) > F.array_max("late")).alias("taller"),
        (F.coalesce(F.col("sign") < 0, F.lit(False)) & _notched(A.smoothed(flip(A.some(q, 0, F.lit(span))), 3))).alias("notched"),
        (down.isNotNull() & _notched(A.smoothed(flip(A.some(q, start, nadir - start + 1)), 3))).alias("s_notched"),
    )


def lead_morphology(shapes: DataFrame, by: list[str]) -> DataFrame:
    """Of each series' beats the medians of measures, modes of names (of equal counts the first seen) and majorities (half of the beats, rounded down, but one)."""
    def mode(c: str, values: tuple) -> Column:
        seen = [F.struct(F.count_if(F.col(c) == v).alias("k"), (-F.min(F.when(F.col(c) == v, F.col("beat_no")))).alias("seen"), F.lit(v).alias("v")) for v in values]
        return F.when(F.count(c) > 0, F.greatest(*seen)["v"]).alias(c)

    most = lambda c, n: F.count_if(c) >= F.greatest(F.lit(1), F.floor(n / 2))
    medians = [F.percentile(c, 0.5).alias(c) for c in ("qrs_ms", "rs_ms", "initial_ms", "nadir_ms", "r_s", "vi_vt")]
    return shapes.groupBy(*by).agg(
        F.count("*").alias("beats"), *medians, *[most(F.col(c), F.count("*")).alias(c) for c in ("has_rs", "notched", "s_notched")],
        F.when(F.count("taller") > 0, most(F.col("taller"), F.count("taller"))).alias("taller"), *[mode(c, v) for c, v in NAMES.items()],
    )


def anchor_beats(beats: DataFrame, df: DataFrame, record: str, lead: str, preferred: list, least_sd: float = 0.05, least: int = 3) -> DataFrame:
    """(record, anchor, r_i, beat_no): of each record the beats of the first lead in order that is not flat and has at least three; leads not told come last, by name."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col(lead)), F.lit(0))
    there = beats.groupBy(record, lead).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    there = there.join(df.groupBy(record, lead).agg(F.stddev_pop("mv").alias("sd")).where(F.col("sd") >= least_sd), [record, lead])
    place = Window.partitionBy(record).orderBy(F.when(order == 0, len(preferred) + 1).otherwise(order), lead)
    first = there.withColumn("place", F.row_number().over(place)).where("place = 1").select(record, lead)
    return beats.join(first, [record, lead]).select(record, F.col(lead).alias("anchor"), "r_i", "beat_no")


def record_features(anchored: DataFrame, df: DataFrame, record: str, lead: str, chest: list, v1: str, v6: str, avr: str, fs: float) -> DataFrame:
    """What the wide-complex criteria read of each record: anchor_lead, n_beats, leads (with a shape), rs_absent, max_rs_ms, and v1, v6 and avr as structs (null: no beat).

    Shapes in all those leads are taken at the anchor lead's beats. A record without an anchor has no row.
    """
    names = sorted({*chest, v1, v6, avr})
    at = anchored.withColumn(lead, F.explode(F.array(*map(F.lit, names))))
    leads = lead_morphology(morphology(at, df.where(F.col(lead).isin(names)), [record, lead], fs), [record, lead])
    shape = F.struct("beats", "pattern", "polarity", "r_s", "initial", "initial_ms", "nadir_ms", "s_notched", F.col("taller").alias("left_ear"), "notched", "vi_vt")
    is_chest = F.col(lead).isin(chest)
    of = lambda name: F.max_by(F.when(F.col(lead) == name, shape), F.when(F.col(lead) == name, 1)).alias
    wide = leads.groupBy(record).agg(F.count_if(is_chest).alias("leads"), F.every(F.when(is_chest, ~F.col("has_rs"))).alias("rs_absent"), F.max(F.when(is_chest, F.col("rs_ms"))).alias("max_rs_ms"), of(v1)("v1"), of(v6)("v6"), of(avr)("avr"))
    return anchored.groupBy(record).agg(F.first("anchor").alias("anchor_lead"), F.count("*").alias("n_beats")).join(wide, record, "left")
