"""Beats, intervals and rhythm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A

def corrected_qt(df: DataFrame, irregular_above: float = 0.15) -> DataFrame:
    """Adds bazett, fridericia, preferred and formula of qt_ms and rr_sec (rr_cv tells irregularity)."""
    qt = F.col("qt_ms") / 1000
    sound = F.col("qt_ms").isNotNull() & (F.col("rr_sec") > 0)
    rate = 60 / F.col("rr_sec")
    extreme = (F.col("rr_cv") > irregular_above) | (rate < 60) | (rate > 100)
    out = df.withColumns({"bazett": F.when(sound, qt / F.sqrt("rr_sec") * 1000), "fridericia": F.when(sound, qt / F.cbrt("rr_sec") * 1000), "formula": F.when(~F.coalesce(sound, F.lit(False)), "n/a").when(extreme, "fridericia").otherwise("bazett")})
    return out.withColumn("preferred", F.when(F.col("formula") == "fridericia", F.col("fridericia")).when(F.col("formula") == "bazett", F.col("bazett")))


#: Bounds of plausible intervals in ms, by name.
BOUNDS = {"pr_ms": (80.0, 400.0), "qrs_ms": (40.0, 220.0), "qt_ms": (200.0, 700.0)}


def detect(df: DataFrame, by: list[str], width: int, refractory: int, reach: int, factor: float = 0.5) -> DataFrame:
    """Beats (…, r_i, beat_no) of detrended samples (…, i, mv).

    Energy is the moving mean over ``width`` samples of the squared first difference. A run of equal energies that is higher
    than both neighbours, and not below mean + factor * sd, is a peak, at its middle. The highest peak stays and all nearer
    than ``refractory`` samples go, then the next highest that is left, and so on; of equal ones the later comes first.
    Peaks that near ones chain together are one row's array for this; no chain ends within a gap. A beat is then moved to
    the largest deviation from the series' mean within ``reach``.
    """
    w = Window.partitionBy(*by).orderBy("i")
    all_ = Window.partitionBy(*by)
    d = df.withColumn("d", F.coalesce(F.pow(F.col("mv") - F.lag("mv").over(w), 2), F.lit(0.0)))
    e = d.withColumn("e", F.round(F.avg("d").over(w.rowsBetween(-(width // 2), width // 2)), 6))
    e = e.withColumns({"cut": F.avg("e").over(all_) + factor * F.stddev_pop("e").over(all_), "before": F.lag("e").over(w)})
    run = e.where("before is null or before <> e").withColumns({"after": F.lead("e").over(w), "next": F.lead("i").over(w)})
    peak = run.where("e > before and e > after and e >= cut").select(*by, "e", F.floor((F.col("i") + F.col("next") - 1) / 2).alias("i"))
    cluster = peak.withColumn("new", F.when(F.col("i") - F.lag("i").over(w) < refractory, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(w))
    chain = cluster.groupBy(*by, "cluster").agg(F.collect_list(F.struct(F.col("e").alias("value"), F.col("i").alias("at"))).alias("tops"))
    top = chain.select(*by, F.explode(A.apart(F.col("tops"), refractory)["at"]).alias("p"))
    near = top.withColumn("i", F.explode(F.sequence(F.col("p") - reach, F.col("p") + reach)))
    level = df.withColumn("dev", F.abs(F.col("mv") - F.avg("mv").over(all_))).select(*by, "i", "dev")
    moved = near.join(level, [*by, "i"]).groupBy(*by, "p").agg(F.max_by("i", F.struct(F.round("dev", 12), (-F.col("i")).alias("o"))).alias("r_i")).select(*by, "r_i").distinct()
    return moved.withColumn("beat_no", F.row_number().over(Window.partitionBy(*by).orderBy("r_i")) - 1)


def rr(beats: DataFrame, by: list[str]) -> DataFrame:
    """Adds rr, the distance to the beat before."""
    return beats.withColumn("rr", F.col("r_i") - F.lag("r_i").over(Window.partitionBy(*by).orderBy("r_i")))


def rate(beats: DataFrame, by: list[str], fs: float, low: float = 25.0, high: float = 220.0) -> DataFrame:
    """bpm of the median plausible distance between beats; null without one."""
    each = rr(beats, by).withColumn("ok", F.when((F.col("rr") >= 60 * fs / high) & (F.col("rr") <= 60 * fs / low), F.col("rr")))
    return each.groupBy(*by).agg(F.count("*").alias("n_beats"), (60 * fs / F.percentile("ok", 0.5)).alias("bpm"))


def autocorrelation_rate(df: DataFrame, by: list[str], fs: float, lag_low: int, lag_high: int, least: float = 0.05, apart: int | None = None) -> DataFrame:
    """lag and bpm of the first prominent peak of the autocorrelation of the squared difference, its mean taken away, between two lags (the upper excluded).

    Samples (…, i, mv) have no gaps in i; lags that are not below the number of differences less one don't count, and
    fewer than ten lags give no row, nor does a series without such a peak. Prominence is told in shares of lag 0; peaks stand ``apart`` lags from higher ones (0.15 s, if not told). A series is
    cut into blocks of 4096 samples, each with the samples that its lags reach, and a block gives a vector with a sum for
    each lag: no sample is copied for each lag.
    """
    block = 4096
    w = Window.partitionBy(*by).orderBy("i")
    d = df.withColumn("d", F.pow(F.col("mv") - F.lag("mv").over(w), 2)).where("d is not null")
    z = d.select(*by, "i", (F.col("d") - F.avg("d").over(Window.partitionBy(*by))).alias("z"))
    z = z.withColumn("own", F.floor(F.col("i") / block))
    # a sample is in its own block and, near its start, in the one before
    z = z.withColumn("block", F.explode(F.when(F.col("i") % block < lag_high, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    held = z.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("s"))
    own = F.size(F.filter("s", lambda x: F.floor(x["i"] / block) == F.col("block")))
    held = held.select(*by, "block", F.transform("s", lambda x: x["z"]).alias("z"), own.alias("own")).where("own > 0")
    product = lambda lag: A.total(F.zip_with(A.some(F.col("z"), 0, F.least(F.col("own"), F.size("z") - lag)), A.some(F.col("z"), lag, F.least(F.col("own"), F.size("z") - lag)), lambda x, y: x * y))
    sums = held.select(*by, "own", F.posexplode(F.transform(F.concat(F.array(F.lit(0)), F.sequence(F.lit(lag_low), F.lit(lag_high - 1))), product)).alias("k", "r"))
    acf = sums.groupBy(*by, "k").agg(F.sum("r").alias("r"), F.sum("own").alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("r"), F.first("n").alias("n"))
    share = F.transform(F.filter("r", lambda x: (x["k"] > 0) & (x["k"] <= F.col("n") - 1 - lag_low)), lambda x: F.round(x["r"] / (F.get("r", 0)["r"] + 1e-10), 9))
    near = int(0.15 * fs) if apart is None else apart
    found = A.worked_out(acf, {"acf": share}).where(F.size("acf") >= 10)
    found = A.worked_out(found, {"tops": A.apart(A.peaks(F.col("acf")), near), "real": F.transform(A.prominent(F.col("acf"), least), lambda p: p["at"])})
    peak = F.get(F.filter("tops", lambda p: F.array_contains("real", p["at"])), 0)["at"] + lag_low
    return found.select(*by, peak.cast("long").alias("lag"), (60 * fs / peak).alias("bpm")).where("lag is not null")


def lead_rate(rates: DataFrame, record: str, lead: str, preferred: list) -> DataFrame:
    """(record, lead, bpm, basis) of each record: its first lead in order with a rate from beats or, if none has one, from the autocorrelation.

    rates: (record, lead, bpm, acf_bpm); leads not told come last, by name. A record without any rate has no row.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col(lead)), F.lit(0))
    place = Window.partitionBy(record).orderBy(F.col("bpm").isNull(), F.when(order == 0, len(preferred) + 1).otherwise(order), lead)
    first = rates.where("bpm is not null or acf_bpm is not null").withColumn("place", F.row_number().over(place)).where("place = 1")
    return first.select(record, lead, F.coalesce("bpm", "acf_bpm").alias("bpm"), F.when(F.col("bpm").isNotNull(), "beats").otherwise("autocorrelation").alias("basis"))


def measurement_lead(df: DataFrame, record: str, lead: str, preferred: list, least_sd: float = 0.1) -> DataFrame:
    """The first lead in order of preference that is not flat."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col(lead)), F.lit(0))
    sd = df.groupBy(record, lead).agg(F.stddev_pop("mv").alias("sd")).where(F.col("sd") >= least_sd)
    place = Window.partitionBy(record).orderBy(F.when(order == 0, len(preferred) + 1).otherwise(order), lead)
    return sd.withColumn("__p", F.row_number().over(place)).where("__p = 1").select(record, lead)


def around(beats: DataFrame, df: DataFrame, by: list[str], before: int, after: int) -> DataFrame:
    """Samples in the window around each beat: one equality join on the exploded window."""
    return beats.withColumn("i", F.explode(F.sequence(F.col("r_i") - before, F.col("r_i") + after))).join(df, [*by, "i"])


def qrs_bounds(beats: DataFrame, df: DataFrame, by: list[str], half: int, share: float = 0.15) -> DataFrame:
    """qrs_on and qrs_off: first and last sample near the beat whose gradient is above that share of the local maximum."""
    w = Window.partitionBy(*by).orderBy("i")
    g = df.withColumn("g", F.abs(F.coalesce(F.lead("mv").over(w), F.col("mv")) - F.coalesce(F.lag("mv").over(w), F.col("mv"))) / 2).withColumn("g", F.avg("g").over(w.rowsBetween(-2, 2))).select(*by, "i", "g")
    near = around(beats, g, by, half, half)
    top = near.withColumn("m", F.max("g").over(Window.partitionBy(*by, "r_i")))
    hit = F.when(F.col("g") > share * F.col("m"), F.col("i"))
    return top.groupBy(*by, "r_i", "beat_no").agg(F.min(hit).alias("qrs_on"), F.max(hit).alias("qrs_off"))


#: Fixed values, in seconds: how far back a P wave may lie, how near the QRS it must end, its longest rise, and the least, first and last place of a T wave.
P_BACK, P_END, P_LEAST, P_RISE, PR_SEGMENT, T_AFTER, T_SPAN = 0.25, 0.04, 0.02, 0.07, 0.05, 0.04, 0.60
#: Shares of the RR interval that bound the searches, and of swings and peaks.
P_RR, T_RR, P_SWING, P_FOOT, P_FALLBACK = 0.45, 0.55, 0.10, 0.20, 0.15


def waves(beats: DataFrame, df: DataFrame, by: list[str], fs: float) -> DataFrame:
    """p_on, t_end and baseline of beats with qrs_on and qrs_off, from samples (…, i from 0 on, mv).

    The baseline is the median of the PR segment, or of the series where that has under two samples. P is the *last* local
    maximum of the deflection before the QRS that reaches P_SWING of the swing there; the search goes back no further than
    P_RR of the series' median RR, so that a T wave's tail isn't taken for it. Its onset is where it falls to P_FOOT of the
    peak or, if that is too far off, to P_FALLBACK within the longest rise. T is the largest deflection after the QRS; the
    steepest slope after it is drawn on to the baseline. A beat's samples are one array.
    """
    keys = [*by, "r_i"]
    n = lambda seconds: int(seconds * fs)
    rise = max(n(P_RISE), 1)
    known = rr(beats, by).groupBy(*by).agg(F.percentile("rr", 0.5).alias("rr"))
    level = df.groupBy(*by).agg(F.percentile("mv", 0.5).alias("level"))
    span = F.least(F.floor(T_RR * F.col("rr")), F.lit(n(T_SPAN))).cast("int")
    b = beats.where("qrs_on is not null").join(known, by).join(level, by).withColumns({"back": F.least(F.floor(P_RR * F.col("rr")), F.lit(n(P_BACK))).cast("int"), "span": F.coalesce(span, F.lit(0))})
    b = b.withColumn("back", F.coalesce("back", F.lit(0)))
    near = b.withColumn("i", F.explode(F.sequence(F.col("qrs_on") - F.greatest(F.col("back"), F.lit(n(PR_SEGMENT))), F.greatest(F.col("qrs_on"), F.col("qrs_off") + F.col("span") - 1))))
    near = near.join(df, [*by, "i"]).groupBy(*keys, "qrs_on", "qrs_off", "rr", "level", "back", "span").agg(F.array_sort(F.collect_list(F.struct("i", "mv"))).alias("all"))
    of = lambda low, high: F.transform(F.filter("all", lambda x: (x["i"] >= low) & (x["i"] < high)), lambda x: x["mv"])
    on, off = F.col("qrs_on"), F.col("qrs_off")
    pr = of(F.greatest(on - n(PR_SEGMENT), F.lit(0)), on)
    d = A.worked_out(near, {"baseline": F.when(F.size(pr) < 2, F.col("level")).otherwise(A.median(pr))})
    start, end = F.greatest(on - F.col("back"), F.lit(0)), F.greatest(on - n(P_END), F.lit(0))
    against = lambda a: F.transform(a, lambda x: F.round(x - F.col("baseline"), 9))
    swing = of(start, on + 1)
    t_start = off + n(T_AFTER)
    d = A.worked_out(d, {"p": against(of(start, end)), "swing": F.array_max(swing) - F.array_min(swing), "t": against(of(t_start, off + F.col("span")))})
    high = F.transform("p", F.abs)
    top = F.try_element_at(F.filter(A.peaks(high), lambda x: x["value"] >= P_SWING * F.col("swing")), F.lit(-1))
    d = A.worked_out(d, {"top": F.when((F.size("p") >= n(P_LEAST)) & (F.col("swing") > 0), top)})
    at = F.col("top")["at"]
    low = F.coalesce(A.last_place(A.some(high, 0, at + 1), lambda x: x <= P_FOOT * F.col("top")["value"]), F.lit(0))
    lo = F.greatest(at - rise, F.lit(0))
    signed = F.transform(A.some(F.col("p"), lo, at - lo + 1), lambda x: x * F.signum(F.get("p", at)))
    bounded = lo + F.coalesce(A.last_place(signed, lambda x: x <= P_FALLBACK * F.col("top")["value"]), F.lit(0))
    d = d.withColumn("p_on", F.when(at.isNotNull(), start + F.when((low == 0) | (at - low > rise), bounded).otherwise(low)))
    t, size = F.col("t"), F.size("t")
    flat = lambda a: A.place_of_min(F.transform(a, lambda x: -F.abs(x)))
    d = A.worked_out(d, {"t_at": flat(t)})
    d = A.worked_out(d, {"slopes": A.gradient(A.some(t, F.col("t_at"), size))})
    d = A.worked_out(d, {"steep": flat("slopes")})
    place, slope = F.col("t_at") + F.col("steep"), F.get("slopes", F.col("steep").cast("int"))
    zero = F.bround(place - F.get(t, place.cast("int")) / slope).cast("long")
    sound = (size >= max(1, n(T_AFTER))) & (F.col("t_at") < size - 2) & (F.abs(slope) >= 1e-6)
    d = d.withColumn("t_end", F.when(sound, t_start + F.greatest(place, F.least(size - 1, zero))).cast("long"))
    return beats.join(d.select(*keys, F.col("p_on").cast("long").alias("p_on"), "t_end", "baseline"), keys, "left")


def interval(start: Column, end: Column, fs: float, name: str) -> Column:
    """A duration in ms if it is plausible."""
    ms = (end - start) / fs * 1000
    return F.when((end > start) & ms.between(*BOUNDS[name]), ms)


def intervals(beats: DataFrame, by: list[str], fs: float, least: int = 3) -> DataFrame:
    """Median pr_ms, qrs_ms and qt_ms of each series, n_beats, the share of beats with a QT, and quality."""
    each = beats.select(*by, interval(F.col("p_on"), F.col("qrs_on"), fs, "pr_ms").alias("pr"), interval(F.col("qrs_on"), F.col("qrs_off"), fs, "qrs_ms").alias("qrs"), interval(F.col("qrs_on"), F.col("t_end"), fs, "qt_ms").alias("qt"))
    out = each.groupBy(*by).agg(F.count("*").alias("n_beats"), *[F.percentile(c, 0.5).alias(f"{c}_ms") for c in ("pr", "qrs", "qt")], (F.count("qt") / F.count("*")).alias("qt_rate"))
    few = F.col("n_beats") < least
    return out.withColumns({f"{c}_ms": F.when(~few, F.col(f"{c}_ms")) for c in ("pr", "qrs", "qt")}).withColumn("quality", measurement_quality())


def measurement_quality() -> Column:
    """good from 6 beats and a QT in half of them; unmeasurable without any QT."""
    return F.when(F.col("qt_rate") == 0, "unmeasurable").when((F.col("n_beats") >= 6) & (F.col("qt_rate") >= 0.5), "good").otherwise("low")


def rr_statistics(beats: DataFrame, by: list[str], fs: float) -> DataFrame:
    """n_beats, rr_mean_ms, rr_cv (population sd), rr_rmssd_ms and regular (cv below 0.12)."""
    w = Window.partitionBy(*by).orderBy("r_i")
    each = rr(beats, by).withColumn("dd", F.col("rr") - F.lag("rr").over(w))
    out = each.groupBy(*by).agg(F.count("*").alias("n_beats"), (F.avg("rr") / fs * 1000).alias("rr_mean_ms"), (F.stddev_pop("rr") / (F.avg("rr") + 1e-9)).alias("rr_cv"), (F.sqrt(F.avg(F.pow("dd", 2))) / fs * 1000).alias("rr_rmssd_ms"))
    return out.withColumn("regular", F.col("rr_cv") < 0.12)


def premature_wide(beats: DataFrame, by: list[str], fs: float, early: float = 0.80, wide: float = 1.35, floor_ms: float = 110.0, least: int = 4) -> DataFrame:
    """Number of beats that come early and are much wider than the series' median; 0 with too few widths."""
    each = rr(beats, by).withColumn("width", (F.col("qrs_off") - F.col("qrs_on")) / fs * 1000)
    med = each.groupBy(*by).agg(F.percentile("rr", 0.5).alias("mrr"), F.percentile("width", 0.5).alias("mw"), F.count("width").alias("nw"))
    hit = (F.col("rr") < early * F.col("mrr")) & (F.col("width") > wide * F.col("mw")) & (F.col("width") >= floor_ms) & (F.col("nw") >= least)
    return each.join(med, by).groupBy(*by).agg(F.count_if(hit).alias("n_premature"))


def p_fraction(beats: DataFrame, by: list[str]) -> DataFrame:
    """Share of beats with a QRS onset that have a P wave; 0 without any."""
    return beats.groupBy(*by).agg(F.coalesce(F.try_divide(F.count_if(F.col("p_on").isNotNull() & F.col("qrs_on").isNotNull()).cast("double"), F.count("qrs_on")), F.lit(0.0)).alias("p_fraction"))


def rhythm(df: DataFrame) -> DataFrame:
    """Adds rate_category, rhythm_basis and classification of bpm, rr_cv and p_fraction. 60, 100, 0.12, 0.16, 0.35, 0.5."""
    category = F.when(F.col("bpm").isNull(), "unknown").when(F.col("bpm") < 60, "bradycardia").when(F.col("bpm") > 100, "tachycardia").otherwise("normal")
    basis = F.when((F.col("rr_cv") >= 0.16) & (F.col("p_fraction") < 0.35), "atrial_fibrillation").when((F.col("rr_cv") < 0.12) & (F.col("p_fraction") >= 0.5), "sinus").otherwise("undetermined")
    fast, slow = F.col("rate_category") == "tachycardia", F.col("rate_category") == "bradycardia"
    said = lambda f, s, n: F.when(fast, f).when(slow, s).otherwise(n)
    label = F.when(F.col("rhythm_basis") == "atrial_fibrillation", said("Atrial fibrillation with rapid ventricular response", "Atrial fibrillation with slow ventricular response", "Atrial fibrillation")).when(F.col("rhythm_basis") == "sinus", said("Sinus tachycardia", "Sinus bradycardia", "Normal sinus rhythm")).otherwise(said("Undetermined rhythm (tachycardic)", "Undetermined rhythm (bradycardic)", "Undetermined rhythm"))
    return df.withColumns({"rate_category": category, "rhythm_basis": basis}).withColumn("classification", label)
