"""Queries over signal tables: samples, beats, intervals and fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beats as B
from ..operators import qrs as Q
from ..operators import rules as U
from ..operators import signal as G
from .evaluation import rounded
from .proxies import gappy, long, read, short
from .registry import PROXIES, query

BY = ["record_id", "lead"]
LEAD = ["record_id", "lead_idx"]
FS = 50.0


def second(spark, sf):
    """A second signal: the first, three samples later, scaled and slightly bent."""
    return short(spark, sf).select("record_id", "lead_idx", (F.col("i") + 3).alias("i"), (F.col("mv") * 0.8 + ((F.col("i") * 7 + F.col("lead_idx")) % 5) / 100.0).alias("mv"))


PROXIES["second"] = "$short, second as (select record_id, lead_idx, i + 3 as i, mv * 0.8::double + ((i * 7 + lead_idx) % 5) / 100::double as mv from short)"


@query("W1_lead_reorder", "with names as (select unnest(['I','II','III','aVR','aVL','aVF','V1','V2','V3','V4','V5','V6']) as n, unnest(range(0, 12)) as k), $short, recs as (select distinct record_id from short), g as (select record_id, k as lead_idx, i from recs, names, (select unnest(range(0, 64)) as i)) select g.record_id, cast(g.lead_idx as int) as lead_idx, g.i, coalesce(s.mv, 0) as mv from g left join short s on s.record_id = g.record_id and s.lead_idx = g.lead_idx and s.i = g.i")
def _(spark, sf):
    names = F.element_at(F.array(*[F.lit(f" {x.lower()}") for x in G.LEADS]), F.col("lead_idx") + 1)
    return G.reorder_leads(short(spark, sf).withColumn("name", names).drop("lead_idx"), "name", 64)


@query("W2_resample", "with $short, g as (select record_id, lead_idx, unnest(range(0, 100)) as k from (select distinct record_id, lead_idx from short)), p as (select *, k * 63 / 99::double as pos, cast(floor(k * 63 / 99::double) as bigint) as lo, least(cast(floor(k * 63 / 99::double) as bigint) + 1, 63) as hi from g) select p.record_id, p.lead_idx, p.k as i, round(a.mv + (pos - lo) * (b.mv - a.mv), 6) as mv from p join short a on a.record_id = p.record_id and a.lead_idx = p.lead_idx and a.i = lo join short b on b.record_id = p.record_id and b.lead_idx = p.lead_idx and b.i = hi")
def _(spark, sf):
    return rounded(G.resample(short(spark, sf), LEAD, 100), "mv")


SQL_RATE = "n as (select record_id, lead_idx, max(i) as last, ((max(i) + 1) * {to}) // 100 as m from short group by all), g as (select *, unnest(range(0, m)) as k from n), p as (select *, k * (last + 1) / m::double as pos from g), q as (select *, least(cast(floor(pos) as bigint), last) as lo, least(cast(floor(pos) as bigint) + 1, last) as hi from p), r as (select q.record_id, q.lead_idx, q.k as i, a.mv + (pos - lo) * (b.mv - a.mv) as mv from q join short a on a.record_id = q.record_id and a.lead_idx = q.lead_idx and a.i = lo join short b on b.record_id = q.record_id and b.lead_idx = q.lead_idx and b.i = hi)"


@query("W2_resample_rate", f"with $short, {SQL_RATE.format(to=73)} select record_id, lead_idx, i, round(mv, 6) as mv from r")
def _(spark, sf):
    return rounded(G.resample_rate(short(spark, sf), LEAD, 100, 73), "mv")


@query("W2_resample_rate_up", f"with $short, {SQL_RATE.format(to=250)} select record_id, lead_idx, count(*) as n, round(sum(mv), 4) as total from r group by record_id, lead_idx")
def _(spark, sf):
    up = G.resample_rate(short(spark, sf), LEAD, 100, 250)
    return up.groupBy(*LEAD).agg(F.count("*").alias("n"), F.round(F.sum("mv"), 4).alias("total"))


@query("W3_pad_or_cut", "select vec_id, round(list_sum(embedding[1:40])::double, 4) as cut_sum, 100 as padded, round(embedding[40]::double, 6) as last_kept from embeddings")
def _(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    cut, padded = G.fitted(F.col("e"), 40), G.fitted(F.col("e"), 100)
    return v.select("vec_id", F.round(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x), 4).alias("cut_sum"), F.size(padded).alias("padded"), F.round(F.element_at(cut, -1), 6).alias("last_kept"))


@query("W4_zscore", "with $short, z as (select *, mv - avg(mv) over (partition by record_id, lead_idx) as x, stddev_pop(mv) over (partition by record_id, lead_idx) as sd from short) select record_id, lead_idx, i, round(x / (sd + 1e-8), 6) as shifted, round(case when sd < 1e-8 then x else x / sd end, 6) as centred, round(case when sd < 1e-12 then 0 else x / sd end, 6) as zeroed from z")
def _(spark, sf):
    s = short(spark, sf)
    return s.select("record_id", "lead_idx", "i", *[F.round(G.zscore(LEAD, g), 6).alias(n) for g, n in (("shift", "shifted"), ("centre", "centred"), ("zero", "zeroed"))])


@query("W5_tile", "select vec_id, round(embedding[1]::double, 6) as a, round(embedding[64]::double, 6) as b, round(embedding[100 % 64]::double, 6) as c, 200 as n from embeddings")
def _(spark, sf):
    t = G.tiled(F.col("embedding").cast("array<double>"), 200)
    return read(spark, sf, "embeddings").select("vec_id", F.round(t[0], 6).alias("a"), F.round(t[63], 6).alias("b"), F.round(t[99], 6).alias("c"), F.size(t).alias("n"))


@query("W6_gap_runs", 'with $long, g as (select *, i - row_number() over (partition by record_id, lead, mv is null order by i) as run from gappy) select record_id, lead, min(i) as start, max(i) + 1 as "end" from g where mv is null group by record_id, lead, run')
def _(spark, sf):
    return G.gaps(gappy(spark, sf), BY)


SQL_FILL = """f0 as (select *, last_value(mv ignore nulls) over w as pv, last_value(case when mv is not null then i end ignore nulls) over w as pi, first_value(mv ignore nulls) over v as nv, first_value(case when mv is not null then i end ignore nulls) over v as ni from gappy
 window w as (partition by record_id, lead order by i rows between unbounded preceding and current row), v as (partition by record_id, lead order by i rows between current row and unbounded following)),
med as (select record_id, lead, quantile_cont(mv, 0.5) as med from gappy group by 1, 2),
filled as (select record_id, lead, i, case when mv is not null then mv when pv is not null and nv is not null then case when ni - pi - 1 <= 5 then pv + (nv - pv) * (i - pi) / (ni - pi) else med end else coalesce(pv, nv, 0) end as mv from f0 join med using (record_id, lead))"""


@query("W7_fill_gaps", f"with $long, {SQL_FILL} select record_id, lead, i, round(mv, 6) as mv from filled")
def _(spark, sf):
    return rounded(G.fill_gaps(gappy(spark, sf), BY, 5), "mv")


#: Each lead loses stretches of its own, so that neighbours have what a lead lacks.
SQL_APART = "apart as (select record_id, lead, i, case when (i + 40 * len(lead)) % 97 between 40 and 60 then null else whole end as mv from long)"


def apart(spark, sf):
    lost = ((F.col("i") + 40 * F.length("lead")) % 97).between(40, 60)
    return long(spark, sf).select("record_id", "lead", "i", F.when(~lost, F.col("whole")).alias("mv"))


@query("W8_neighbour_repair", f"""with $long, {SQL_APART}, pairs as (select * from (values ('view', 'click', 0), ('view', 'scroll', 1), ('click', 'view', 0), ('scroll', 'view', 0)) t(lead, other, rank)),
g as (select record_id, lead, min(i) as start, max(i) + 1 as stop from (select *, i - row_number() over (partition by record_id, lead, mv is null order by i) as run from apart) where mv is null group by record_id, lead, run having max(i) + 1 - min(i) > 10),
c as (select record_id, lead, start, stop, other, rank, unnest(range(greatest(start - 50, 0), stop + 50)) as i from g join pairs using (lead)),
p as (select c.*, a.mv, b.mv as x from c left join apart a on a.record_id = c.record_id and a.lead = c.lead and a.i = c.i left join apart b on b.record_id = c.record_id and b.lead = c.other and b.i = c.i),
f as (select record_id, lead, start, stop, other, rank, count(*) filter (i >= start and i < stop and x is not null) / count(*) filter (i >= start and i < stop) as share, count(*) filter (mv is not null and x is not null) as points, regr_slope(mv, x) as slope, regr_intercept(mv, x) as shift from p group by all),
best as (select * from (select *, row_number() over (partition by record_id, lead, start order by rank, other) as place from f where share >= 0.55::double and points >= 12 and abs(slope) <= 8) where place = 1),
fill as (select e.record_id, e.lead, e.i, slope * x.mv + shift as fill from (select *, unnest(range(start, stop)) as i from best) e join apart x on x.record_id = e.record_id and x.lead = e.other and x.i = e.i)
select a.record_id, a.lead, a.i, round(coalesce(mv, fill), 5) as mv from apart a left join fill using (record_id, lead, i)""")
def _(spark, sf):
    pairs = spark.createDataFrame([("view", "click", 0), ("view", "scroll", 1), ("click", "view", 0), ("scroll", "view", 0)], "lead string, other string, rank int")
    return rounded(G.repair_from_neighbours(apart(spark, sf), pairs, 10), "mv", n=5)


@query("W9_expand_segments", """with $short, lost as (select record_id, lead_idx, i, case when i // 16 = lead_idx % 4 then mv end as mv from short), sp as (select record_id, lead_idx, count(*) as n, min(case when mv is not null then i end) as first, max(case when mv is not null then i end) as last from lost group by 1, 2),
shape as (select record_id, cast(least(greatest(round(max(n) / quantile_cont(last - first + 1, 0.5)), 1), 6) as int) as columns from sp where last is not null group by 1), med as (select record_id, lead_idx, quantile_cont(mv, 0.5) as med from lost group by 1, 2),
seg as (select l.record_id, l.lead_idx, columns, l.i - first as k, l.mv, last - first + 1 as width from lost l join sp using (record_id, lead_idx) join shape using (record_id) where l.i between first and last),
tiles as (select seg.*, (63 - k) // width + 1 as times from seg)
select record_id, lead_idx, columns, cast(any_value(width) as int) as width, 64 as n, round(sum(mv * times), 4) as total from tiles group by 1, 2, 3""")
def _(spark, sf):
    lost = short(spark, sf).withColumn("mv", F.when(F.floor(F.col("i") / 16) == F.col("lead_idx") % 4, F.col("mv")))
    out = G.expand_segments(lost, "record_id", "lead_idx", 64)
    return out.select("record_id", "lead_idx", "columns", "width", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("W10_full_width", "with $short, c as (select *, case when lead_idx = 1 or i < 16 then mv end as m from short), s as (select record_id, lead_idx, count(*) as n, min(case when m is not null then i end) as first, max(case when m is not null then i end) as last from c group by 1, 2) select record_id, lead_idx, last - first + 1 as span from s where last - first + 1 >= 0.8::double * n")
def _(spark, sf):
    lost = short(spark, sf).withColumn("mv", F.when((F.col("lead_idx") == 1) | (F.col("i") < 16), F.col("mv")))
    return G.full_width(lost, LEAD).select("record_id", "lead_idx", "span")


@query("W11_align_to_active", "with $short, a as (select *, abs(mv) > 0.5::double * max(abs(mv)) over (partition by record_id, lead_idx) as act from short), f as (select *, min(case when act then i end) over (partition by record_id, lead_idx) as f from a) select record_id, lead_idx, i - f as i, mv from f where i >= f")
def _(spark, sf):
    return G.aligned(short(spark, sf), LEAD, 0.5)


@query("W12_active_leads", "with $short, p as (select record_id, lead_idx, max(abs(mv)) as p from short group by 1, 2) select record_id, count(*) filter (p > 0.3::double) as active, count(*) as leads from p group by record_id")
def _(spark, sf):
    return G.active_leads(short(spark, sf), "record_id", "lead_idx", 0.3)


SQL_DETREND = "dt as (select record_id, lead, i, case when stddev_pop(whole) over (partition by record_id, lead) < 1e-6 then whole else whole - avg(whole) over (partition by record_id, lead order by i rows between 25 preceding and 25 following) end as mv from long)"


def detrended(spark, sf):
    return long(spark, sf).select("record_id", "lead", "i", G.detrended(BY, 25, "whole").alias("mv"))


@query("W13_detrend", f"with $long, {SQL_DETREND} select record_id, lead, i, round(mv + 1e-7, 6) as mv from dt")
def _(spark, sf):
    # 1e-7 keeps means of two-decimal values off the rounding's ties
    return rounded(detrended(spark, sf).withColumn("mv", F.col("mv") + 1e-7), "mv")


SQL_WIDE = "wide as (select record_id, i, " + ", ".join(f"max(mv) filter (lead_idx = {k}) as l{k}" for k in range(6)) + " from short group by record_id, i)"


@query("W14_limb_consistency", f"with $short, {SQL_WIDE} select record_id, round(coalesce(corr(l1, l0 + l2), 0), 6) as consistency from wide group by record_id")
def _(spark, sf):
    return rounded(G.limb_consistency(short(spark, sf)), "consistency")


@query("W15_derivation_identities", f"""with $short, {SQL_WIDE}, d as (select record_id, i, unnest(['II', 'aVR', 'aVL', 'aVF']) as name, unnest([l1, l3, l4, l5]) as a, unnest([l0 + l2, -(l0 + l1) / 2, (l0 - l2) / 2, (l1 + l2) / 2]) as b from wide), k as (select * from d where a is not null and b is not null),
z as (select record_id, name, i, (a - avg(a) over p) / stddev_pop(a) over p as za, (b - avg(b) over p) / stddev_pop(b) over p as zb, count(*) over p as n from k window p as (partition by record_id, name)),
r as (select x.record_id, x.name, lag, sum(x.za * y.zb) / any_value(x.n) as r from z x, (select unnest(range(-3, 4)) as lag) l, z y where y.record_id = x.record_id and y.name = x.name and y.i = x.i + lag group by 1, 2, 3), b as (select record_id, name, least(greatest(1 - max(r), 0), 1) as residual from r group by 1, 2)
select record_id, round(avg(residual), 6) as mean_residual, round(max(residual), 6) as worst_residual from b group by record_id""")
def _(spark, sf):
    return rounded(G.derivation_residuals(short(spark, sf), 3), "mean_residual", "worst_residual")


SQL_PAIR = "pr as (select a.record_id, a.lead_idx, a.mv as x, b.mv as y from short a join second b on a.record_id = b.record_id and a.lead_idx = b.lead_idx and a.i = b.i)"


def paired(spark, sf):
    return short(spark, sf).withColumnRenamed("mv", "x").join(second(spark, sf).withColumnRenamed("mv", "y"), [*LEAD, "i"])


@query("W16_snr", f"with $second, {SQL_PAIR} select record_id, lead_idx, round(10 * log10(avg(x * x) / avg((y - x) * (y - x))), 6) as snr from pr group by 1, 2")
def _(spark, sf):
    return paired(spark, sf).groupBy(*LEAD).agg(F.round(G.snr_db(F.col("x"), F.col("y")), 6).alias("snr"))


@query("W17_pearson_per_lead", f"with $second, {SQL_PAIR} select record_id, lead_idx, round(case when count(*) < 2 or max(x) - min(x) < 1e-12 or max(y) - min(y) < 1e-12 then 0 else corr(x, y) end, 6) as pearson from pr group by 1, 2")
def _(spark, sf):
    return paired(spark, sf).groupBy(*LEAD).agg(F.round(G.safe_corr(F.col("x"), F.col("y")), 6).alias("pearson"))


SQL_SHIFT = """sh as (select a.record_id, a.lead_idx, shift, case when max(a.mv) - min(a.mv) < 1e-12 or max(b.mv) - min(b.mv) < 1e-12 then 0 else corr(a.mv, b.mv) end as r from short a, (select unnest(range(-5, 6)) as shift) s, second b where b.record_id = a.record_id and b.lead_idx = a.lead_idx and b.i = a.i + shift group by 1, 2, 3),
best as (select * from (select *, row_number() over (partition by record_id, lead_idx order by round(r, 12) desc, shift) as p from sh) where p = 1)"""


def shifts(spark, sf):
    return G.shifted_correlation(short(spark, sf), second(spark, sf), LEAD, 5)


@query("J15_shifted_correlation", f"with $second, {SQL_SHIFT} select record_id, lead_idx, cast(shift as int) as shift, round(r, 6) as corr, round(sqrt(greatest(2 - 2 * r, 0)), 5) as nrmse from best")
def _(spark, sf):
    return rounded(rounded(shifts(spark, sf), "corr"), "nrmse", n=5)


@query("J16_cross_correlation", """with $second, r as (select a.record_id, a.lead_idx as a, b.lead_idx as b, shift, corr(a.mv, b.mv) as r from short a, (select unnest([-1, 0, 1]) as shift) s, second b where b.record_id = a.record_id and b.i = a.i + shift group by 1, 2, 3, 4)
select record_id, a, b, cast(shift as int) as shift, round(r, 6) as corr from (select *, row_number() over (partition by record_id, a, b order by round(r, 12) desc, shift) as p from r) where p = 1""")
def _(spark, sf):
    return rounded(G.cross_correlations(short(spark, sf), second(spark, sf), 1).select("record_id", "a", "b", "shift", "corr"), "corr")


@query("D23_lead_triage", """with $second, r as (select a.record_id, a.lead_idx as a, b.lead_idx as b, shift, corr(a.mv, b.mv) as r from short a, (select unnest([-3, 0]) as shift) s, second b where b.record_id = a.record_id and b.i = a.i + shift and shift = 0 group by 1, 2, 3, 4),
o as (select record_id, a, r as own from r where a = b), t as (select record_id, a, arg_max(b, struct_pack(r := round(r, 9), o := -b)) as b, max(r) as other from r where a <> b group by 1, 2) select record_id, a, b, round(own, 6) as own, round(other, 6) as other from o join t using (record_id, a) where other > own + 0.1::double""")
def _(spark, sf):
    m = G.cross_correlations(short(spark, sf), second(spark, sf), 0)
    return rounded(G.permuted_leads(m).select("record_id", "a", "b", "own", "other"), "own", "other")


@query("A28_reconstruction_disagreement", f"with $second, {SQL_SHIFT} select record_id, round(quantile_cont(r, 0.5), 6) as median_corr, round(min(r), 6) as min_corr, count(*) filter (r < 0.99::double) as unstable from best group by record_id")
def _(spark, sf):
    return rounded(shifts(spark, sf).groupBy("record_id").agg(F.percentile("corr", 0.5).alias("median_corr"), F.min("corr").alias("min_corr"), F.count_if(F.col("corr") < 0.99).alias("unstable")), "median_corr", "min_corr")


@query("A29_shape_fidelity", f"with $second, {SQL_SHIFT} select record_id, round(avg(r), 6) as mean_corr, round(quantile_cont(r, 0.5), 6) as median_corr, round(min(r), 6) as min_corr, round(avg(sqrt(greatest(2 - 2 * r, 0))), 5) as mean_nrmse from best group by record_id")
def _(spark, sf):
    out = shifts(spark, sf).groupBy("record_id").agg(F.avg("corr").alias("mean_corr"), F.percentile("corr", 0.5).alias("median_corr"), F.min("corr").alias("min_corr"), F.avg("nrmse").alias("mean_nrmse"))
    return rounded(rounded(out, "mean_corr", "median_corr", "min_corr"), "mean_nrmse", n=5)


@query("A30_absolute_fidelity", f"with $second, {SQL_SHIFT}, m as (select a.record_id, a.lead_idx, a.mv as x, b.mv as y from short a join best using (record_id, lead_idx) join second b on b.record_id = a.record_id and b.lead_idx = a.lead_idx and b.i = a.i + shift) select record_id, lead_idx, round(sqrt(avg((y - x) * (y - x))), 6) as rmse, round(10 * log10(greatest(avg(x * x), 1e-12) / greatest(avg((y - x) * (y - x)), 1e-12)), 6) as snr_db, round(sqrt(greatest(avg(y * y), 1e-12) / greatest(avg(x * x), 1e-12)), 6) as gain from m group by 1, 2")
def _(spark, sf):
    return rounded(G.fidelity(short(spark, sf), second(spark, sf), LEAD, shifts(spark, sf)), "rmse", "snr_db", "gain")


@query("A31_lead_gains", "with $second, a as (select record_id, lead_idx, sqrt(avg(mv * mv)) as a from short group by 1, 2), b as (select record_id, lead_idx, sqrt(avg(mv * mv)) as b from second group by 1, 2), g as (select record_id, b / a as gain from a join b using (record_id, lead_idx)) select record_id, round(quantile_cont(gain, 0.5), 6) as median_gain, round(stddev_pop(gain) / avg(gain), 6) as cv from g group by record_id")
def _(spark, sf):
    g = G.lead_gains(short(spark, sf), second(spark, sf), LEAD)
    return rounded(g.groupBy("record_id").agg(F.percentile("gain", 0.5).alias("median_gain"), (F.stddev_pop("gain") / F.avg("gain")).alias("cv")), "median_gain", "cv")


@query("J17_ink_overlay", """with px as (select distinct l_suppkey as image_id, l_partkey % 50 as x, cast(l_quantity as bigint) as y, l_linenumber % 2 = 1 as is_ink from lineitem), ink as (select * from px where is_ink), tr as (select * from px where not is_ink),
t as (select image_id, count(*) as nt, count(*) filter (exists (select 1 from ink where ink.image_id = tr.image_id and ink.x = tr.x and abs(ink.y - tr.y) <= 3)) as ht from tr group by image_id), k as (select image_id, count(*) as ni, count(*) filter (exists (select 1 from tr where tr.image_id = ink.image_id and tr.x = ink.x and abs(ink.y - tr.y) <= 8)) as hi from ink group by image_id),
b as (select image_id, ht / nt as p, hi / ni as r from t full join k using (image_id)) select image_id, round(case when p is null or r is null then 0 else p end, 6) as precision, round(case when p is null or r is null then 0 else r end, 6) as recall, round(case when p is null or r is null or p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1, round(case when p is null or r is null then 1 when p + r = 0 then 1 else 1 - 2 * p * r / (p + r) end, 6) as residual from b""")
def _(spark, sf):
    px = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 50).alias("x"), F.col("l_quantity").cast("long").alias("y"), (F.col("l_linenumber") % 2 == 1).alias("ink"))
    return rounded(G.ink_overlay(px.where("ink"), px.where("not ink")), "precision", "recall", "f1", "residual")


@query("W31_column_views", "with $short, c as (select unnest(range(0, 12)) as lead_idx) select record_id, cast(lead_idx // 3 as int) as view, count(*) as n, round(sum(mv), 5) as total from short group by 1, 2")
def _(spark, sf):
    return rounded(G.column_views(short(spark, sf), "3x4").groupBy("record_id", "view").agg(F.count("*").alias("n"), F.sum("mv").alias("total")), "total", n=5)


# beats, with all times in samples

PROXIES["detrended"] = f"$long, {SQL_DETREND}"
PROXIES["beats"] = """$detrended,
b0 as (select *, coalesce((mv - lag(mv) over (partition by record_id, lead order by i)) ** 2, 0) as d from dt), b1 as (select *, round(avg(d) over (partition by record_id, lead order by i rows between 3 preceding and 3 following), 6) as e from b0),
b2 as (select *, avg(e) over p + 0.5::double * stddev_pop(e) over p as cut, lag(e) over o as bf from b1 window p as (partition by record_id, lead), o as (partition by record_id, lead order by i)),
b3 as (select *, lead(e) over o as af, lead(i) over o as nx from b2 where bf is null or bf <> e window o as (partition by record_id, lead order by i)), b4 as (select record_id, lead, e, (i + nx - 1) // 2 as i from b3 where e > bf and e > af and e >= cut),
b5 as (select *, sum(new) over (partition by record_id, lead order by i) as cl from (select *, case when i - lag(i) over (partition by record_id, lead order by i) < 8 then 0 else 1 end as new from b4)),
b6 as (select record_id, lead, unnest(list_reduce(tops, lambda kept, x: case when len(list_filter(kept, lambda y: abs(y - x) < 8)) > 0 then kept else list_append(kept, x) end, []::bigint[])) as p from (select record_id, lead, cl, list(i order by e desc, i desc) as tops from b5 group by 1, 2, 3)),
lv as (select record_id, lead, i, abs(mv - avg(mv) over (partition by record_id, lead)) as dev from dt),
b7 as (select record_id, lead, p, arg_max(lv.i, struct_pack(d := round(dev, 12), o := -lv.i)) as r_i from b6 join lv using (record_id, lead) where lv.i between p - 3 and p + 3 group by 1, 2, 3),
beats as (select record_id, lead, r_i, row_number() over (partition by record_id, lead order by r_i) - 1 as beat_no from (select distinct record_id, lead, r_i from b7)),
rrs as (select *, r_i - lag(r_i) over (partition by record_id, lead order by r_i) as rr from beats)"""


def beats(spark, sf):
    return B.detect(detrended(spark, sf), BY, 7, 8, 3)


@query("W18_beats", "with $beats select record_id, lead, r_i, beat_no from beats")
def _(spark, sf):
    return beats(spark, sf).select("record_id", "lead", "r_i", F.col("beat_no").cast("long").alias("beat_no"))


@query("W19_rate", "with $beats select record_id, lead, count(*) as n_beats, round(60 * 50 / quantile_cont(case when rr >= 3000 / 220::double and rr <= 3000 / 25::double then rr end, 0.5), 6) as bpm from rrs group by 1, 2")
def _(spark, sf):
    return rounded(B.rate(beats(spark, sf), BY, FS), "bpm")


PROXIES["acf"] = """$detrended, a0 as (select record_id, lead, i, (mv - lag(mv) over (partition by record_id, lead order by i)) ** 2 as d from dt), a1 as (select record_id, lead, i, d - avg(d) over (partition by record_id, lead) as z, count(*) over (partition by record_id, lead) as n from a0 where d is not null),
a2 as (select a.record_id, a.lead, a.n, l.lag, sum(a.z * coalesce(b.z, 0)) as r from a1 a join (select unnest([0] || range(3, 20)) as lag) l on l.lag < a.n - 1 left join a1 b on b.record_id = a.record_id and b.lead = a.lead and b.i = a.i + l.lag group by 1, 2, 3, 4),
a3 as (select record_id, lead, list(round(r / r0, 9) order by lag) as h from (select *, max(case when lag = 0 then r end) over (partition by record_id, lead) + 1e-10 as r0 from a2) where lag > 0 group by 1, 2 having count(*) >= 10),
a4 as (select *, list_filter(range(2, len(h)), lambda k: h[k] > h[k - 1] and h[k] > h[k + 1]) as tops from a3),
a5 as (select *, list_reduce(list_transform(list_reverse_sort(list_transform(tops, lambda k: {'v': h[k], 'k': k})), lambda x: x.k), lambda kept, x: case when len(list_filter(kept, lambda y: abs(y - x) < 7)) > 0 then kept else list_append(kept, x) end, []::bigint[]) as held from a4),
a6 as (select record_id, lead, h, unnest(held) as k from a5),
a7 as (select *, (select max(j) from unnest(range(1, k)) as t(j) where h[j] > h[k]) as lo, (select min(j) from unnest(range(k + 1, len(h) + 1)) as t(j) where h[j] > h[k]) as hi from a6),
acf as (select record_id, lead, min(k) + 2 as lag from a7 where h[k] - greatest(list_min(h[coalesce(lo, 0) + 1:k]), list_min(h[k + 1:coalesce(hi, len(h) + 1) - 1])) >= 0.05::double group by 1, 2)"""


def acf_rate(spark, sf):
    return B.autocorrelation_rate(detrended(spark, sf), BY, FS, 3, 20)


@query("W20_autocorrelation_rate", "with $acf select record_id, lead, lag, round(60 * 50 / lag::double, 4) as bpm from acf")
def _(spark, sf):
    return rounded(acf_rate(spark, sf), "bpm", n=4)


@query("W19_record_rate", """with $beats, $acf, x as (select record_id, lead, 60 * 50 / quantile_cont(case when rr >= 3000 / 220::double and rr <= 3000 / 25::double then rr end, 0.5) as bpm from rrs group by 1, 2),
y as (select record_id, lead, bpm, 60 * 50 / lag::double as acf_bpm from x full join acf using (record_id, lead)), z as (select *, row_number() over (partition by record_id order by bpm is null, case lead when 'purchase' then 1 when 'click' then 2 else 3 end, lead) as p from y where bpm is not null or acf_bpm is not null)
select record_id, lead, round(coalesce(bpm, acf_bpm), 6) as bpm, case when bpm is not null then 'beats' else 'autocorrelation' end as basis from z where p = 1""")
def _(spark, sf):
    rates = B.rate(beats(spark, sf), BY, FS).join(acf_rate(spark, sf).select(*BY, F.col("bpm").alias("acf_bpm")), BY, "full")
    return rounded(B.lead_rate(rates, "record_id", "lead", ["purchase", "click"]), "bpm")


@query("W21_measurement_lead", "with $long, s as (select record_id, lead, stddev_pop(whole) as sd from long group by 1, 2) select record_id, lead from (select *, row_number() over (partition by record_id order by case lead when 'purchase' then 1 when 'click' then 2 else 3 end, lead) as p from s where sd >= 0.1::double) where p = 1")
def _(spark, sf):
    return B.measurement_lead(long(spark, sf).withColumnRenamed("whole", "mv"), "record_id", "lead", ["purchase", "click"])


@query("J18_beat_windows", "with $beats select b.record_id, b.lead, b.r_i, count(*) as n, round(max(abs(mv)), 6) as peak from beats b join dt on dt.record_id = b.record_id and dt.lead = b.lead and dt.i between b.r_i - 4 and b.r_i + 4 group by 1, 2, 3")
def _(spark, sf):
    w = B.around(beats(spark, sf), detrended(spark, sf), BY, 4, 4)
    return rounded(w.groupBy(*BY, "r_i").agg(F.count("*").alias("n"), F.max(F.abs("mv")).alias("peak")), "peak")


PROXIES["qrs"] = """$beats, g0 as (select record_id, lead, i, abs(coalesce(lead(mv) over o, mv) - coalesce(lag(mv) over o, mv)) / 2 as g from dt window o as (partition by record_id, lead order by i)), g1 as (select record_id, lead, i, avg(g) over (partition by record_id, lead order by i rows between 2 preceding and 2 following) as g from g0),
q0 as (select b.record_id, b.lead, b.r_i, b.beat_no, g1.i, g1.g, max(g1.g) over (partition by b.record_id, b.lead, b.r_i) as m from beats b join g1 on g1.record_id = b.record_id and g1.lead = b.lead and g1.i between b.r_i - 4 and b.r_i + 4),
qrs as (select record_id, lead, r_i, beat_no, min(case when g > 0.15::double * m then i end) as qrs_on, max(case when g > 0.15::double * m then i end) as qrs_off from q0 group by 1, 2, 3, 4)"""


def qrs(spark, sf):
    return B.qrs_bounds(beats(spark, sf), detrended(spark, sf), BY, 4)


@query("W22_qrs_bounds", "with $qrs select record_id, lead, r_i, qrs_on, qrs_off from qrs")
def _(spark, sf):
    return qrs(spark, sf).select("record_id", "lead", "r_i", "qrs_on", "qrs_off")


def delineated(spark, sf):
    return B.waves(qrs(spark, sf), detrended(spark, sf), BY, FS)


SQL_LOCAL = "list_filter(range(2, len({0})), lambda j: h[{0}[j]] > h[{0}[j - 1]] and h[{0}[j]] > h[{0}[j + 1]])"  # runs that are higher than both neighbours
PROXIES["waves"] = f"""$qrs, v0 as (select record_id, lead, quantile_cont(rr, 0.5) as rr from rrs group by 1, 2), v1 as (select record_id, lead, quantile_cont(mv, 0.5) as level from dt group by 1, 2),
v2 as (select q.*, level, coalesce(least(floor(0.45::double * rr), 12), 0)::bigint as back, coalesce(least(floor(0.55::double * rr), 30), 0)::bigint as span from qrs q join v0 using (record_id, lead) join v1 using (record_id, lead) where qrs_on is not null),
v3 as (select v2.record_id, v2.lead, r_i, qrs_on, qrs_off, level, back, span, list(mv order by i) filter (i >= greatest(qrs_on - 2, 0) and i < qrs_on) as pr, list(mv order by i) filter (i >= greatest(qrs_on - back, 0) and i < greatest(qrs_on - 2, 0)) as p,
  max(mv) filter (i >= greatest(qrs_on - back, 0) and i <= qrs_on) - min(mv) filter (i >= greatest(qrs_on - back, 0) and i <= qrs_on) as swing, list(mv order by i) filter (i >= qrs_off + 2 and i < qrs_off + span) as t
  from v2 join dt on dt.record_id = v2.record_id and dt.lead = v2.lead and dt.i between qrs_on - greatest(back, 2) and greatest(qrs_on, qrs_off + span - 1) group by all),
v4 as (select *, case when coalesce(len(pr), 0) < 2 then level else list_median(pr) end as baseline from v3),
v5 as (select *, list_transform(p, lambda x: round(x - baseline, 9)) as s, list_transform(p, lambda x: abs(round(x - baseline, 9))) as h, list_transform(t, lambda x: round(x - baseline, 9)) as u from v4),
v6 as (select *, list_filter(range(1, len(h) + 1), lambda k: k = 1 or h[k] <> h[k - 1]) as g from v5),
v7 as (select *, list_transform(list_filter({SQL_LOCAL.format("g")}, lambda j: h[g[j]] >= 0.1::double * swing), lambda j: (g[j] + g[j + 1] - 1) // 2)[-1] as top from v6 where swing > 0 and len(p) >= 1),
v8 as (select *, h[top] as m, list_filter(range(1, top + 1), lambda k: h[k] <= 0.2::double * h[top])[-1] as low, greatest(top - 3, 1) as lo from v7 where top is not null),
v9 as (select record_id, lead, r_i, greatest(qrs_on - back, 0) - 1 + case when low is null or low = 1 or top - low > 3 then coalesce(list_filter(range(lo, top + 1), lambda k: s[k] * sign(s[top]) <= 0.15::double * m)[-1], lo) else low end as p_on from v8),
u1 as (select record_id, lead, r_i, qrs_off, u, list_position(list_transform(u, lambda x: abs(x)), list_max(list_transform(u, lambda x: abs(x)))) as ta from v5 where len(u) >= 2),
u2 as (select *, list_transform(range(ta, len(u) + 1), lambda k: case when k = ta then u[k + 1] - u[k] when k = len(u) then u[k] - u[k - 1] else (u[k + 1] - u[k - 1]) / 2 end) as gr from u1 where ta < len(u) - 1),
u3 as (select *, list_position(list_transform(gr, lambda x: abs(x)), list_max(list_transform(gr, lambda x: abs(x)))) as st from u2), u4 as (select *, ta + st - 2 as place, gr[st] as slope from u3),
u5 as (select record_id, lead, r_i, (qrs_off + 2 + greatest(place, least(len(u) - 1, round_even(place - u[place + 1] / slope, 0))))::bigint as t_end from u4 where abs(slope) >= 1e-6),
waves as (select q.*, v4.baseline, p_on, t_end from qrs q left join v4 using (record_id, lead, r_i) left join v9 using (record_id, lead, r_i) left join u5 using (record_id, lead, r_i))"""


@query("W23_waves", "with $waves select record_id, lead, r_i, p_on, t_end, round(baseline, 6) as baseline from waves")
def _(spark, sf):
    return rounded(delineated(spark, sf).select("record_id", "lead", "r_i", "p_on", "t_end", "baseline"), "baseline", n=6)


@query("W24_intervals", "with $qrs, w as (select *, (qrs_off - qrs_on) / 50::double * 1000 as ms from qrs) select record_id, lead, count(*) as n_beats, round(case when count(*) >= 3 then quantile_cont(case when ms between 40 and 220 and qrs_off > qrs_on then ms end, 0.5) end, 6) as qrs_ms from w group by 1, 2")
def _(spark, sf):
    flat = qrs(spark, sf).withColumns({"p_on": F.lit(None).cast("long"), "t_end": F.lit(None).cast("long")})
    return rounded(B.intervals(flat, BY, FS).select("record_id", "lead", "n_beats", "qrs_ms"), "qrs_ms")


PROXIES["spans"] = """$waves, ms as (select record_id, lead, (qrs_on - p_on) / 50::double * 1000 as pr, (qrs_off - qrs_on) / 50::double * 1000 as qrs, (t_end - qrs_on) / 50::double * 1000 as qt from waves),
ok as (select record_id, lead, case when pr > 0 and pr between 80 and 400 then pr end as pr, case when qrs > 0 and qrs between 40 and 220 then qrs end as qrs, case when qt > 0 and qt between 200 and 700 then qt end as qt from ms),
spans as (select record_id, lead, count(*) as n_beats, quantile_cont(pr, 0.5) as pr_ms, quantile_cont(qrs, 0.5) as qrs_ms, quantile_cont(qt, 0.5) as qt_ms, count(qt) / count(*) as qt_rate from ok group by 1, 2)"""
SQL_QUALITY = "case when qt_rate = 0 then 'unmeasurable' when n_beats >= 6 and qt_rate >= 0.5::double then 'good' else 'low' end as quality"


@query("W24_all_intervals", f"""with $spans select record_id, lead, n_beats, round(case when n_beats >= 3 then pr_ms end, 4) as pr_ms, round(case when n_beats >= 3 then qrs_ms end, 4) as qrs_ms, round(case when n_beats >= 3 then qt_ms end, 4) as qt_ms, round(qt_rate, 4) as qt_rate, {SQL_QUALITY} from spans""")
def _(spark, sf):
    return rounded(B.intervals(delineated(spark, sf), BY, FS), "pr_ms", "qrs_ms", "qt_ms", "qt_rate", n=4)


@query("W26_measurement_quality", f"with $spans select record_id, lead, {SQL_QUALITY} from spans")
def _(spark, sf):
    return B.intervals(delineated(spark, sf), BY, FS).select("record_id", "lead", "quality")


SQL_RR = "rst as (select record_id, lead, count(*) as n_beats, avg(rr) / 50 * 1000 as m, stddev_pop(rr) / (avg(rr) + 1e-9) as cv, sqrt(avg(dd * dd)) / 50 * 1000 as rmssd from (select *, rr - lag(rr) over (partition by record_id, lead order by r_i) as dd from rrs) group by 1, 2)"


@query("W27_rr_statistics", f"with $beats, {SQL_RR} select record_id, lead, n_beats, round(m, 6) as rr_mean_ms, round(cv, 6) as rr_cv, round(rmssd, 6) as rr_rmssd_ms, cv < 0.12::double as regular from rst")
def _(spark, sf):
    return rounded(B.rr_statistics(beats(spark, sf), BY, FS), "rr_mean_ms", "rr_cv", "rr_rmssd_ms")


@query("W28_premature_wide", "with $qrs, r as (select *, r_i - lag(r_i) over (partition by record_id, lead order by r_i) as rr, (qrs_off - qrs_on) / 50::double * 1000 as width from qrs), m as (select record_id, lead, quantile_cont(rr, 0.5) as mrr, quantile_cont(width, 0.5) as mw, count(width) as nw from r group by 1, 2) select record_id, lead, count(*) filter (rr < 0.8::double * mrr and width > 1.35::double * mw and width >= 110 and nw >= 4) as n_premature from r join m using (record_id, lead) group by 1, 2")
def _(spark, sf):
    return B.premature_wide(qrs(spark, sf), BY, FS)


SQL_P = "pf as (select record_id, lead, coalesce(count(*) filter (p_on is not null and qrs_on is not null)::double / nullif(count(qrs_on), 0), 0) as pf from waves group by 1, 2)"


@query("W29_p_fraction", f"with $waves, {SQL_P} select record_id, lead, round(pf, 6) as p_fraction from pf")
def _(spark, sf):
    return rounded(B.p_fraction(delineated(spark, sf), BY), "p_fraction")


@query("W30_rhythm", f"""with $waves, {SQL_RR}, {SQL_P}, x as (select record_id, lead, 60 * 50 / nullif(quantile_cont(rr, 0.5), 0) as bpm from rrs group by 1, 2), y as (select record_id, lead, bpm, cv, pf from rst join x using (record_id, lead) join pf using (record_id, lead)),
c as (select *, case when bpm is null then 'unknown' when bpm < 60 then 'bradycardia' when bpm > 100 then 'tachycardia' else 'normal' end as rate_category, case when cv >= 0.16::double and pf < 0.35::double then 'atrial_fibrillation' when cv < 0.12::double and pf >= 0.5::double then 'sinus' else 'undetermined' end as rhythm_basis from y)
select record_id, lead, rate_category, rhythm_basis, case rhythm_basis when 'atrial_fibrillation' then 'Atrial fibrillation' || case rate_category when 'tachycardia' then ' with rapid ventricular response' when 'bradycardia' then ' with slow ventricular response' else '' end when 'sinus' then case rate_category when 'tachycardia' then 'Sinus tachycardia' when 'bradycardia' then 'Sinus bradycardia' else 'Normal sinus rhythm' end else 'Undetermined rhythm' || case rate_category when 'tachycardia' then ' (tachycardic)' when 'bradycardia' then ' (bradycardic)' else '' end end as classification from c""")
def _(spark, sf):
    b = delineated(spark, sf)
    bpm = B.rr(b, BY).groupBy(*BY).agg((60 * FS / F.percentile("rr", 0.5)).alias("bpm"))
    rows = B.rr_statistics(b, BY, FS).join(bpm, BY).join(B.p_fraction(b, BY), BY)
    return B.rhythm(rows).select("record_id", "lead", "rate_category", "rhythm_basis", "classification")


def shapes(spark, sf):
    return Q.morphology(beats(spark, sf), detrended(spark, sf), BY, FS)


def sql_shapes(beats: str, out: str) -> str:
    """Shapes of the beats of a table, as ``out``: window 3 before to 11 after, lists in place of arrays."""
    smooth = lambda x, k: f"case when len({x}) < {2 * k + 1} then {x} else list_transform({x}, lambda e, i: round(list_sum({x}[greatest(i - {k}, 1):i + {k}]) / {2 * k + 1}, 9)) end"
    notch = lambda x: f"coalesce(len({x}) >= 4 and list_max({x}) - list_min({x}) > 1e-9 and len(list_filter(range(2, len({x})), lambda k: {x}[k] - {x}[k - 1] < -0.08::double * (list_max({x}) - list_min({x})) and {x}[k + 1] - {x}[k] > 0.08::double * (list_max({x}) - list_min({x})))) > 0, false)"
    return f"""{out}_0 as (select b.record_id, b.lead, b.r_i, b.beat_no, list(mv order by i) filter (i >= r_i - 3) as seg, quantile_cont(mv, 0.5) filter (i >= greatest(r_i - 11, 0) and i < greatest(greatest(r_i - 11, 0) + 1, r_i - 4)) as base
  from {beats} b join dt on dt.record_id = b.record_id and dt.lead = b.lead and dt.i between r_i - 11 and r_i + 10 group by 1, 2, 3, 4),
{out}_1 as (select * replace (list_transform({smooth("seg", 2)}, lambda x: round(x - base, 9)) as seg) from {out}_0 where len(seg) >= 4),
{out}_2 as (select *, list_filter(range(1, len(seg) + 1), lambda k: abs(seg[k]) >= 0.12::double * list_max(list_transform(seg, lambda x: abs(x)))) as act from {out}_1 where list_max(list_transform(seg, lambda x: abs(x))) > 1e-6),
{out}_3 as (select *, seg[act[1]:act[-1]] as q, 0.18::double * list_max(list_transform(seg[act[1]:act[-1]], lambda x: abs(x))) as cut from {out}_2 where len(act) > 1),
{out}_4 as (select *, len(q) as size, list_filter(range(1, len(q) + 1), lambda k: q[k] > cut) as pos, list_filter(range(1, len(q) + 1), lambda k: q[k] < -cut) as neg, list_position(q, list_min(q)) as nadir from {out}_3),
{out}_5 as (select *, case when pos[1] < coalesce(neg[1], size + 1) then 1 when neg[1] is not null then -1 end as sg, case when pos[1] is not null then pos[1] - 1 + list_position(q[pos[1]:], list_min(q[pos[1]:])) end as s_at from {out}_4),
{out}_6 as (select *, coalesce(list_filter(pos, lambda k: k > s_at + 2), []) as late, pos[1] is not null and neg[-1] > pos[1] and q[s_at] < -cut as rs, list_transform(q, lambda x: x * sg) as w, {smooth("list_transform(q[1:4], lambda x: -x)", 1)} as d1, {smooth("list_transform(q[greatest(nadir - 4, 1):nadir], lambda x: -x)", 1)} as d2 from {out}_5),
{out} as (select record_id, lead, r_i, beat_no, (size - 1) / 50::double * 1000 as qrs_ms,
  case when sg is null then null when neg[1] is null then 'r' when pos[1] is null then 'qs' when sg = -1 then case when neg[-1] > pos[1] then 'qrs' else 'qr' end when len(late) > 0 then 'rsr' else 'rs' end as pattern,
  case sg when 1 then 'r' when -1 then 'q' end as initial, case when sg is not null then (coalesce(list_filter(range(case sg when 1 then pos[1] else neg[1] end + 1, size + 1), lambda k: w[k] <= 0.08::double * list_max(w))[1] - 1, size)) / 50::double * 1000 end as initial_ms,
  case when abs(list_max(q)) >= abs(list_min(q)) then 'positive' else 'negative' end as polarity, coalesce(rs, false) as has_rs, case when rs then (s_at - pos[1]) / 50::double * 1000 end as rs_ms, case when neg[1] is not null then (nadir - 1) / 50::double * 1000 end as nadir_ms,
  case when pos[1] is not null and neg[1] is not null then list_max(q) / abs(list_min(q)) end as r_s, case when size > 4 and abs(q[size] - q[size - 2]) > 1e-9 then abs(q[3] - q[1]) / abs(q[size] - q[size - 2]) end as vi_vt,
  case when pos[1] is not null and neg[1] is not null and len(late) > 0 then list_max(q[pos[1]:s_at]) > list_max(list_transform(late, lambda k: q[k])) end as taller, coalesce(sg = -1, false) and {notch("d1")} as notched, neg[1] is not null and {notch("d2")} as s_notched from {out}_6)"""


def sql_leads(shapes: str, out: str) -> str:
    mode = lambda c: f"{out}_{c} as (select record_id, lead, arg_max({c}, struct_pack(k := k, s := -seen)) as {c} from (select record_id, lead, {c}, count(*) as k, min(beat_no) as seen from {shapes} where {c} is not null group by 1, 2, 3) group by 1, 2)"
    most = lambda c, n: f"count(*) filter ({c}) >= greatest(1, {n} // 2)"
    medians = ", ".join(f"quantile_cont({c}, 0.5) as {c}" for c in ("qrs_ms", "rs_ms", "initial_ms", "nadir_ms", "r_s", "vi_vt"))
    names = ("pattern", "initial", "polarity")
    return f"""{", ".join(map(mode, names))}, {out}_0 as (select record_id, lead, count(*) as beats, {medians}, {most("has_rs", "count(*)")} as has_rs, {most("notched", "count(*)")} as notched, {most("s_notched", "count(*)")} as s_notched, case when count(taller) > 0 then {most("taller", "count(taller)")} end as taller from {shapes} group by 1, 2),
{out} as (select * from {out}_0 {" ".join(f"left join {out}_{c} using (record_id, lead)" for c in names)})"""


MS = ("qrs_ms", "rs_ms", "initial_ms", "nadir_ms", "r_s", "vi_vt")
SQL_MS = ", ".join(f"round({c}, 4) as {c}" for c in MS)
PROXIES["shapes"] = "$beats, " + sql_shapes("beats", "shapes")
CHEST, V1, V6, AVR, ANCHORS = ["view", "click", "error"], "view", "click", "signup", ["purchase", "view", "click", "error"]


@query("W33_morphology", f"with $shapes select record_id, lead, r_i, beat_no, {SQL_MS}, pattern, initial, polarity, has_rs, taller, notched, s_notched from shapes")
def _(spark, sf):
    return rounded(shapes(spark, sf), *MS, n=4)


@query("W34_lead_morphology", f"with $shapes, {sql_leads('shapes', 'leads')} select record_id, lead, beats, {SQL_MS}, pattern, initial, polarity, has_rs, taller, notched, s_notched from leads")
def _(spark, sf):
    return rounded(Q.lead_morphology(shapes(spark, sf), BY), *MS, n=4)


# leads of a record in place of V1 to V6 and aVR; the anchor is the first with beats in its order
PROXIES["features"] = f"""$beats, n0 as (select record_id, lead, count(*) as n from beats group by 1, 2 having count(*) >= 3), n1 as (select record_id, lead from dt group by 1, 2 having stddev_pop(mv) >= 0.05::double),
n2 as (select record_id, lead, row_number() over (partition by record_id order by case lead when 'purchase' then 1 when 'view' then 2 when 'click' then 3 when 'error' then 4 else 5 end, lead) as p from n0 join n1 using (record_id, lead)),
anchored as (select b.record_id, b.lead as anchor, r_i, beat_no from beats b join n2 using (record_id, lead) where p = 1), spread as (select record_id, unnest(['view', 'click', 'error', 'signup']) as lead, r_i, beat_no from anchored), {sql_shapes("spread", "fshapes")}, {sql_leads("fshapes", "fleads")},
fwide as (select record_id, count(*) filter (lead <> 'signup') as leads, bool_and(not has_rs) filter (lead <> 'signup') as rs_absent, max(rs_ms) filter (lead <> 'signup') as max_rs_ms from fleads group by 1),
features as (select * from (select record_id, any_value(anchor) as anchor_lead, count(*) as n_beats from anchored group by 1) left join fwide using (record_id))"""


def features(spark, sf):
    df, b = detrended(spark, sf), beats(spark, sf)
    return Q.record_features(Q.anchor_beats(b, df, "record_id", "lead", ANCHORS), df, "record_id", "lead", CHEST, V1, V6, AVR, FS)


@query("W35_record_features", "with $features select record_id, anchor_lead, n_beats, leads, rs_absent, round(max_rs_ms, 4) as max_rs_ms, a.beats as v1_beats, a.pattern as v1_pattern, b.pattern as v6_pattern, c.initial as avr_initial, round(c.vi_vt, 4) as avr_vi_vt from features left join fleads a on a.record_id = features.record_id and a.lead = 'view' left join fleads b on b.record_id = features.record_id and b.lead = 'click' left join fleads c on c.record_id = features.record_id and c.lead = 'signup'".replace("select record_id, anchor", "select features.record_id, anchor"))
def _(spark, sf):
    f = features(spark, sf)
    return rounded(f.select("record_id", "anchor_lead", "n_beats", "leads", "rs_absent", "max_rs_ms", F.col("v1.beats").alias("v1_beats"), F.col("v1.pattern").alias("v1_pattern"), F.col("v6.pattern").alias("v6_pattern"), F.col("avr.initial").alias("avr_initial"), F.col("avr.vi_vt").alias("avr_vi_vt")), "max_rs_ms", "avr_vi_vt", n=4)


# the criteria of wide complexes, from samples on: shapes at the anchor's beats, its rate (or another lead's), width and regularity
PROXIES["wct_features"] = f"""$features, $waves, $acf, cf1 as (select f.record_id, quantile_cont(ms, 0.5) as qrs from features f join (select record_id, lead, case when qrs_off > qrs_on and (qrs_off - qrs_on) * 20 between 40 and 220 then (qrs_off - qrs_on) / 50::double * 1000 end as ms from qrs) q on q.record_id = f.record_id and q.lead = f.anchor_lead group by 1),
{SQL_RR}, cf2 as (select r.record_id, cv < 0.12::double as regular from rst r join features f on f.record_id = r.record_id and f.anchor_lead = r.lead),
cf3 as (select record_id, lead, 60 * 50 / quantile_cont(case when rr >= 3000 / 220::double and rr <= 3000 / 25::double then rr end, 0.5) as bpm from rrs group by 1, 2), cf4 as (select record_id, lead, bpm, 60 * 50 / lag::double as acf_bpm from cf3 full join acf using (record_id, lead)),
cf5 as (select record_id, coalesce(bpm, acf_bpm) as hr from (select *, row_number() over (partition by record_id order by bpm is null, case lead when 'purchase' then 1 when 'view' then 2 when 'click' then 3 when 'error' then 4 else 5 end, lead) as p from cf4 where bpm is not null or acf_bpm is not null) where p = 1),
wct as (select f.record_id as image_id, hr, qrs, f.n_beats as nb, f.max_rs_ms as rs, coalesce(f.rs_absent, false) as rs_absent, null::boolean as av, null::boolean as cap, regular, coalesce(a.beats, 0) as b1, a.pattern as p1, a.polarity as pol, a.r_s, a.initial as ini, a.initial_ms as ini_ms, a.nadir_ms as nadir, a.s_notched as notch, a.taller as ear,
  coalesce(b.beats, 0) as b6, b.pattern as p6, b.r_s as r_s6, coalesce(c.beats, 0) as ba, c.initial as a_ini, c.initial_ms as a_ms, c.notched as a_notch, c.vi_vt as vivt
  from features f left join cf1 using (record_id) left join cf2 using (record_id) left join cf5 using (record_id) left join fleads a on a.record_id = f.record_id and a.lead = 'view' left join fleads b on b.record_id = f.record_id and b.lead = 'click' left join fleads c on c.record_id = f.record_id and c.lead = 'signup'), $criteria"""


@query("D13_criteria_from_samples", "with $wct_features select image_id as record_id, scope, array_to_string(case when scope = '' then list_concat(bru, ver) else [] end, ',') as evidence, array_to_string(lim, ',') as limitations, case when scope <> '' then scope when len(bru) + len(ver) > 0 then 'vt_supported' else 'indeterminate_wide_complex_tachycardia' end as classification from w4")
def _(spark, sf):
    f, q, b = features(spark, sf), qrs(spark, sf), beats(spark, sf)
    of_anchor = lambda df, *c: df.join(f.select("record_id", F.col("anchor_lead").alias("lead")), BY).select("record_id", *c)
    spans = B.intervals(q.withColumns({"p_on": F.lit(None).cast("long"), "t_end": F.lit(None).cast("long")}), BY, FS, 1)
    rates = B.rate(b, BY, FS).join(acf_rate(spark, sf).select(*BY, F.col("bpm").alias("acf_bpm")), BY, "full")
    rate = B.lead_rate(rates, "record_id", "lead", ANCHORS).select("record_id", F.col("bpm").alias("heart_rate"))
    rows = f.join(of_anchor(spans, "qrs_ms"), "record_id", "left").join(of_anchor(B.rr_statistics(b, BY, FS), "regular"), "record_id", "left").join(rate, "record_id", "left")
    rows = rows.withColumns({c: F.lit(None).cast("boolean") for c in ("av_dissociation", "capture_beats")})
    return U.assess_wct(rows).select("record_id", "scope", F.array_join("evidence", ",").alias("evidence"), F.array_join("limitations", ",").alias("limitations"), "classification")
