"""Queries over score tables: ranking, classification, calibration and agreement metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..operators import scoring as S
from .proxies import CLASSES, both_views, doc_scores, read, score_pairs, scores, scores_b
from .registry import query

R = lambda c, n=6: F.round(c, n)


def rounded(df, *columns, n=6):
    return df.withColumns({c: F.round(c, n) for c in columns})


def sql_ranking(name: str, source: str, keys: str) -> str:
    """Common table expressions: ``name`` has keys, n, positives, auroc and average_precision of ``source``."""
    return f"""{name}_ties as (select {keys}, prob, sum(y)::double as pos, sum(1 - y)::double as neg from {source} group by {keys}, prob),
{name}_run as (select *, coalesce(sum(neg) over (partition by {keys} order by prob rows between unbounded preceding and 1 preceding), 0) as below,
  sum(pos) over (partition by {keys} order by prob desc rows unbounded preceding) as tp, sum(pos + neg) over (partition by {keys} order by prob desc rows unbounded preceding) as seen from {name}_ties),
{name} as (select {keys}, cast(sum(pos + neg) as bigint) as n, cast(sum(pos) as bigint) as positives,
  case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) end as auroc,
  case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * tp / seen) / sum(pos) end as average_precision from {name}_run group by {keys})"""


def sql_counts(active: str) -> str:
    return f"count(*) filter ({active} and y = 1) as tp, count(*) filter ({active} and y = 0) as fp, count(*) filter (not ({active}) and y = 0) as tn, count(*) filter (not ({active}) and y = 1) as fn"


def sql_ratio(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0 else ({a})::double / ({b}) end"


SQL_F1 = sql_ratio("2 * tp", "2 * tp + fp + fn")
SQL_RATES = f"""round({sql_ratio('tp', '(tp + fn)')}, 6) as sensitivity, round({sql_ratio('tn', '(tn + fp)')}, 6) as specificity, round({sql_ratio('tp', '(tp + fp)')}, 6) as ppv,
  round({sql_ratio('tn', '(tn + fn)')}, 6) as npv, round({sql_ratio('tp + tn', '(tp + fp + tn + fn)')}, 6) as accuracy, round({SQL_F1}, 6) as f1"""
RATES = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "f1"]


def sql_report(source: str, by: str = "", active: str = "prob >= 0.5::double", name: str = "m") -> str:
    """CTEs of multilabel_report of ``source``: ``name`` has the group columns and unrounded metrics."""
    keys = f"{by}, class" if by else "class"
    using = f"({keys})"
    group = f"group by {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""{sql_ranking(name + '_rk', source, keys)},
{name}_cnt as (select {keys}, {sql_counts(active)}, avg((prob - y) * (prob - y)) as brier from {source} group by {keys}),
{name}_bin as (select {keys}, (prob > 0.1::double)::int + (prob > 0.2::double)::int + (prob > 0.3::double)::int + (prob > 0.4::double)::int + (prob > 0.5::double)::int + (prob > 0.6::double)::int + (prob > 0.7::double)::int + (prob > 0.8::double)::int + (prob > 0.9::double)::int as bin, count(*) as k, abs(avg(prob) - avg(y)) as gap from {source} group by {keys}, bin),
{name}_ece as (select {keys}, sum(k * gap) / sum(k) as ece from {name}_bin group by {keys}),
{name}_all as (select *, positives >= 1 and positives < n as ok from {name}_rk join {name}_cnt using {using} join {name}_ece using {using}),
{name} as (select {lead}count(*) as n_classes, count(*) filter (ok) as n_eligible, coalesce(avg(auroc) filter (ok), 0) as macro_auroc, coalesce(avg(average_precision) filter (ok), 0) as macro_ap,
  coalesce(avg({SQL_F1}) filter (ok), 0) as macro_f1,
  coalesce(case when sum(2 * tp + fp + fn) filter (ok) = 0 then 0 else (2 * sum(tp) filter (ok))::double / (sum(2 * tp + fp + fn) filter (ok)) end, 0) as micro_f1,
  coalesce(avg(brier) filter (ok), 0) as macro_brier, coalesce(avg(ece) filter (ok), 0) as macro_ece from {name}_all {group})"""


METRICS = ["macro_auroc", "macro_ap", "macro_f1", "micro_f1", "macro_brier", "macro_ece"]
SQL_METRICS = "n_classes, n_eligible, " + ", ".join(f"round({m}, 6) as {m}" for m in METRICS)


@query("M1_auroc_per_class", f"with $scores, {sql_ranking('rk', 'scores', 'class')} select class, n, positives, round(auroc, 6) as auroc from rk")
def _(spark, sf):
    return rounded(M.ranking(scores(spark, sf), ["class"]).drop("average_precision"), "auroc")


@query("M1_auroc_macro", f"with $scores, {sql_ranking('rk', 'scores', 'class')} select round(coalesce(avg(auroc), 0), 6) as macro_auroc from rk")
def _(spark, sf):
    return M.ranking(scores(spark, sf), ["class"]).agg(R(F.coalesce(F.avg("auroc"), F.lit(0.0))).alias("macro_auroc"))


@query("M2_average_precision", f"with $scores, {sql_ranking('rk', 'scores', 'class')} select class, round(average_precision, 6) as average_precision from rk")
def _(spark, sf):
    return M.ranking(scores(spark, sf), ["class"]).select("class", R("average_precision").alias("average_precision"))


@query("M3_f1", f"with $scores, c as (select class, {sql_counts('prob >= 0.5::double')} from scores group by class) select class, tp, fp, tn, fn, round({SQL_F1}, 6) as f1 from c")
def _(spark, sf):
    c = scores(spark, sf).groupBy("class").agg(*M.counts(F.col("prob") >= 0.5))
    return c.withColumn("f1", R(M.f1(F.col("tp"), F.col("fp"), F.col("fn"))))


@query("M4_multilabel_report", f"with $scores, {sql_report('scores')} select {SQL_METRICS} from m")
def _(spark, sf):
    return rounded(M.multilabel_report(scores(spark, sf)), *METRICS)


@query("M5_brier", "with $scores select class, round(avg((prob - y) * (prob - y)), 6) as brier from scores group by class")
def _(spark, sf):
    return scores(spark, sf).groupBy("class").agg(R(M.brier()).alias("brier"))


@query("M6_calibration_error", f"with $scores, {sql_report('scores')} select class, round(ece, 6) as ece from m_ece")
def _(spark, sf):
    return rounded(M.calibration_error(scores(spark, sf), ["class"]), "ece")


@query("M7_operating_point", f"""with $doc_scores, {sql_ranking('rk', 'doc_scores', 'lang')}, c as (select lang, {sql_counts('prob >= 0.5::double')} from doc_scores group by lang)
select lang, tp, fp, tn, fn, {SQL_RATES}, n, positives, round(auroc, 6) as auroc, round(average_precision, 6) as average_precision from c join rk using (lang)""")
def _(spark, sf):
    return rounded(M.operating_point(doc_scores(spark, sf), ["lang"]), *RATES, "auroc", "average_precision")


SQL_GROUPS = """subgroups as (select s.record_id, s.y, s.prob, unnest(list_filter([case when true then 'overall' end, case when quality = 1 then 'good' end, case when quality = 0 then 'bad' end,
  case when n_chars <= 1000 then 'short' end, case when n_chars > 1000 then 'long' end, case when lang = 'en' then 'english' end, case when source in ('src0', 'src1') then 'hot_source' end], lambda x: x is not null)) as subgroup from doc_scores s)"""


def _groups(spark, sf):
    masks = {"overall": F.lit(True), "good": F.col("quality") == 1, "bad": F.col("quality") == 0, "short": F.col("n_chars") <= 1000, "long": F.col("n_chars") > 1000, "english": F.col("lang") == "en", "hot_source": F.col("source").isin("src0", "src1")}
    return S.in_subgroups(doc_scores(spark, sf), masks)


@query("P18_subgroup_masks", f"with $doc_scores, {SQL_GROUPS} select subgroup, count(*) as n, cast(sum(y) as bigint) as positives from subgroups group by subgroup")
def _(spark, sf):
    return _groups(spark, sf).groupBy("subgroup").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


@query("M8_subgroup_report", f"""with $doc_scores, {SQL_GROUPS}, {sql_ranking('rk', 'subgroups', 'subgroup')}, c as (select subgroup, {sql_counts('prob >= 0.5::double')} from subgroups group by subgroup)
select subgroup, tp, fp, tn, fn, {SQL_RATES}, n, positives, round(auroc, 6) as auroc, round(average_precision, 6) as average_precision from c join rk using (subgroup)""")
def _(spark, sf):
    return rounded(M.operating_point(_groups(spark, sf), ["subgroup"]), *RATES, "auroc", "average_precision")


@query("M9_macro_scorer", f"""with $scores, {sql_ranking('rk', 'scores', 'class')}, sep as (select class, quantile_cont(prob, 0.5) filter (y = 1) - quantile_cont(prob, 0.5) filter (y = 0) as separation from scores group by class)
select round(avg(average_precision), 6) as macro_ap, round(avg(auroc), 6) as macro_auroc, round(avg(separation), 6) as macro_separation from rk join sep using (class) where positives >= 10""")
def _(spark, sf):
    s = scores(spark, sf)
    both = M.ranking(s, ["class"]).join(M.separation(s, ["class"]), "class").where("positives >= 10")
    return both.agg(R(F.avg("average_precision")).alias("macro_ap"), R(F.avg("auroc")).alias("macro_auroc"), R(F.avg("separation")).alias("macro_separation"))


@query("M10_semantic_subset", f"with $scores, sub as (select * from scores where class in ('FA', 'ON', 'FR')), {sql_report('sub')} select {SQL_METRICS}, (select count(distinct record_id) from sub) as n_records, 3 as n_mapped from m")
def _(spark, sf):
    sub = scores(spark, sf).where(F.col("class").isin("FA", "ON", "FR"))
    report, covered = M.multilabel_report(sub), sub.agg(F.countDistinct("record_id").alias("n_records"), F.countDistinct("class").cast("int").alias("n_mapped"))
    return rounded(report.crossJoin(covered), *METRICS)  # one row each


@query("M11_official_vectors", f"""with $scores, official as (select s.* from scores s join (select distinct o_orderkey from orders where o_orderpriority <> '1-URGENT') o on o.o_orderkey = s.record_id),
{sql_report('official')} select {SQL_METRICS}, (select count(distinct record_id) from official) as n_matched, (select count(distinct record_id) from scores) - (select count(distinct record_id) from official) as n_unmatched from m""")
def _(spark, sf):
    s = scores(spark, sf)
    known = read(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("record_id")).distinct()
    matched = s.join(known, "record_id")
    n = s.agg(F.countDistinct("record_id").alias("n")).crossJoin(matched.agg(F.countDistinct("record_id").alias("n_matched")))  # one row each
    return rounded(M.multilabel_report(matched).crossJoin(n.select("n_matched", (F.col("n") - F.col("n_matched")).alias("n_unmatched"))), *METRICS)


SQL_PAIRS = "pairs as (select a.record_id, a.class_idx, a.class, a.y, a.prob as a, b.prob as b from scores a join scores_b b on a.record_id = b.record_id and a.class_idx = b.class_idx)"


def pairs(spark, sf):
    return score_pairs(spark, sf, S.paired)


SQL_VECTOR = "{keys}, case when sqrt(sum(a * a) * sum(b * b)) = 0 then 0 else sum(a * b) / sqrt(sum(a * a) * sum(b * b)) end as cosine, avg(abs(a - b)) as mean_abs_difference, avg(((a >= 0.5::double) = (b >= 0.5::double))::int::double) as agreement"


@query("J3_paired_scenarios", f"with $scores, {SQL_PAIRS} select count(*) as n, count(distinct record_id) as n_records, round(avg(a - b), 6) as mean_shift from pairs")
def _(spark, sf):
    return pairs(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"), R(F.avg(F.col("a") - F.col("b"))).alias("mean_shift"))


@query("F3_cosine", """with $scores, v as (select vec_id, embedding from embeddings), q as (select embedding as e from embeddings where vec_id = 0)
select vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.e), lambda p: p[1]::double * p[2]::double)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::double * x::double)) * list_sum(list_transform(q.e, lambda x: x::double * x::double))), 6) as cosine from v, q""".replace("with $scores,", "with"))
def _(spark, sf):
    v = read(spark, sf, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", R(S.cosine(F.col("embedding"), F.col("q"))).alias("cosine"))  # one query row


@query("F4_agreement", f"with $scores, {SQL_PAIRS}, c as (select {SQL_VECTOR.format(keys='class')} from pairs group by class) select class, round(agreement, 6) as agreement from c")
def _(spark, sf):
    return M.vector_comparison(pairs(spark, sf), ["class"]).select("class", R("agreement").alias("agreement"))


@query("F5_vector_comparison", f"with $scores, {SQL_PAIRS}, c as (select {SQL_VECTOR.format(keys='record_id')} from pairs group by record_id) select record_id, round(cosine, 6) as cosine, round(mean_abs_difference, 6) as mean_abs_difference, round(agreement, 6) as agreement from c")
def _(spark, sf):
    return rounded(M.vector_comparison(pairs(spark, sf), ["record_id"]), "cosine", "mean_abs_difference", "agreement")


SQL_M12 = f"""with $scores, {SQL_PAIRS}, v as (select {SQL_VECTOR.format(keys='record_id')} from pairs group by record_id),
d as (select avg(cosine) as mean_cosine, avg(mean_abs_difference) as mean_abs, avg(agreement) as mean_agreement from v), {sql_report('scores', name='ma')}, {sql_report('scores_b', name='mb')}"""


def _comparison(spark, sf):
    v = M.vector_comparison(pairs(spark, sf), ["record_id"]).agg(F.avg("cosine").alias("mean_cosine"), F.avg("mean_abs_difference").alias("mean_abs"), F.avg("agreement").alias("mean_agreement"))
    name = lambda df, p: df.select(*[F.col(m).alias(f"{p}_{m}") for m in METRICS])
    return v.crossJoin(name(M.multilabel_report(scores(spark, sf)), "a")).crossJoin(name(M.multilabel_report(scores_b(spark, sf)), "b"))  # one row each


@query("M12_scenario_comparison", SQL_M12 + " select round(mean_cosine, 6) as mean_cosine, round(mean_abs, 6) as mean_abs, round(mean_agreement, 6) as mean_agreement, " + ", ".join(f"round(ma.{m}, 6) as a_{m}, round(mb.{m}, 6) as b_{m}" for m in METRICS) + " from d, ma, mb")
def _(spark, sf):
    return rounded(_comparison(spark, sf), "mean_cosine", "mean_abs", "mean_agreement", *[f"{p}_{m}" for p in "ab" for m in METRICS])


@query("F6_metric_deltas", SQL_M12 + " select " + ", ".join(f"round_even(mb.{m} - ma.{m}, 6) as delta_{m}" for m in METRICS) + " from d, ma, mb")
def _(spark, sf):
    return _comparison(spark, sf).select(*[F.bround(F.col(f"b_{m}") - F.col(f"a_{m}"), 6).alias(f"delta_{m}") for m in METRICS])


SQL_ARMS = f"""with $scores, {SQL_PAIRS}, arms as (select record_id, class, y, 'clean' as arm, a as prob from pairs union all select record_id, class, y, 'second', b from pairs union all select record_id, class, y, 'mean', (a + b) / 2 from pairs)"""


def arms(spark, sf):
    p = pairs(spark, sf)
    return S.unpivot_arms(p.withColumn("m", (F.col("a") + F.col("b")) / 2), {"clean": "a", "second": "b", "mean": "m"}, ["record_id", "class", "y"])


@query("M13_three_arms", SQL_ARMS + f""", {sql_ranking('rk', 'arms', 'arm, class')}, c as (select arm, class, {sql_counts('prob >= 0.5::double')} from arms group by arm, class),
r as (select class, corr(a, b) as r from pairs group by class) select arm, class, tp, fp, tn, fn, {SQL_RATES}, n, positives, round(auroc, 6) as auroc, round(average_precision, 6) as average_precision, round(r, 6) as score_correlation from c join rk using (arm, class) join r using (class)""")
def _(spark, sf):
    point = M.operating_point(arms(spark, sf), ["arm", "class"])
    r = pairs(spark, sf).groupBy("class").agg(M.correlation(F.col("a"), F.col("b")).alias("score_correlation"))
    return rounded(point.join(r, "class"), *RATES, "auroc", "average_precision", "score_correlation")


@query("M14_three_views", SQL_ARMS + f""", {sql_ranking('rk', 'arms', 'arm, class')}, sep as (select arm, class, quantile_cont(prob, 0.5) filter (y = 1) - quantile_cont(prob, 0.5) filter (y = 0) as separation from arms group by arm, class)
select arm, round(avg(average_precision), 6) as macro_ap, round(avg(auroc), 6) as macro_auroc, round(avg(separation), 6) as macro_separation from rk join sep using (arm, class) group by arm""")
def _(spark, sf):
    a = arms(spark, sf)
    both = M.ranking(a, ["arm", "class"]).join(M.separation(a, ["arm", "class"]), ["arm", "class"])
    return both.groupBy("arm").agg(R(F.avg("average_precision")).alias("macro_ap"), R(F.avg("auroc")).alias("macro_auroc"), R(F.avg("separation")).alias("macro_separation"))


@query("M15_head_combinations", f"""with $scores, h as (select record_id, max(y) as y, max(prob) as hi, avg(prob) as lo from scores where class in ('FA', 'FN', 'FR') group by record_id),
arms as (select record_id, y, 'max' as head, round(hi, 9) as prob from h union all select record_id, y, 'mean', round(lo, 9) from h), {sql_ranking('rk', 'arms', 'head')} select head, n, positives, round(auroc, 6) as auroc, round(average_precision, 6) as average_precision from rk""")
def _(spark, sf):
    h = S.combined_heads(scores(spark, sf).where(F.col("class").isin("FA", "FN", "FR")), ["record_id"])
    return rounded(M.ranking(h.withColumn("prob", F.round("prob", 9)), ["head"]), "auroc", "average_precision")


def sql_t_p(source: str, t: str, df: str, name: str) -> str:
    """Tables up to ``name``: ``source`` with p, the two-sided probability of Student's t, by the continued fraction of the incomplete beta function."""
    even, odd = "(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))", "(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))"
    d, c = f"(1 + {even} * s.d)", f"(1 + {even} / s.c)"
    e, f = f"(1 + {odd} / {d})", f"(1 + {odd} / {c})"
    return f"""{name}_0 as (select *, ({t})::double as t_, ({df})::double as df_ from {source}), {name}_1 as (select *, df_ / (df_ + t_ * t_) as x0, df_ / 2 as a0, 0.5::double as b0 from {name}_0),
{name}_2 as (select *, x0 < (a0 + 1) / (a0 + b0 + 2) as low from {name}_1), {name}_3 as (select *, case when low then a0 else b0 end as a, case when low then b0 else a0 end as b, case when low then x0 else 1 - x0 end as x from {name}_2),
{name}_4 as (select *, list_reduce(range(1, 401), lambda s, m: {{'d': 1 / {e}, 'c': {f}, 'h': s.h * {c} / {d} * {f} / {e}}}, {{'d': 1 / (1 - (a + b) * x / (a + 1)), 'c': 1::double, 'h': 1 / (1 - (a + b) * x / (a + 1))}}).h as h from {name}_3),
{name} as (select * exclude (t_, df_, x0, a0, b0, low, a, b, x, h), case when df_ > 0 then abs(case when low then 0 else 1 end - exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / a) end as p from {name}_4)"""


@query("M17_spearman", f"""with $scores, p as (select a.class, a.prob as x, abs(a.prob - b.prob) as z from scores a join scores_b b on a.record_id = b.record_id and a.class_idx = b.class_idx),
k as (select class, rank() over (partition by class order by x) + (count(*) over (partition by class, x) - 1) / 2::double as rx, rank() over (partition by class order by round(z, 9)) + (count(*) over (partition by class, round(z, 9)) - 1) / 2::double as rz from p),
c as (select class, count(*) as n, corr(rx, rz) as rho from k group by class),
{sql_t_p('c', 'rho * sqrt((n - 2) / (1 - rho * rho))', 'n - 2', 'pv')} select class, n, round(rho, 6) as rho, round(p, 6) as p from pv""")
def _(spark, sf):
    p = pairs(spark, sf).select("class", F.col("a").alias("x"), F.round(F.abs(F.col("a") - F.col("b")), 9).alias("z"))
    return rounded(M.spearman(p, ["class"], "x", "z"), "rho", "p")


@query("M18_length_arms", SQL_ARMS + f", {sql_report('arms', 'arm')} select arm, {SQL_METRICS} from m")
def _(spark, sf):
    return rounded(M.multilabel_report(arms(spark, sf), ["arm"]), *METRICS)


# scores to findings


@query("P13_active_finding", "with $scores, cal as (select * from (values ('FA', 0.7::double), ('ON', 0.4::double), ('FR', null)) t(class, class_threshold)) select class, count(*) filter (prob >= coalesce(class_threshold, 0.5::double)) as n_active from scores left join cal using (class) group by class")
def _(spark, sf):
    cal = spark.createDataFrame([("FA", 0.7), ("ON", 0.4), ("FR", None)], "class string, class_threshold double")
    held = scores(spark, sf).join(F.broadcast(cal), "class", "left")
    return held.groupBy("class").agg(F.count_if(S.is_active(F.lit(0.5))).alias("n_active"))


@query("P14_collect_results", """with $scores, cal as (select * from (values ('FA', 0.7::double, 'validated'), ('ON', 0.4::double, 'provisional')) t(class, class_threshold, tier))
select record_id, class, class_idx, prob, class_threshold, coalesce(tier, 'research_only') as tier from scores left join cal using (class) where prob >= coalesce(class_threshold, 0.9::double)""")
def _(spark, sf):
    vectors = scores(spark, sf).groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "prob"))), lambda x: x["prob"]).alias("probs"))
    cal = spark.createDataFrame([("FA", 0.7, "validated"), ("ON", 0.4, "provisional")], "class string, class_threshold double, tier string")
    return S.collect_results(vectors, CLASSES, cal, 0.9)


@query("P15_hidden_research", "with $scores select class, count(*) filter (class in ('FA', 'OA') and not class in ('OA')) as n_hidden from scores group by class")
def _(spark, sf):
    tier = F.when(F.col("class").isin("FA", "OA"), "research_only").otherwise("validated")
    return scores(spark, sf).withColumn("tier", tier).groupBy("class").agg(F.count_if(S.is_hidden_research(critical=["OA"])).alias("n_hidden"))


@query("T1_top_classes", "with $scores, r as (select *, row_number() over (partition by record_id order by prob desc, class_idx) as place from scores) select record_id, place, class, prob, prob >= 0.5::double as active from r where place <= 5")
def _(spark, sf):
    return S.top_classes(scores(spark, sf), 5, F.col("prob") >= 0.5).select("record_id", "place", "class", "prob", "active")


@query("T2_display_lists", """with $scores, r as (select *, case when class in ('FA', 'OA') then 'research' else 'reportable' end as list from scores),
k as (select *, row_number() over (partition by record_id, list order by prob desc, class_idx) as place from r where list = 'reportable' or prob >= 0.5::double) select record_id, list, place, class from k where place <= case list when 'research' then 1 else 3 end""")
def _(spark, sf):
    kind = F.when(F.col("class").isin("FA", "OA"), "research").otherwise("reportable")
    rows = scores(spark, sf).withColumn("list", kind).where("list = 'reportable' or prob >= 0.5D")
    w = Window.partitionBy("record_id", "list").orderBy(F.desc("prob"), "class_idx")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= case list when 'research' then 1 else 3 end").select("record_id", "list", "place", "class")


@query("T3_rate_considerations", """with $scores, bands as (select * from (values (150, 'FA'), (150, 'FN'), (110, 'FR'), (110, 'FN')) t(band, class)), recs as (select distinct record_id, case when record_id % 200 >= 150 then 150 when record_id % 200 >= 110 then 110 end as band from scores),
r as (select s.record_id, s.class, s.prob, row_number() over (partition by s.record_id order by s.prob desc, s.class_idx) as place from scores s join recs using (record_id) join bands on bands.band = recs.band and bands.class = s.class) select record_id, class, place from r where place <= 4""")
def _(spark, sf):
    bands = spark.createDataFrame([(150, "FA"), (150, "FN"), (110, "FR"), (110, "FN")], "band int, class string")
    rate = F.col("record_id") % 200
    rows = scores(spark, sf).withColumn("band", F.when(rate >= 150, 150).when(rate >= 110, 110)).join(F.broadcast(bands), ["band", "class"])
    return S.top_classes(rows, 4, F.lit(True)).select("record_id", "class", "place")


@query("D24_critical_findings", "with $scores select record_id, class, prob from scores where prob >= 0.9::double and class in ('OA', 'OR')")
def _(spark, sf):
    return scores(spark, sf).where(S.is_critical(F.col("prob") >= 0.9, ["OA", "OR"])).select("record_id", "class", "prob")


@query("A19_agreement_at_cutoffs", f"with $scores, {SQL_PAIRS}, c as (select unnest([1,2,3,4,5,6,7,8,9]) as k), r as (select k, record_id, avg(((a >= k / 10::double) = (b >= k / 10::double))::int::double) as m from pairs, c group by k, record_id) select k, round(avg(m), 6) as agreement from r group by k")
def _(spark, sf):
    cut = F.col("k") / 10.0
    rows = pairs(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9))))
    return rows.groupBy("k", "record_id").agg(F.avg(((F.col("a") >= cut) == (F.col("b") >= cut)).cast("double")).alias("m")).groupBy("k").agg(R(F.avg("m")).alias("agreement"))


@query("A20_retention", f"with $scores, {SQL_PAIRS} select class, count(*) as n_high, count(*) filter (b < 0.5::double) as n_flipped, round(avg((b >= 0.5::double)::int::double), 6) as retention from pairs where a >= 0.7::double group by class")
def _(spark, sf):
    kept = F.col("b") >= 0.5
    return pairs(spark, sf).where("a >= 0.7D").groupBy("class").agg(F.count("*").alias("n_high"), F.count_if(~kept).alias("n_flipped"), R(F.avg(kept.cast("double"))).alias("retention"))


SQL_TIERS = "tiers as (select * from (values ('FA', 'validated'), ('FN', 'validated'), ('OA', 'provisional'), ('ON', 'provisional')) t(class, tier))"


def tiers(spark):
    return spark.createDataFrame([("FA", "validated"), ("FN", "validated"), ("OA", "provisional"), ("ON", "provisional")], "class string, tier string")


@query("A23_metrics_by_tier", f"""with $scores, {SQL_TIERS}, {sql_ranking('rk', 'scores', 'class')} select coalesce(tier, 'research_only') as tier, count(*) as n_classes, round(avg(auroc), 6) as macro_auroc, string_agg(class, ',' order by class) as classes from rk left join tiers using (class) group by 1""")
def _(spark, sf):
    rk = M.ranking(scores(spark, sf), ["class"]).join(F.broadcast(tiers(spark)), "class", "left")
    return rk.groupBy(F.coalesce("tier", F.lit("research_only")).alias("tier")).agg(F.count("*").alias("n_classes"), R(F.avg("auroc")).alias("macro_auroc"), F.array_join(F.sort_array(F.collect_list("class")), ",").alias("classes"))


@query("A24_tier_counts", f"with $scores, {SQL_TIERS}, c as (select distinct class from scores) select coalesce(tier, 'research_only') as tier, count(*) as n, string_agg(class, ',' order by class) filter (tier = 'validated') as validated from c left join tiers using (class) group by 1")
def _(spark, sf):
    c = scores(spark, sf).select("class").distinct().join(F.broadcast(tiers(spark)), "class", "left").withColumn("tier", F.coalesce("tier", F.lit("research_only")))
    return c.groupBy("tier").agg(F.count("*").alias("n"), F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(F.col("tier") == "validated", F.col("class")))), ","), F.lit("")).alias("validated"))


SQL_DELTAS = f"with $scores, {sql_ranking('ra', 'scores', 'class')}, {sql_ranking('rb', 'scores_b', 'class')}, d as (select class, rb.auroc - ra.auroc as delta from ra join rb using (class))"


def deltas(spark, sf):
    a, b = M.ranking(scores(spark, sf), ["class"]), M.ranking(scores_b(spark, sf), ["class"])
    return a.select("class", F.col("auroc").alias("a")).join(b.select("class", F.col("auroc").alias("b")), "class").select("class", (F.col("b") - F.col("a")).alias("delta"))


@query("A25_regressed_classes", SQL_DELTAS + " select class, round(delta, 6) as delta from d where delta < -0.01::double")
def _(spark, sf):
    return rounded(deltas(spark, sf).where("delta < -0.01D"), "delta")


@query("T5_largest_changes", SQL_DELTAS + ", g as (select 'worst' as kind, class, delta from d order by delta, class limit 2), h as (select 'best' as kind, class, delta from d order by delta desc, class limit 2) select kind, class, round(delta, 6) as delta from (select * from g union all select * from h)")
def _(spark, sf):
    d = deltas(spark, sf)
    worst = d.orderBy("delta", "class").limit(2).select(F.lit("worst").alias("kind"), "class", "delta")
    return rounded(worst.unionByName(d.orderBy(F.desc("delta"), "class").limit(2).select(F.lit("best").alias("kind"), "class", "delta")), "delta")


@query("T6_best_head", f"with $scores, {sql_ranking('rk', 'scores', 'class')} select class, place, round(average_precision, 6) as average_precision from (select *, row_number() over (order by average_precision desc, class) as place from rk)")
def _(spark, sf):
    # one row for each class
    return rounded(M.ranking(scores(spark, sf), ["class"]).withColumn("place", F.row_number().over(Window.orderBy(F.desc("average_precision"), "class"))).select("class", "place", "average_precision"), "average_precision")


@query("A26_matrix_statistics", "with $scores select round(avg(prob), 6) as mean, round(stddev_pop(prob), 6) as sd, max(prob) as hi, min(prob) as lo from scores")
def _(spark, sf):
    return scores(spark, sf).agg(R(F.avg("prob")).alias("mean"), R(F.stddev_pop("prob")).alias("sd"), F.max("prob").alias("hi"), F.min("prob").alias("lo"))


@query("F1_logit", "with $scores select record_id, class_idx, round(ln(least(greatest(prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(prob, 1e-6), 1 - 1e-6))), 6) as logit from scores")
def _(spark, sf):
    return scores(spark, sf).select("record_id", "class_idx", R(S.logit(F.col("prob"))).alias("logit"))


@query("F2_platt", "with $scores, cal as (select * from (values ('FA', 1.5::double, -0.2::double), ('ON', 0.8::double, 0.1::double)) t(class, slope, intercept)), l as (select *, least(greatest(prob, 1e-6), 1 - 1e-6) as c from scores left join cal using (class)) select record_id, class_idx, round(case when slope is null then prob else 1 / (1 + exp(-(slope * ln(c / (1 - c)) + intercept))) end, 6) as prob from l")
def _(spark, sf):
    cal = spark.createDataFrame([("FA", 1.5, -0.2), ("ON", 0.8, 0.1)], "class string, slope double, intercept double")
    return scores(spark, sf).join(F.broadcast(cal), "class", "left").select("record_id", "class_idx", R(S.platt()).alias("prob"))


@query("J12_calibration_lookup", "with $scores, cal as (select * from (values ('FA', 0.31::double, 'validated'), ('ON', null, 'provisional')) t(class, threshold, tier)), c as (select distinct class from scores) select class, coalesce(threshold, 0.5::double) as threshold, coalesce(tier, 'research_only') as tier from c left join cal using (class)")
def _(spark, sf):
    cal = spark.createDataFrame([("FA", 0.31, "validated"), ("ON", None, "provisional")], "class string, threshold double, tier string")
    return S.with_calibration(scores(spark, sf).select("class").distinct(), cal, 0.5).select("class", "threshold", "tier")


@query("W32_combine_views", "with $scores, v as (select record_id, class, prob from scores union all select record_id, class, prob from scores_b) select record_id, class, round(avg(prob), 6) as mean, max(prob) as hi from v group by 1, 2")
def _(spark, sf):
    return S.combine_views(both_views(spark, sf), ["record_id", "class"]).select("record_id", "class", R("mean").alias("mean"), "hi")


@query("L3_consistency_penalty", "with $scores, p as (select a.class, ln(least(greatest(a.prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(a.prob, 1e-6), 1 - 1e-6))) as clean, ln(least(greatest(b.prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(b.prob, 1e-6), 1 - 1e-6))) as dig, case when a.record_id % 3 = 0 then 0.5::double end as teacher from scores a join scores_b b on a.record_id = b.record_id and a.class_idx = b.class_idx) select class, round(avg(pow(coalesce(teacher, clean) - dig, 2)), 6) as penalty from p group by class")
def _(spark, sf):
    p = pairs(spark, sf).select("class", S.logit(F.col("a")).alias("clean"), S.logit(F.col("b")).alias("digitised"), F.when(F.col("record_id") % 3 == 0, 0.5).alias("teacher"))
    return p.groupBy("class").agg(R(S.consistency_penalty()).alias("penalty"))


@query("L4_masked_loss", "with $scores, l as (select class, case when record_id % 7 = 0 then null else y end as y, ln(least(greatest(prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(prob, 1e-6), 1 - 1e-6))) as z from scores) select class, round(avg(case when y = 1 then 3 * (ln(1 + exp(-abs(z))) + greatest(-z, 0)) when y = 0 then ln(1 + exp(-abs(z))) + greatest(z, 0) end), 6) as loss from l group by class")
def _(spark, sf):
    rows = scores(spark, sf).select("class", F.when(F.col("record_id") % 7 != 0, F.col("y")).alias("y"), S.logit(F.col("prob")).alias("z"), F.lit(3.0).alias("w"))
    return rows.groupBy("class").agg(R(S.masked_loss()).alias("loss"))
