"""Queries that sample, split, weigh and guard cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import metrics as M
from . import decisions  # noqa: F401  (its proxies)
from .evaluation import rounded
from .proxies import audit, audit_b, doc_scores, read, scores
from .registry import query

ONE = "one as (select record_id, patient_id, y, prob from scores where class = 'FR')"


def one(spark, sf):
    return scores(spark, sf).where("class = 'FR'").select("record_id", "patient_id", "y", "prob")


@query("P1_select_fold", f"with $scores, {ONE}, f as (select *, record_id % 10 as fold from one) select 'holdout' as part, count(*) as n from f where fold = 9 union all select 'rest', count(*) from f where fold <> 9")
def _(spark, sf):
    f = one(spark, sf).withColumn("fold", F.col("record_id") % 10)
    part = lambda name, hold: C.select_fold(f, 9, hold).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return part("holdout", True).unionByName(part("rest", False))


@query("P2_select_split", "with $audit select category, count(*) as n from audit where image_id % 3 = 0 group by category")
def _(spark, sf):
    s = audit(spark, sf).withColumn("split", F.when(F.col("image_id") % 3 == 0, "tune").otherwise("test"))
    return C.select_split(s, "tune").groupBy("category").agg(F.count("*").alias("n"))


@query("P3_request_guard", """with r as (select o_orderkey as id, (['development-baseline', 'threshold-tuning', 'locked-evaluation'])[o_orderkey % 3 + 1] as purpose, (['development', 'holdout', 'external'])[o_orderkey // 3 % 3 + 1] as stage, ([null, 'tune', 'test'])[o_orderkey // 9 % 3 + 1] as split, o_orderkey // 27 % 2 = 0 as has_manifest, ([null, 'pre-registered'])[o_orderkey // 54 % 2 + 1] as evidence from orders)
select id, (purpose = 'development-baseline' and stage = 'development' and not has_manifest and split is null) or (purpose = 'threshold-tuning' and stage = 'development' and has_manifest and split is not distinct from 'tune') or (purpose = 'locked-evaluation' and ((stage = 'holdout' and has_manifest and split is not distinct from 'test' and evidence is not distinct from 'pre-registered') or (stage = 'external' and not has_manifest and split is null))) as safe from r""")
def _(spark, sf):
    k = F.col("o_orderkey")
    at = lambda d, n, *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(k / d) % n + 1).cast("int"))
    r = read(spark, sf, "orders").select(k.alias("id"), at(1, 3, "development-baseline", "threshold-tuning", "locked-evaluation").alias("purpose"), at(3, 3, "development", "holdout", "external").alias("stage"), at(9, 3, None, "tune", "test").alias("split"), (F.floor(k / 27) % 2 == 0).alias("has_manifest"), at(54, 2, None, "pre-registered").alias("evidence"))
    return r.select("id", C.request_is_safe().alias("safe"))


@query("P11_label_matrix", "with $scores select record_id, array_to_string(list(y order by class_idx), '') as labels from scores group by record_id")
def _(spark, sf):
    wide = scores(spark, sf).groupBy("record_id").pivot("class", ["FA", "FN", "FR", "OA", "ON", "OR"]).agg(F.first("y"))
    return wide.select("record_id", F.concat_ws("", *[F.col(c).cast("string") for c in ("FA", "FN", "FR", "OA", "ON", "OR")]).alias("labels"))


@query("P12_auxiliary_targets", "with $scores select record_id, max(y) filter (class in ('FA', 'FN', 'FR')) as any_f, max(y) filter (class in ('OA', 'ON', 'OR')) as any_o from scores group by record_id")
def _(spark, sf):
    wide = scores(spark, sf).groupBy("record_id").pivot("class", ["FA", "FN", "FR", "OA", "ON", "OR"]).agg(F.first("y"))
    return wide.select("record_id", (F.greatest("FA", "FN", "FR") > 0).cast("int").alias("any_f"), (F.greatest("OA", "ON", "OR") > 0).cast("int").alias("any_o"))


# joins


@query("J1_three_way_join", """with m as (select o_orderkey as id, 'f' || (o_orderkey % 5000) as file from orders), l as (select distinct 'f' || (o_orderkey % 5000) as file, o_orderkey % 7 = 0 as flag, o_orderkey as k from orders where o_orderkey % 2 = 0)
select count(*) as n_matched, (select count(*) from m) - count(distinct m.id) as n_unmatched, count(*) filter (l.flag) as n_flagged from m join l on l.file = m.file and l.k = m.id""")
def _(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    file = F.concat(F.lit("f"), (F.col("id") % 5000).cast("string"))
    metadata = o.withColumn("file", file)
    labels = o.where("id % 2 = 0").select("id", file.alias("file"), (F.col("id") % 7 == 0).alias("flag"))
    left = metadata.join(labels, ["id", "file"], "left")
    return left.agg(F.count("flag").alias("n_matched"), F.count_if(F.col("flag").isNull()).alias("n_unmatched"), F.count_if(F.col("flag")).alias("n_flagged"))


@query("J2_left_join_guard", "select count(*) as n_documents, count(l.doc_id) as n_labelled, count(*) filter (l.doc_id is null) as n_without from documents d left join labels l using (doc_id)")
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return d.agg(F.count("*").alias("n_documents"), F.count("has").alias("n_labelled"), F.count_if(F.col("has").isNull()).alias("n_without"))


@query("J4_key_equality", "with $audit, a as (select image_id, md5(category) as d from audit where image_id % 50 <> 0), b as (select image_id, md5(case when image_id % 41 = 0 then 'x' else category end) as d from audit where image_id % 60 <> 0) select image_id, a.d as da, b.d as db from a full join b using (image_id) where a.d is null or b.d is null or a.d <> b.d")
def _(spark, sf):
    a = audit(spark, sf)
    x = a.where("image_id % 50 <> 0").select("image_id", F.md5("category").alias("d"))
    y = a.where("image_id % 60 <> 0").select("image_id", F.md5(F.when(F.col("image_id") % 41 == 0, "x").otherwise(F.col("category"))).alias("d"))
    return C.paired_keys(x, y, ["image_id"], "d")


@query("J5_anti_join", "select count(*) as n from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(spark, sf):
    used = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").join(used, "c_custkey", "left_anti").agg(F.count("*").alias("n"))


@query("J6_pending", "select p_partkey from part where p_partkey % 2 = 0 and p_partkey not in (select l_partkey from lineitem where l_quantity > 49) and p_partkey % 14 <> 0")
def _(spark, sf):
    want = read(spark, sf, "part").where("p_partkey % 2 = 0").select("p_partkey")
    done = read(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return C.pending(want, done, read(spark, sf, "part").where("p_partkey % 14 = 0").select("p_partkey"), "p_partkey")


@query("J7_pinned_cohort", "select count(*) as n, count(distinct o_custkey) as n_patients from orders where o_custkey in (select c_custkey from customer where c_custkey % 3 = 0) and o_orderkey % 10 in (8, 9)")
def _(spark, sf):
    pinned = read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = read(spark, sf, "orders").join(pinned, "o_custkey", "left_semi").where((F.col("o_orderkey") % 10).isin(8, 9))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_patients"))


@query("J8_exact_lock", "select s_suppkey, s_suppkey % 2 as split from supplier where s_suppkey % 4 = 0")
def _(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey")
    return C.exact_lock(s, s.where("s_suppkey % 4 = 0").withColumn("split", F.col("s_suppkey") % 2), "s_suppkey")


@query("J9_layout_lookup", "with $audit, l as (select distinct category, case when category < '3' then '3x4' else '6x2' end as layout from audit) select layout, count(*) as n from audit join l using (category) group by layout")
def _(spark, sf):
    a = audit(spark, sf)
    lookup = a.select("category").distinct().withColumn("fold", F.when(F.col("category") < "3", "3x4").otherwise("6x2"))
    return C.with_fold(a, F.broadcast(lookup), "category").groupBy(F.col("fold").alias("layout")).agg(F.count("*").alias("n"))


@query("J10_split_lookup", "with $audit select category, count(*) as n from audit where group_id % 5 = 0 group by category")
def _(spark, sf):
    a = audit(spark, sf)
    splits = a.select("group_id").distinct().withColumn("fold", F.when(F.col("group_id") % 5 == 0, "test").otherwise("tune"))
    return C.with_fold(a, splits, "group_id").where("fold = 'test'").groupBy("category").agg(F.count("*").alias("n"))


@query("J11_code_map", """with m as (select * from (values ('view', 0), ('click', 1), ('purchase', 1), ('scroll', 2)) t(code, class_idx)), e as (select distinct user_id, event_type as code from events), h as (select distinct user_id, class_idx from e join m using (code)), u as (select distinct user_id from events), c as (select distinct class_idx from m)
select u.user_id, c.class_idx, case when h.user_id is null then 0 else 1 end as y from u cross join c left join h on h.user_id = u.user_id and h.class_idx = c.class_idx""")
def _(spark, sf):
    from ..operators.tables import code_labels

    codes = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("codes"))
    return code_labels(codes, "user_id", {"view": 0, "click": 1, "purchase": 1, "scroll": 2})


@query("J14_labelled_pairs", "select count(*) filter (l.doc_id is not null) as n_labelled, count(*) filter (l.doc_id is null) as n_dropped, count(distinct d.source) filter (l.doc_id is not null) as n_sources from documents d left join labels l using (doc_id)")
def _(spark, sf):
    d, lab = read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels").select("doc_id")
    kept = d.join(lab, "doc_id").agg(F.count("*").alias("n_labelled"), F.countDistinct("source").alias("n_sources"))
    return kept.crossJoin(d.join(lab, "doc_id", "left_anti").agg(F.count("*").alias("n_dropped")))  # one row each


# splits and samples

SHARES = {"train": 0.6, "tune": 0.2, "test": 0.2}
SQL_SPLIT = """$audit, pairs as (select distinct group_id, category from audit), often as (select category, count(*) as often from pairs group by category),
g as (select group_id, list_sort(list({'often': often, 'category': category})) as held from pairs join often using (category) group by group_id),
o as (select group_id, row_number() over (order by array_to_string(list_transform(held, lambda c: lpad(c.often::varchar, 19, '0') || ':' || c.category), '+'), md5('42|' || group_id::varchar), group_id)::hugeint as p, count(*) over () as total from g),
t as (select *, 0.6::double * total as e1, 0.2::double * total as e2 from o),
n as (select *, total - floor(e1) - 2 * floor(e2) as spare, round(e1 - floor(e1), 9) as r1, round(e2 - floor(e2), 9) as r2 from t),
k as (select *, (floor(e1) + case when (case when r2 > r1 then 2 else 0 end) < spare then 1 else 0 end)::hugeint as n1, (floor(e2) + case when (case when r1 >= r2 then 1 else 0 end) < spare then 1 else 0 end)::hugeint as n2 from n),
d as (select *, (p * n1) // total as t1, ((p - 1) * n1) // total as t0, total - n1 as left_ from k),
splits as (select group_id, case when t1 > t0 then 'train' when ((p - t1) * n2) // left_ > ((p - t1 - 1) * n2) // left_ then 'tune' else 'test' end as split from d)"""


def splits(spark, sf):
    return C.grouped_split(audit(spark, sf), "group_id", "category", SHARES)


@query("G2_grouped_split", f"with {SQL_SPLIT} select group_id, split from splits".replace("$audit", "$audit"))
def _(spark, sf):
    return splits(spark, sf)


@query("G1_allocation", "with s as (select o_custkey, count(*) as total from orders group by 1), q as (select *, floor(total * 0.6::double) as f1, floor(total * 0.2::double) as f2, round(total * 0.6::double - floor(total * 0.6::double), 9) as r1, round(total * 0.2::double - floor(total * 0.2::double), 9) as r2 from s), k as (select *, total - f1 - 2 * f2 as rest, case when r2 > r1 then 2 else 0 end as p1, case when r1 >= r2 then 1 else 0 end as p2, case when r1 >= r2 then 2 else 1 end as p3 from q) select o_custkey, cast(f1 + case when p1 < rest then 1 else 0 end as bigint) as train, cast(f2 + case when p2 < rest then 1 else 0 end as bigint) as tune, cast(f2 + case when p3 < rest then 1 else 0 end as bigint) as test from k")
def _(spark, sf):
    sizes = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"))
    return sizes.select("o_custkey", *[c.alias(k) for k, c in C.allocate_groups(F.col("total"), SHARES).items()])


@query("G3_split_leakage", f"with {SQL_SPLIT}, r as (select group_id, case when group_id % 100 = 0 and image_id % 2 = 0 then 'test' else split end as split from audit join splits using (group_id)) select group_id, count(distinct split) as n_splits from r group by group_id having count(distinct split) > 1")
def _(spark, sf):
    r = audit(spark, sf).join(splits(spark, sf), "group_id").withColumn("split", F.when((F.col("group_id") % 100 == 0) & (F.col("image_id") % 2 == 0), "test").otherwise(F.col("split")))
    return C.split_leaks(r, "group_id")


@query("A14_split_summary", f"with {SQL_SPLIT} select split, category, count(*) as n_records, count(distinct group_id) as n_groups from audit join splits using (group_id) group by split, category")
def _(spark, sf):
    return audit(spark, sf).join(splits(spark, sf), "group_id").groupBy("split", "category").agg(F.count("*").alias("n_records"), F.countDistinct("group_id").alias("n_groups"))


SQL_FOLDS = f"$scores, {ONE}, pp as (select patient_id, sum(y) as positives, count(*) as n from one group by patient_id), st as (select *, (row_number() over (partition by positives order by md5('42|' || patient_id::varchar), patient_id) - 1) % 10 as step from pp), folds as (select patient_id, positives, n, cast(case when step < 5 then step else 9 - step end as int) as fold from st)"


def folds(spark, sf):
    return C.group_folds(one(spark, sf), "patient_id", 5)


@query("G4_group_folds", f"with {SQL_FOLDS} select patient_id, fold from folds")
def _(spark, sf):
    return folds(spark, sf).select("patient_id", "fold")


@query("G5_leakage_proof", f"with {SQL_FOLDS}, r as (select o.patient_id, fold from one o join folds using (patient_id)) select count(*) as n_records, count(distinct patient_id) as n_patients, (select count(*) from (select patient_id from r group by patient_id having count(distinct fold) > 1)) as n_leaks from r")
def _(spark, sf):
    r = one(spark, sf).join(folds(spark, sf).select("patient_id", "fold"), "patient_id")
    leaks = C.split_leaks(r, "patient_id", "fold").agg(F.count("*").alias("n_leaks"))
    return r.agg(F.count("*").alias("n_records"), F.countDistinct("patient_id").alias("n_patients")).crossJoin(leaks)  # one row each


@query("A15_fold_summary", f"with {SQL_FOLDS} select fold, count(*) as records, count(distinct o.patient_id) as groups, cast(sum(y) as bigint) as positives, round(avg(y), 6) as rate from one o join folds using (patient_id) group by fold")
def _(spark, sf):
    return rounded(C.fold_summary(one(spark, sf).join(folds(spark, sf).select("patient_id", "fold"), "patient_id"), "patient_id"), "rate")


SQL_HOLD = "$audit, o as (select image_id, category, row_number() over (order by category nulls first, md5('42|' || image_id::varchar), image_id)::hugeint as p, count(*) over () as total from audit), h as (select *, round_even(total * 0.25::double, 0)::hugeint as n from o), hold as (select image_id, category, case when (p * n) // total > ((p - 1) * n) // total then 'test' else 'tune' end as split from h)"


@query("G6_layout_holdout", f"with {SQL_HOLD} select image_id, split from hold")
def _(spark, sf):
    return C.proportional_holdout(audit(spark, sf), "category", "image_id", 0.25).select("image_id", "split")


@query("A16_holdout_summary", f"with {SQL_HOLD} select split, category, count(*) as n from hold group by all")
def _(spark, sf):
    return C.proportional_holdout(audit(spark, sf), "category", "image_id", 0.25).groupBy("split", "category").agg(F.count("*").alias("n"))


@query("G7_priority_sampling", """with c as (select user_id, list_distinct(list(event_type)) as codes from events group by user_id), r1 as (select user_id, 'buyers' as rule from c where list_contains(codes, 'purchase') order by md5('42|' || user_id::varchar), user_id limit 20),
r2 as (select user_id, 'active' as rule from c where len(codes) >= 4 and user_id not in (select user_id from r1) order by md5('42|' || user_id::varchar), user_id limit 30), r3 as (select user_id, 'rest' as rule from c where user_id not in (select user_id from r1) and user_id not in (select user_id from r2) order by md5('42|' || user_id::varchar), user_id limit 10)
select * from (select * from r1 union all select * from r2 union all select * from r3)""")
def _(spark, sf):
    codes = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("codes"))
    return C.priority_sample(codes, "user_id", [("buyers", F.array_contains("codes", "purchase"), 20), ("active", F.size("codes") >= 4, 30), ("rest", F.lit(True), 10)])


@query("G8_quality_strata", "with $audit, e as (select quantile_cont(layout_cost, [0.25, 0.5, 0.75]) as q from audit), s as (select a.*, 1 + len(list_filter(list_distinct(q), lambda x: layout_cost > x)) as b from audit a, e) select (['q1', 'q2', 'q3', 'q4'])[b] as stratum, count(*) as n, min(layout_cost) as lo, max(layout_cost) as hi from s group by 1")
def _(spark, sf):
    return C.quantile_strata(audit(spark, sf), "layout_cost", ["q1", "q2", "q3", "q4"]).groupBy("stratum").agg(F.count("*").alias("n"), F.min("layout_cost").alias("lo"), F.max("layout_cost").alias("hi"))


@query("M16_stratum_damage", """with $scores, p as (select a.record_id, a.class, a.y, a.prob as a, b.prob as b, case when a.record_id % 100 > 60 then 'poor' else 'fine' end as stratum from scores a join scores_b b on a.record_id = b.record_id and a.class_idx = b.class_idx),
r as (select record_id, class, y, a, b, unnest([stratum, 'all']) as stratum from p) select stratum, class, count(*) as n, round(avg(abs(b - a)), 6) as mean_abs, round(quantile_cont(abs(b - a), 0.5), 6) as median_abs, round(avg(b - a), 6) as shift, round(corr(a, b), 6) as correlation, round(count(*) filter (a >= 0.5::double and y = 1)::double / count(*) filter (y = 1), 6) as sensitivity_a, round(count(*) filter (b >= 0.5::double and y = 1)::double / count(*) filter (y = 1), 6) as sensitivity_b from r group by stratum, class""")
def _(spark, sf):
    from .evaluation import pairs

    d, y = F.col("b") - F.col("a"), F.col("y") == 1
    r = pairs(spark, sf).withColumn("stratum", F.explode(F.array(F.when(F.col("record_id") % 100 > 60, "poor").otherwise("fine"), F.lit("all"))))
    hit = lambda c: F.try_divide(F.count_if((F.col(c) >= 0.5) & y).cast("double"), F.count_if(y))
    out = r.groupBy("stratum", "class").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mean_abs"), F.percentile(F.abs(d), 0.5).alias("median_abs"), F.avg(d).alias("shift"), M.correlation(F.col("a"), F.col("b")).alias("correlation"), hit("a").alias("sensitivity_a"), hit("b").alias("sensitivity_b"))
    return rounded(out, *out.columns[3:])


SQL_CASE = f"$scores, {ONE}, quota as (select cast(round_even(sum(y) * 0.5::double, 0) as bigint) as quota from one), neg as (select *, row_number() over (order by md5('42|' || record_id::varchar), record_id) as place from one where y = 0)"


@query("G9_case_control", f"with {SQL_CASE} select record_id, y from one where y = 1 union all select record_id, y from neg, quota where place <= quota")
def _(spark, sf):
    return C.case_control(one(spark, sf), "record_id", 0.5).select("record_id", "y")


@query("U4_union_sample", f"with {SQL_CASE}, u as (select record_id, y from one where y = 1 union all select record_id, y from neg, quota where place <= quota) select y, count(*) as n from u group by y")
def _(spark, sf):
    return C.case_control(one(spark, sf), "record_id", 0.5).groupBy("y").agg(F.count("*").alias("n"))


SQL_ALL4 = "k as (select user_id from events group by user_id having count(distinct event_type) = 5)"


@query("U1_in_all_categories", f"with {SQL_ALL4} select user_id from k")
def _(spark, sf):
    return C.in_all(read(spark, sf, "events"), "user_id", "event_type", 5)


@query("G10_balanced_pick", f"with {SQL_ALL4} select user_id from k order by case when user_id in (1, 2, 3) then 0 else 1 end, md5('42|' || user_id::varchar), user_id limit 25")
def _(spark, sf):
    return C.balanced_pick(read(spark, sf, "events"), "user_id", "event_type", 5, [1, 2, 3], 25)


@query("G11_class_weights", "with $scores, c as (select class, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from scores where prob > 0.6::double group by class) select class, pos, neg, round(case when pos >= 10 then least(neg::double / pos, 50) end, 6) as weight from c")
def _(spark, sf):
    return rounded(C.class_weights(scores(spark, sf).where("prob > 0.6D")), "weight")


@query("G11_subgroup_weights", "with $doc_scores select source, count(*) as n, sum(case when y = 1 and quality = 1 then 4 else 1 end)::double as weight from doc_scores group by source")
def _(spark, sf):
    d = doc_scores(spark, sf).withColumn("w", C.subgroup_weight(F.col("y"), F.col("quality"), 4.0))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("w").alias("weight"))


@query("G11_masked_labels", "with $scores, c as (select class, count(*) filter (y = 1) as pos from scores group by class) select class, count(*) as n, count(case when pos >= 500 then y end) as n_labelled from scores join c using (class) group by class")
def _(spark, sf):
    s = scores(spark, sf)
    kept = C.masked_labels(s, C.class_weights(s, least=500))
    return kept.groupBy("class").agg(F.count("*").alias("n"), F.count("y").alias("n_labelled"))


@query("U2_complete_groups", "with $audit, g as (select group_id from audit group by group_id having count(distinct category) = 5) select category, count(*) as n, count(distinct group_id) as n_groups from audit where group_id in (select group_id from g) group by category")
def _(spark, sf):
    a = audit(spark, sf)
    whole = a.join(C.in_all(a, "group_id", "category", 5), "group_id", "left_semi")
    return whole.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("n_groups"))


@query("U3_missing_pairs", "with $audit, w as (select g.group_id, c.category from (select distinct group_id from audit) g, (select distinct category from audit) c) select group_id, category from w except select group_id, category from audit")
def _(spark, sf):
    return C.missing_pairs(audit(spark, sf), "group_id", "category", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("U5_append_manifest", "with $audit, u as (select image_id, category, null as note from audit where image_id % 2 = 0 union all select image_id, category, 'new' from audit where image_id % 7 = 1) select note, count(*) as n from u group by note")
def _(spark, sf):
    a = audit(spark, sf).select("image_id", "category")
    both = a.where("image_id % 2 = 0").unionByName(a.where("image_id % 7 = 1").withColumn("note", F.lit("new")), allowMissingColumns=True)
    return both.groupBy("note").agg(F.count("*").alias("n"))


@query("U6_one_per_entity", f"with $scores, {ONE} select patient_id, record_id from (select *, row_number() over (partition by patient_id order by md5('42|' || record_id::varchar), record_id) as p from one) where p = 1")
def _(spark, sf):
    return C.one_per_entity(one(spark, sf), "patient_id", "record_id").select("patient_id", "record_id")


@query("U7_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(spark, sf):
    return C.duplicate_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("T4_cases_and_controls", "with $audit, f as (select image_id, 'failure' as role from audit where group_id % 50 = 0 and status = 'failed'), c as (select image_id, 'control' as role from audit where status = 'success' and raw_lines_count in (3, 6) and median_correlation is not null order by median_correlation desc, image_id limit 20) select * from f union all select * from c")
def _(spark, sf):
    from ..operators.tables import cases_and_controls

    a = audit(spark, sf)
    keys = a.where("group_id % 50 = 0 and status = 'failed'").select("image_id")
    return cases_and_controls(a, keys, "image_id", a.where((F.col("status") == "success") & F.col("raw_lines_count").isin(3, 6) & F.col("median_correlation").isNotNull()), "median_correlation", 20)


@query("T7_stable_head", "with $audit select category, image_id, elapsed_seconds from audit order by elapsed_seconds desc, category, image_id limit 40")
def _(spark, sf):
    return audit(spark, sf).select("category", "image_id", "elapsed_seconds").orderBy(F.desc("elapsed_seconds"), "category", "image_id").limit(40)


@query("A22_separation_margin", "with $gated, r as (select category, case target when 'reject' then 'failure' when 'accept' then 'control' end as role, einthoven_score as m from gated where target <> 'warn') select category, min(m) filter (role = 'control') as control_min, max(m) filter (role = 'failure') as failure_max, round(min(m) filter (role = 'control') - max(m) filter (role = 'failure'), 6) as margin from r group by category")
def _(spark, sf):
    from .decisions import gated

    r = gated(spark, sf)
    low, high = F.min(F.when(F.col("target") == "accept", F.col("einthoven_score"))), F.max(F.when(F.col("target") == "reject", F.col("einthoven_score")))
    return r.where("target <> 'warn'").groupBy("category").agg(low.alias("control_min"), high.alias("failure_max"), F.round(low - high, 6).alias("margin"))


@query("A21_worst_case", "with $audit, p as (select image_id, unnest(['shift', 'scale', 'blur']) as probe, unnest([layout_cost, median_rmse_mv * 3, (median_snr_db + 1) / 9]) as m from audit) select image_id, arg_min(probe, struct_pack(m := round(m, 9), probe := probe)) as worst_probe, round(min(m), 6) as lo, round(max(m), 6) as hi from p group by image_id")
def _(spark, sf):
    p = audit(spark, sf).select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), c.alias("m")) for k, c in (("shift", F.col("layout_cost")), ("scale", F.col("median_rmse_mv") * 3), ("blur", (F.col("median_snr_db") + 1) / 9))])).alias("p")).select("image_id", "p.*")
    return p.groupBy("image_id").agg(F.min_by("probe", F.struct(F.round("m", 9), "probe")).alias("worst_probe"), F.round(F.min("m"), 6).alias("lo"), F.round(F.max("m"), 6).alias("hi"))


SQL_VEC = "v as (select a.category, m.method, abs((a.image_id * m.f % 100) / 100::double - 0.3::double) as cosine, (a.image_id * m.f % 37) / 37::double as diff from audit a, (values ('tiled', 31), ('segment', 53)) m(method, f) where a.status = 'success')"


@query("A5_drift_aggregate", f"with $audit, {SQL_VEC} select method, coalesce(category, 'overall') as category, count(*) as n, round(avg(cosine), 6) as mean_cosine, round(quantile_cont(cosine, 0.5), 6) as median_cosine, round(avg(diff), 6) as mean_diff from v group by grouping sets ((method, category), (method))")
def _(spark, sf):
    methods = F.explode(F.array(F.struct(F.lit("tiled").alias("method"), F.lit(31).alias("f")), F.struct(F.lit("segment").alias("method"), F.lit(53).alias("f"))))
    v = audit(spark, sf).where("status = 'success'").withColumn("m", methods).select("category", "m.method", F.abs((F.col("image_id") * F.col("m.f") % 100) / 100.0 - 0.3).alias("cosine"), ((F.col("image_id") * F.col("m.f") % 37) / 37.0).alias("diff"))
    each = v.withColumn("category", F.explode(F.array("category", F.lit("overall"))))
    return rounded(each.groupBy("method", "category").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean_cosine"), F.percentile("cosine", 0.5).alias("median_cosine"), F.avg("diff").alias("mean_diff")), "mean_cosine", "median_cosine", "mean_diff")


SQL_RATE = "$audit, e as (select category, abs((image_id * 31 % 97) - (image_id * 17 % 89))::double / 2 as err from audit)"


def _errors(spark, sf):
    k = F.col("image_id")
    return audit(spark, sf).select("category", (F.abs((k * 31 % 97) - (k * 17 % 89)).cast("double") / 2).alias("err"))


@query("A17_rate_errors", f"with {SQL_RATE} select category, count(*) as n, round_even(quantile_cont(err, 0.5), 2) as median_error, round_even(avg(err), 2) as mean_error, round_even(avg((err > 20)::int::double), 4) as over_20, round_even(avg((err <= 5)::int::double), 4) as within_5 from e group by category")
def _(spark, sf):
    from ..operators.tables import error_statistics

    return _errors(spark, sf).groupBy("category").agg(*error_statistics(F.col("err")))


@query("A18_paired_rate_drift", "with $audit, e as (select category, abs(elapsed_seconds - b.es)::double as d from audit join (select image_id as bid, elapsed_seconds as es from audit_b) b on b.bid = image_id) select category, round(avg((round(d, 9) <= 5)::int::double), 6) as within_5, round(avg((round(d, 9) > 20)::int::double), 6) as over_20, round(quantile_cont(d, 0.5), 6) as median_drift, round(max(d), 6) as max_drift from e group by category")
def _(spark, sf):
    b = audit_b(spark, sf).select("image_id", F.col("elapsed_seconds").alias("es"))
    d = audit(spark, sf).join(b, "image_id").withColumn("d", F.abs(F.col("elapsed_seconds") - F.col("es")))
    out = d.groupBy("category").agg(F.avg((F.round("d", 9) <= 5).cast("double")).alias("within_5"), F.avg((F.round("d", 9) > 20).cast("double")).alias("over_20"), F.percentile("d", 0.5).alias("median_drift"), F.max("d").alias("max_drift"))
    return rounded(out, *out.columns[1:])


@query("L5_early_stop", "with h as (select l_suppkey as run, l_linenumber * 10 + row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey, l_partkey, l_extendedprice) as epoch, l_extendedprice as score from lineitem qualify row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey, l_partkey, l_extendedprice) <= 5), m as (select *, max(score) over (partition by run order by epoch) as best from h), e as (select *, max(case when score = best then epoch end) over (partition by run order by epoch) as best_epoch, row_number() over (partition by run order by epoch) as step from m), b as (select *, step - max(case when epoch = best_epoch then step end) over (partition by run order by epoch) as since from e), s as (select run, min(step) as stop from b where since >= 6 group by run) select run, arg_max(epoch, struct_pack(score := score, e := -epoch)) as best_epoch, max(score) as best_score, count(*) as n_epochs from b left join s using (run) where stop is null or step <= stop group by run")
def _(spark, sf):
    from pyspark.sql.window import Window

    from ..operators.tables import early_stop

    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice")
    h = read(spark, sf, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 5").select(F.col("l_suppkey").alias("run"), (F.col("l_linenumber") * 10 + F.col("k")).cast("long").alias("epoch"), F.col("l_extendedprice").alias("score"))
    return early_stop(h, "run", 6)
