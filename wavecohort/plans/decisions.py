"""Queries that apply decision rules and aggregate audit records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as U
from ..operators import scoring as S
from .evaluation import rounded
from .proxies import audit, audit_b, scores
from .registry import PROXIES, query

SQL_GATE = """select *, case when status <> 'success' then ['digitization_failed'] when len(broken) > 0 then ['invalid_features'] when len(critical) > 0 then critical when len(severe) >= 2 then severe else mild end as codes,
  case when status <> 'success' or len(broken) > 0 or len(critical) > 0 or len(severe) >= 2 then 'reject' when len(mild) > 0 then 'warn' else 'accept' end as prediction
  from (select *, list_filter([case when layout_cost is null or layout_cost < 0 or layout_cost > 100 then 'layout_cost' end, case when detected_leads_count is null or detected_leads_count < 0 or detected_leads_count > 12 then 'detected_leads_count' end,
  case when nonzero_leads_count is null or nonzero_leads_count < 0 or nonzero_leads_count > 12 then 'nonzero_leads_count' end, case when einthoven_score is null or einthoven_score < -1 or einthoven_score > 1 then 'einthoven_score' end,
  case when avg_pixel_per_mm is null or avg_pixel_per_mm < 0 or avg_pixel_per_mm > 100 then 'avg_pixel_per_mm' end, case when raw_lines_count is null or raw_lines_count < 0 or raw_lines_count > 12 then 'raw_lines_count' end], lambda x: x is not null) as broken,
  list_filter([case when nonzero_leads_count < 10 then 'insufficient_active_leads' end, case when detected_leads_count < 4 then 'insufficient_lead_labels' end], lambda x: x is not null) as critical,
  list_filter([case when einthoven_score < 0.6::double then 'low_einthoven_consistency' end, case when layout_cost > 0.6::double then 'uncertain_layout' end, case when detected_leads_count < 6 then 'insufficient_lead_labels' end, case when avg_pixel_per_mm < 8.8::double then 'low_grid_density' end, case when nonzero_leads_count < 12 then 'insufficient_active_leads' end], lambda x: x is not null) as severe,
  list_filter([case when einthoven_score < 0.9::double then 'low_einthoven_consistency' end, case when layout_cost > 0.6::double then 'uncertain_layout' end, case when detected_leads_count < 8 then 'insufficient_lead_labels' end, case when avg_pixel_per_mm < 8.8::double then 'low_grid_density' end, case when nonzero_leads_count < 12 then 'insufficient_active_leads' end], lambda x: x is not null) as mild,
  case when status <> 'success' or median_correlation is null or median_rmse_mv is null or median_snr_db is null then 'reject' when median_correlation < 0.6::double or median_rmse_mv > 0.2::double or median_snr_db < 0 then 'reject' when median_correlation < 0.8::double or median_rmse_mv > 0.15::double or median_snr_db < 3 then 'warn' else 'accept' end as target from {source})"""
PROXIES["gated"] = f"$audit, gated as ({SQL_GATE.format(source='audit')}), gated_b as ({SQL_GATE.format(source='audit_b')})"


def gated(spark, sf):
    return U.quality_gate(audit(spark, sf)).withColumn("target", U.fidelity_target())


@query("D1_feature_contract", "with $gated select image_id, array_to_string(broken, ',') as violations from gated where len(broken) > 0")
def _(spark, sf):
    a = audit(spark, sf)
    return a.withColumn("v", U.contract_violations(dict(a.dtypes))).where("size(v) > 0").select("image_id", F.array_join("v", ",").alias("violations"))


@query("D2_quality_gate", "with $gated select image_id, prediction, array_to_string(codes, ',') as reason_codes from gated")
def _(spark, sf):
    return gated(spark, sf).select("image_id", "prediction", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("D3_fidelity_target", "with $gated select image_id, target from gated")
def _(spark, sf):
    return audit(spark, sf).select("image_id", U.fidelity_target().alias("target"))


@query("P20_fidelity_value", "with $audit select image_id, case when status = 'success' then median_correlation end as corr_value, case when status = 'success' then round(abs(median_gain_ratio - 1), 6) end as gain_error from audit")
def _(spark, sf):
    return audit(spark, sf).select("image_id", U.fidelity_value("median_correlation").alias("corr_value"), F.round(U.fidelity_value("median_gain_error"), 6).alias("gain_error"))


def sql_aggregate(name: str, source: str, by: str) -> str:
    med = lambda c: f"quantile_cont(case when status = 'success' then {c} end, 0.5)"
    return f"""{name} as (select {by}, count(*) as total, count(*) filter (status = 'success') as successful, avg((status <> 'success')::int::double) as failure_rate, {med('median_correlation')} as median_correlation, {med('median_rmse_mv')} as median_rmse_mv,
  {med('median_snr_db')} as median_snr_db, {med('abs(median_gain_ratio - 1)')} as median_gain_error, quantile_cont(elapsed_seconds, 0.5) as median_runtime, avg((prediction = 'reject')::int::double) as reject_rate from {source} group by {by})"""


AGG = ["failure_rate", "median_correlation", "median_rmse_mv", "median_snr_db", "median_gain_error", "median_runtime", "reject_rate"]


@query("A1_category_aggregate", f"with $gated, {sql_aggregate('a', 'gated', 'category')} select category, total, successful, " + ", ".join(f"round({m}, 6) as {m}" for m in AGG) + " from a")
def _(spark, sf):
    return rounded(U.audit_aggregate(audit(spark, sf), ["category"]), *AGG)


SQL_D = f"with $gated, {sql_aggregate('a', 'gated', 'category')}, {sql_aggregate('b', 'gated_b', 'category')}, d as (select category, " + ", ".join(f"b.{m} - a.{m} as {m}" for m in U.AGGREGATES) + ", (b.median_runtime - a.median_runtime) / nullif(a.median_runtime, 0) as runtime_increase from a join b using (category))"
DELTAS = [*U.AGGREGATES, "runtime_increase"]


def _deltas(spark, sf):
    return U.aggregate_deltas(U.audit_aggregate(audit(spark, sf), ["category"]), U.audit_aggregate(audit_b(spark, sf), ["category"]), "category")


@query("A2_aggregate_deltas", SQL_D + " select category, " + ", ".join(f"round({m}, 6) as {m}" for m in DELTAS) + " from d")
def _(spark, sf):
    return rounded(_deltas(spark, sf), *DELTAS)


@query("D4_promotion_checks", SQL_D + """, need as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', 'photos_gone']) as category),
e as (select category, unnest(['median_correlation', 'median_rmse_mv', 'median_snr_db', 'median_gain_error', 'failure_rate', 'runtime_increase', 'reject_rate']) as metric, unnest([median_correlation, median_rmse_mv, median_snr_db, median_gain_error, failure_rate, runtime_increase, reject_rate]) as observed,
  unnest([-0.02::double, 0.02::double, -1.0::double, 0.05::double, 0.0::double, 0.25::double, 0.0::double]) as allowed, unnest([-1, 1, -1, 1, 1, 1, 1]) as side from d join need using (category))
select category, metric, round(observed, 6) as observed, allowed from e where observed is null or (side = -1 and observed < allowed - 1e-12) or (side = 1 and observed > allowed + 1e-12)
union all select category, 'category', null, null from need where category not in (select category from d)""")
def _(spark, sf):
    return rounded(U.promotion_violations(_deltas(spark, sf), ["1-URGENT", "2-HIGH", "3-MEDIUM", "photos_gone"]), "observed")


@query("A3_record_deltas", """with $gated select image_id, round(case when a.status = 'success' and b.status = 'success' then b.median_correlation - a.median_correlation end, 6) as delta_correlation,
round(b.elapsed_seconds - a.elapsed_seconds, 6) as delta_elapsed, a.prediction || '->' || b.prediction as transition from gated a join gated_b b using (image_id)""")
def _(spark, sf):
    one = lambda df, p: U.quality_gate(df).select("image_id", U.fidelity_value("median_correlation").alias(f"{p}c"), F.col("elapsed_seconds").alias(f"{p}e"), F.col("prediction").alias(f"{p}p"))
    both = one(audit(spark, sf), "a").join(one(audit_b(spark, sf), "b"), "image_id")
    return both.select("image_id", F.round(F.col("bc") - F.col("ac"), 6).alias("delta_correlation"), F.round(F.col("be") - F.col("ae"), 6).alias("delta_elapsed"), F.concat_ws("->", "ap", "bp").alias("transition"))


@query("A4_fidelity_rollup", """with $audit select coalesce(category, 'overall') as category, count(*) as total, count(*) filter (status = 'success') as successful, round(quantile_cont(case when status = 'success' then median_correlation end, 0.5), 6) as median_correlation, round(avg(case when status = 'success' then median_snr_db end), 6) as mean_snr
from audit group by grouping sets ((category), ())""")
def _(spark, sf):
    ok = lambda c: F.when(F.col("status") == "success", F.col(c))
    out = audit(spark, sf).rollup("category").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.percentile(ok("median_correlation"), 0.5).alias("median_correlation"), F.avg(ok("median_snr_db")).alias("mean_snr"))
    return rounded(out.withColumn("category", F.coalesce("category", F.lit("overall"))), "median_correlation", "mean_snr")


@query("A7_confusion_matrix", "with $gated, t as (select unnest(['accept', 'warn', 'reject']) as target) select target, count(prediction) filter (prediction = 'accept') as accept, count(prediction) filter (prediction = 'warn') as warn, count(prediction) filter (prediction = 'reject') as reject from t left join gated using (target) group by target")
def _(spark, sf):
    return U.confusion(gated(spark, sf))


SQL_RATE = """count(*) as n, round(count(*) filter (target = 'reject' and prediction <> 'reject')::double / nullif(count(*) filter (target = 'reject'), 0), 6) as false_accept_rate, round(count(*) filter (target = 'reject' and prediction = 'reject')::double / nullif(count(*) filter (target = 'reject'), 0), 6) as reject_recall,
round(count(*) filter (target <> 'reject' and prediction = 'reject')::double / nullif(count(*) filter (target <> 'reject'), 0), 6) as false_reject_rate, round(avg((prediction <> 'reject')::int::double), 6) as coverage"""
RATE = ["false_accept_rate", "reject_recall", "false_reject_rate", "coverage"]


@query("A8_gate_rates", f"with $gated select {SQL_RATE} from gated")
def _(spark, sf):
    return rounded(U.gate_rates(gated(spark, sf), []), *RATE)


@query("A9_missed_rejects", "with $gated select category, image_id, prediction from gated where target = 'reject' and prediction <> 'reject'")
def _(spark, sf):
    return gated(spark, sf).where("target = 'reject' and prediction <> 'reject'").select("category", "image_id", "prediction").orderBy("category", "image_id")


@query("A10_independent_groups", "with $gated select category, count(distinct coalesce(group_id, image_id)) as n_groups, count(distinct coalesce(group_id, image_id)) < 30 as small_sample from gated group by category")
def _(spark, sf):
    n = F.countDistinct(F.coalesce("group_id", "image_id"))
    return audit(spark, sf).groupBy("category").agg(n.alias("n_groups")).withColumn("small_sample", F.col("n_groups") < 30)


@query("A11_gate_by_category", f"with $gated, r as (select category, target, prediction from gated union all select 'overall', target, prediction from gated) select category, {SQL_RATE} from r group by category")
def _(spark, sf):
    g = gated(spark, sf)
    each = g.withColumn("category", F.explode(F.array("category", F.lit("overall"))))
    return rounded(U.gate_rates(each, ["category"]), *RATE)


@query("D20_benchmark_rows", f"with $gated select category, image_id, target, prediction, array_to_string(codes, ',') as reason_codes, target = 'reject' and prediction <> 'reject' as missed from gated")
def _(spark, sf):
    return gated(spark, sf).select("category", "image_id", "target", "prediction", F.array_join("reason_codes", ",").alias("reason_codes"), ((F.col("target") == "reject") & (F.col("prediction") != "reject")).alias("missed"))


@query("A12_evidence_counts", "with $gated, e as (select category, unnest(codes) as code from gated) select category, code, count(*) as n from e group by all")
def _(spark, sf):
    return gated(spark, sf).select("category", F.explode("reason_codes").alias("code")).groupBy("category", "code").agg(F.count("*").alias("n"))


@query("A13_known_confusion", "with $gated, k as (select *, case when median_correlation is null then null else target = 'reject' end as expected from gated) select count(*) filter (expected and prediction = 'reject') as tp, count(*) filter (not expected and prediction = 'reject') as fp, count(*) filter (not expected and prediction <> 'reject') as tn, count(*) filter (expected and prediction <> 'reject') as fn, round(count(*) filter (expected and prediction = 'reject')::double / nullif(count(*) filter (expected), 0), 6) as sensitivity from k where expected is not null")
def _(spark, sf):
    e, p = F.col("target") == "reject", F.col("prediction") == "reject"
    known = gated(spark, sf).where("median_correlation is not null")
    return known.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(~e & ~p).alias("tn"), F.count_if(e & ~p).alias("fn"), F.round(F.try_divide(F.count_if(e & p).cast("double"), F.count_if(e)), 6).alias("sensitivity"))


@query("A6_operational_aggregate", """with $audit, r as (select *, case when image_id % 3 = 0 then 'auto' else 'hint' end as mode, case when image_id % 2 = 0 then 'flat' else 'angled' end as variant, case when image_id % 29 = 0 then 'timeout' else status end as st from audit),
a as (select mode, coalesce(variant, 'all') as variant, count(*) as total, count(*) filter (st = 'success') as successful, count(*) filter (st = 'timeout') as timed_out, count(*) filter (st = 'success' and nonzero_leads_count = 12) as twelve_active, quantile_cont(case when st = 'success' then einthoven_score end, 0.5) as me, quantile_cont(elapsed_seconds, 0.5) as ms from r group by grouping sets ((mode), (mode, variant)))
select mode, variant, total, successful, timed_out, twelve_active, round(me, 6) as median_einthoven, round(ms, 6) as median_elapsed, total - successful - timed_out as failed, round(successful::double / total, 6) as success_rate, round(case when successful = 0 then 0 else twelve_active::double / successful end, 6) as twelve_active_rate,
successful::double / total >= 0.9::double and (case when successful = 0 then 0 else twelve_active::double / successful end) >= 0.9::double and coalesce(me >= 0.7::double, false) as accepted from a""")
def _(spark, sf):
    mode, variant = F.when(F.col("image_id") % 3 == 0, "auto").otherwise("hint"), F.when(F.col("image_id") % 2 == 0, "flat").otherwise("angled")
    rows = audit(spark, sf).withColumns({"mode": mode, "variant": F.explode(F.array(variant, F.lit("all"))), "status": F.when(F.col("image_id") % 29 == 0, "timeout").otherwise(F.col("status"))})
    return rounded(U.operational_aggregate(rows, ["mode", "variant"]), "median_einthoven", "median_elapsed", "success_rate", "twelve_active_rate")


@query("D5_research_candidate", """with $scores, v as (select a.class as category, 'x' as k, a.record_id, a.prob as base, b.prob as cand from scores a join scores_b b on a.record_id = b.record_id and a.class_idx = b.class_idx),
d as (select category, avg(cand) - avg(base) as cosine, avg(abs(cand - 0.5)) - avg(abs(base - 0.5)) as difference, avg((cand >= 0.5)::int::double) - avg((base >= 0.5)::int::double) as agreement from v group by category),
need as (select * from (values ('FA', 'supported'), ('FN', 'supported'), ('OA', 'target'), ('gone', 'target')) t(category, role)), h as (select need.*, cosine, difference, agreement from need left join d using (category))
select category, role, unnest(list_filter([case when cosine is null then 'category' end, case when cosine < -1e-12 then 'mean_cosine_similarity' end, case when difference > 1e-12 then 'mean_abs_probability_difference' end, case when agreement < -1e-12 then 'mean_agreement_rate' end, case when role = 'target' and cosine < 0.01::double - 1e-12 then 'target_mean_cosine_similarity_gain' end], lambda x: x is not null)) as metric from h""")
def _(spark, sf):
    from .evaluation import pairs

    hit = lambda c: F.avg((F.col(c) >= 0.5).cast("double"))
    d = pairs(spark, sf).groupBy(F.col("class").alias("category")).agg((F.avg("b") - F.avg("a")).alias("cosine"), (F.avg(F.abs(F.col("b") - 0.5)) - F.avg(F.abs(F.col("a") - 0.5))).alias("difference"), (hit("b") - hit("a")).alias("agreement"))
    return U.promotion_gains(d, ["FA", "FN"], ["OA", "gone"])


@query("D6_layout_scope", f"with $gated, s as (select target, case when raw_lines_count in (3, 6) then prediction else 'reject' end as prediction, image_id % 4 as split from gated) select {SQL_RATE} from s where split <> 0")
def _(spark, sf):
    scoped = gated(spark, sf).where("image_id % 4 <> 0").withColumn("prediction", F.when(F.col("raw_lines_count").isin(3, 6), F.col("prediction")).otherwise("reject"))
    return rounded(U.gate_rates(scoped, []), *RATE)


GROUPS = {"slow": ["FA"], "fast": ["FN", "FR"], "normal_read": ["OA"], "sinus_named": ["ON"], "sinus": ["OR"], "normalish": ["OA", "ON", "OR"]}


@query("D7_rate_adjustment", """with $scores, r as (select *, 30 + record_id % 130 as hr from scores) select record_id, class, round(prob
 * case when class = 'FA' and hr >= 110 then 0.05 else 1 end * case when class = 'OA' and hr >= 110 then 0.1 else 1 end * case when class = 'ON' and hr >= 130 then 0.1 else 1 end * case when class = 'OR' and hr >= 130 then 0.2 else 1 end
 * case when class in ('FN', 'FR') and hr <= 55 then 0.05 else 1 end * case when class = 'OA' and hr <= 55 then 0.1 else 1 end * case when class = 'ON' and hr <= 45 then 0.2 else 1 end * case when class = 'OR' and hr <= 45 then 0.3 else 1 end
 * case when class in ('OA', 'ON', 'OR') and (hr < 50 or hr > 100) then 0.25 else 1 end, 6) as prob from r""".replace("0.05 ", "0.05::double ").replace("0.1 ", "0.1::double ").replace("0.2 ", "0.2::double ").replace("0.3 ", "0.3::double ").replace("0.25 ", "0.25::double "))
def _(spark, sf):
    rate = 30 + F.col("record_id") % 130
    return scores(spark, sf).select("record_id", "class", F.round(F.col("prob") * U.rate_factor(rate, F.col("class"), GROUPS), 6).alias("prob"))


@query("D8_rhythm_veto", """with $scores, rh as (select distinct record_id, case record_id % 3 when 0 then 'sinus' when 1 then 'atrial_fibrillation' else 'undetermined' end as basis, case when record_id % 2 = 0 then 'good' else 'low' end as quality from scores),
forb as (select * from (values ('sinus', 'FA'), ('sinus', 'FN'), ('atrial_fibrillation', 'OA')) t(basis, class)) select record_id, class, basis as superseded_by from scores join rh using (record_id) join forb using (basis, class) where prob >= 0.5::double and quality = 'good'""")
def _(spark, sf):
    s = scores(spark, sf).withColumn("active", F.col("prob") >= 0.5)
    k = F.col("record_id")
    rhythm = s.select("record_id").distinct().withColumns({"rhythm_basis": F.when(k % 3 == 0, "sinus").when(k % 3 == 1, "atrial_fibrillation").otherwise("undetermined"), "quality": F.when(k % 2 == 0, "good").otherwise("low")})
    return U.veto(s, rhythm, spark.createDataFrame([("sinus", "FA"), ("sinus", "FN"), ("atrial_fibrillation", "OA")], "rhythm_basis string, class string"))


SQL_EXCL = "grp as (select * from (values ('FA', 'f'), ('FN', 'f'), ('OA', 'o'), ('OR', 'o')) t(class, grp)), act as (select *, first_value(class) over (partition by record_id, grp order by prob desc, class_idx) as best from scores join grp using (class) where prob >= 0.5::double)"


@query("D9_exclusive_groups", f"with $scores, {SQL_EXCL} select record_id, class, best as superseded_by from act where class <> best")
def _(spark, sf):
    groups = spark.createDataFrame([("FA", "f"), ("FN", "f"), ("OA", "o"), ("OR", "o")], "class string, group string")
    return U.exclusive(scores(spark, sf).withColumn("active", F.col("prob") >= 0.5), groups).where("not kept").select("record_id", "class", "superseded_by")


# one report row for each order: measurements by integer arithmetic
PROXIES["reports"] = """$scores, paths as (select record_id, list(class order by prob desc, class_idx) filter (prob >= 0.9::double and class <> 'ON') as p from scores group by record_id),
meas as (select record_id, coalesce(p, []) as p, case record_id % 4 when 0 then 'undetermined' else 'sinus' end as basis, case when record_id % 11 = 0 then null else (40 + record_id * 7 % 90)::double end as hr, record_id % 5 = 0 as ectopy,
  case when record_id % 7 = 0 then null else (100 + record_id * 3 % 120)::double end as pr, (70 + record_id * 11 % 70)::double as qrs, case when record_id % 9 = 0 then null else (330 + record_id * 13 % 160)::double end as qtc, case when record_id % 2 = 0 then 'male' else 'female' end as sex, record_id % 17 = 0 as vt from paths),
flags as (select *, case when pr > 200 then 'prolonged' when pr < 120 then 'short' when pr is not null then 'normal' end as pr_flag, case when qrs >= 120 then 'wide' else 'normal' end as qrs_flag,
  case when qtc > case sex when 'male' then 450 else 460 end then 'prolonged' when qtc < 350 then 'short' when qtc is not null then 'normal' end as qtc_flag from meas),
reports as (select *, list_filter([case when basis <> 'sinus' then 'sinus_rhythm' end, case when not coalesce(hr between 60 and 100, false) then 'normal_rate' end, case when ectopy then 'no_ectopy' end, case when coalesce(pr_flag, '') <> 'normal' then 'normal_pr' end, case when coalesce(qrs_flag, '') <> 'normal' then 'normal_qrs' end,
  case when coalesce(qtc_flag, '') <> 'normal' then 'normal_qtc' end, case when len(p) > 0 then 'no_significant_pathology' end, case when vt then 'no_vt_support' end], lambda x: x is not null) as failed from flags)"""


def measured(spark, sf):
    s = scores(spark, sf)
    paths = s.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.when((F.col("prob") >= 0.9) & (F.col("class") != "ON"), F.struct((-F.col("prob")).alias("o"), "class_idx", "class")))), lambda x: x["class"]).alias("pathologies"))
    k = F.col("record_id")
    return paths.withColumns({
        "rhythm_basis": F.when(k % 4 == 0, "undetermined").otherwise("sinus"), "heart_rate": F.when(k % 11 != 0, (40 + k * 7 % 90).cast("double")), "ectopy": k % 5 == 0,
        "pr_ms": F.when(k % 7 != 0, (100 + k * 3 % 120).cast("double")), "qrs_ms": (70 + k * 11 % 70).cast("double"), "qtc_ms": F.when(k % 9 != 0, (330 + k * 13 % 160).cast("double")),
        "sex": F.when(k % 2 == 0, "male").otherwise("female"), "supports_vt": k % 17 == 0,
    })


@query("F13_interval_flags", "with $reports select record_id, pr_flag, qrs_flag, qtc_flag from flags")
def _(spark, sf):
    return measured(spark, sf).withColumns(U.interval_flags(F.col("sex"))).select("record_id", "pr_flag", "qrs_flag", "qtc_flag")


@query("D10_normality_verdict", "with $reports select record_id, array_to_string(failed, ',') as failed, case when len(failed) = 0 then 'Normal ECG' when basis <> 'sinus' or ectopy or len(p) > 0 or vt or (hr is not null and hr not between 60 and 100) then 'Abnormal ECG' else 'Indeterminate ECG' end as verdict from reports")
def _(spark, sf):
    out = U.normality(measured(spark, sf).withColumns(U.interval_flags(F.col("sex"))))
    return out.select("record_id", F.array_join("failed", ",").alias("failed"), "verdict")


SQL_REPORT = """with $reports, top as (select record_id, string_agg(class || ':' || printf('%.3f', prob), ',' order by prob desc, class_idx) as top from (select *, row_number() over (partition by record_id order by prob desc, class_idx) as place from scores) where place <= 3 group by record_id)
select record_id, round_even(hr, 1) as heart_rate, round_even(qtc, 1) as qtc, array_to_string(p[1:3], ',') as pathologies, top from reports left join top using (record_id)"""


def assembled(spark, sf):
    top = S.top_classes(scores(spark, sf), 3, F.lit(True)).groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "class", "prob"))), lambda x: F.concat_ws(":", x["class"], F.format_string("%.3f", x["prob"]))), ",").alias("top"))
    return measured(spark, sf).join(top, "record_id", "left").select("record_id", F.bround("heart_rate", 1).alias("heart_rate"), F.bround("qtc_ms", 1).alias("qtc"), F.array_join(F.slice("pathologies", 1, 3), ",").alias("pathologies"), "top")


@query("D11_report_assembly", SQL_REPORT)
def _(spark, sf):
    return assembled(spark, sf)


@query("P17_report_rounding", "with $reports select record_id, round_even(hr * 1.037::double, 1) as heart_rate, round_even(qtc / 3, 4) as qtc from reports")
def _(spark, sf):
    return measured(spark, sf).select("record_id", F.bround(F.col("heart_rate") * 1.037, 1).alias("heart_rate"), F.bround(F.col("qtc_ms") / 3, 4).alias("qtc"))


@query("F14_rate_fallback", "with $reports select record_id, coalesce(hr, 60000 / nullif(qtc, 0) / 5, 0) as rate from reports")
def _(spark, sf):
    return measured(spark, sf).select("record_id", F.coalesce("heart_rate", F.try_divide(F.lit(60000.0), F.col("qtc_ms")) / 5, F.lit(0.0)).alias("rate"))


@query("W25_corrected_qt", "with $reports, r as (select record_id, qtc / 1000 as qt, 60 / hr as rr, (record_id % 30) / 100::double as cv, hr from meas) select record_id, round(qt / sqrt(rr) * 1000, 4) as bazett, round(qt / cbrt(rr) * 1000, 4) as fridericia, case when qt is null or rr is null then 'n/a' when cv > 0.15::double or hr < 60 or hr > 100 then 'fridericia' else 'bazett' end as formula from r")
def _(spark, sf):
    from ..operators import beats as B

    rows = measured(spark, sf).select("record_id", F.col("qtc_ms").alias("qt_ms"), (60 / F.col("heart_rate")).alias("rr_sec"), ((F.col("record_id") % 30) / 100.0).alias("rr_cv"))
    return rounded(B.corrected_qt(rows).select("record_id", "bazett", "fridericia", "formula"), "bazett", "fridericia", n=4)


@query("D21_output_sanity", "with $audit select image_id, array_to_string(list_filter([case when raw_lines_count < 3 then 'raw_lines' end, case when nonzero_leads_count < 8 then 'active_leads' end], lambda x: x is not null), ',') as issues from audit")
def _(spark, sf):
    return audit(spark, sf).select("image_id", F.array_join(U.reasons({"raw_lines": F.col("raw_lines_count") < 3, "active_leads": F.col("nonzero_leads_count") < 8}), ",").alias("issues"))


@query("D22_best_attempt", """with $audit, t as (select image_id, unnest([0, 1, 2]) as attempt, nonzero_leads_count as n, raw_lines_count as raw, detected_leads_count as det, layout_cost as lc from audit), v as (select image_id, attempt, (n + attempt) % 13 as n, (raw + attempt) % 7 as raw, (det + attempt * 3) % 13 as det, lc * (1 + attempt) as lc, ((image_id + attempt) % 10) / 10::double as fr from t),
s as (select *, n * 4 + raw * 3 + det * 1.5::double + fr * 5 - lc * 10 as score, row_number() over (partition by image_id order by round(n * 4 + raw * 3 + det * 1.5::double + fr * 5 - lc * 10, 9) desc, attempt) as place from v) select image_id, attempt, round(score, 6) as score, lc > 1.2::double or raw < 3 or det < 8 as retry_orientation, lc > 1.2::double or raw < 4 or det < 10 as retry_dewarping from s where place = 1""")
def _(spark, sf):
    from ..operators.thresholds import first_by

    k = F.col("attempt")
    t = audit(spark, sf).withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("image_id", "attempt", ((F.col("nonzero_leads_count") + k) % 13).alias("nonempty_leads"), ((F.col("raw_lines_count") + k) % 7).alias("raw_lines"), ((F.col("detected_leads_count") + k * 3) % 13).alias("detected"), (F.col("layout_cost") * (1 + k)).alias("layout_cost"), (((F.col("image_id") + k) % 10) / 10.0).alias("finite_ratio"))
    best = first_by(t.withColumn("score", U.attempt_score()), ["image_id"], F.desc(F.round("score", 9)), F.asc("attempt"))
    return best.select("image_id", "attempt", F.round("score", 6).alias("score"), U.retry_orientation().alias("retry_orientation"), U.retry_dewarping().alias("retry_dewarping"))


# wide-complex features for each order, by integer arithmetic
def wct(spark, sf):
    k = F.col("image_id")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    lead = lambda a, b: F.struct((k % a).alias("beats"), F.when(k % b != 0, pick(k * 7 % 5, "r", "qr", "rs", "qs", "qrs")).alias("pattern"), pick(k % 3, "positive", "negative", "mixed").alias("polarity"), ((k * 13 % 30) / 10.0).alias("r_s"), pick(k % 2, "r", "q").alias("initial"), (k * 3 % 60).cast("double").alias("initial_ms"), F.when(k % 4 != 0, (k * 5 % 90).cast("double")).alias("nadir_ms"), (k % 19 == 0).alias("s_notched"), (k % 23 == 0).alias("left_ear"))
    avr = F.struct((k % 3).alias("beats"), pick(k % 2, "r", "q").alias("initial"), (k * 17 % 70).cast("double").alias("initial_ms"), (k % 6 == 0).alias("notched"), ((k * 29 % 30) / 10.0).alias("vi_vt"))
    return audit(spark, sf).select("image_id", F.when(k % 10 != 0, (80 + k * 3 % 100).cast("double")).alias("heart_rate"), (90 + k * 7 % 90).cast("double").alias("qrs_ms"), (k % 8).alias("n_beats"), (k * 11 % 160).cast("double").alias("max_rs_ms"), (k % 12 == 0).alias("rs_absent"), F.when(k % 3 == 0, k % 2 == 0).alias("av_dissociation"), F.when(k % 5 == 0, False).alias("capture_beats"), (k % 4 != 0).alias("regular"), lead(4, 7).alias("v1"), lead(5, 9).alias("v6"), avr.alias("avr"))


PROXIES["criteria"] = """
w1 as (select *, b1 > 0 and p1 is not null as m1, b6 > 0 and p6 is not null as m6, qrs >= 140 as elig, case when hr is null or nb < 3 then 'unmeasurable' when hr <= 100 or qrs < 120 then 'not_wide_complex_tachycardia' else '' end as scope from wct),
w2 as (select *, coalesce(p1 in ('r', 'qr') or (p1 = 'rs' and r_s >= 1), false) or coalesce(ear, false) as r1, coalesce(p6 in ('r', 'qr', 'qs') or (p6 = 'rs' and r_s6 < 1), false) as r6,
  list_filter([case when (ini = 'r' and ini_ms > 30) or coalesce(nadir > 60, false) or coalesce(notch, false) then 'brugada_terminal_v1_lbbb_morphology' end, case when m6 and p6 in ('qr', 'qs', 'qrs') then 'brugada_terminal_v6_lbbb_q_wave' end], lambda x: x is not null) as lb from w1),
w3 as (select *, case when not m1 then null when pol = 'positive' then case when not m6 then null else r1 and r6 end when pol = 'negative' then case when len(lb) > 0 then true when not m6 then null else false end end as tsup,
  case when m1 and pol = 'positive' and m6 and r1 and r6 then ['brugada_terminal_v1_v6_rbbb_morphology'] when m1 and pol = 'negative' then lb else [] end as tcrit from w2),
w4 as (select *, list_concat(list_filter([case when elig and rs_absent then 'brugada_absent_rs_all_precordial' end, case when elig and rs > 100 and rs <= qrs + 20 then 'brugada_rs_interval_gt_100ms' end, case when av then 'brugada_av_dissociation' end, case when cap then 'brugada_capture_or_fusion_beats' end], lambda x: x is not null), case when elig and coalesce(tsup, false) then tcrit else [] end) as bru,
  list_filter([case when elig and ba > 0 and a_ini = 'r' then 'vereckei_initial_r_in_avr' end, case when elig and ba > 0 and a_ms > 40 then 'vereckei_initial_r_or_q_gt_40ms' end, case when elig and ba > 0 and a_notch then 'vereckei_initial_downstroke_notching' end, case when elig and ba > 0 and vivt <= 1 then 'vereckei_vi_vt_ratio_leq_1' end], lambda x: x is not null) as ver,
  list_filter([case when scope <> '' then 'criteria_apply_only_to_tachycardia_with_qrs_at_least_120ms' end, case when not regular then 'irregular_rhythm_algorithms_validated_for_regular_wct' end, case when scope = '' and not elig then 'automated_morphology_support_requires_qrs_at_least_140ms' end, case when rs > 100 and rs > qrs + 20 then 'rs_interval_exceeds_measured_qrs_consistency' end, case when av is null then 'av_dissociation_not_assessed' end, case when cap is null then 'capture_or_fusion_beats_not_assessed' end, case when tsup is null then 'terminal_v1_v6_morphology_not_measurable' end], lambda x: x is not null) as lim from w3)"""
PROXIES["wct"] = """$audit, w0 as (select image_id, image_id as k from audit),
wct as (select image_id, k, case when k % 10 <> 0 then 80 + k * 3 % 100 end as hr, 90 + k * 7 % 90 as qrs, k % 8 as nb, k * 11 % 160 as rs, k % 12 = 0 as rs_absent, case when k % 3 = 0 then k % 2 = 0 end as av, case when k % 5 = 0 then false end as cap, k % 4 <> 0 as regular,
  k % 4 as b1, case when k % 7 <> 0 then (['r', 'qr', 'rs', 'qs', 'qrs'])[k * 7 % 5 + 1] end as p1, (['positive', 'negative', 'mixed'])[k % 3 + 1] as pol, (k * 13 % 30) / 10::double as r_s, (['r', 'q'])[k % 2 + 1] as ini, k * 3 % 60 as ini_ms, case when k % 4 <> 0 then k * 5 % 90 end as nadir, k % 19 = 0 as notch, k % 23 = 0 as ear,
  k % 5 as b6, case when k % 9 <> 0 then (['r', 'qr', 'rs', 'qs', 'qrs'])[k * 7 % 5 + 1] end as p6, k % 3 as ba, k * 17 % 70 as a_ms, k % 6 = 0 as a_notch, (k * 29 % 30) / 10::double as vivt, (k * 13 % 30) / 10::double as r_s6, (['r', 'q'])[k % 2 + 1] as a_ini from w0),
$criteria"""


@query("D12_wct_classification", "with $wct select image_id, scope, case when scope <> '' then scope when len(bru) + len(ver) > 0 then 'vt_supported' else 'indeterminate_wide_complex_tachycardia' end as classification from w4")
def _(spark, sf):
    return U.assess_wct(wct(spark, sf)).select("image_id", "scope", "classification")


@query("D13_brugada", "with $wct select image_id, array_to_string(bru, ',') as criteria from w4")
def _(spark, sf):
    return wct(spark, sf).select("image_id", F.array_join(U.brugada(U.terminal_morphology()), ",").alias("criteria"))


@query("D14_vereckei", "with $wct select image_id, array_to_string(ver, ',') as criteria from w4")
def _(spark, sf):
    return wct(spark, sf).select("image_id", F.array_join(U.vereckei(), ",").alias("criteria"))


@query("D15_terminal_morphology", "with $wct select image_id, tsup as supports, array_to_string(tcrit, ',') as criteria from w4")
def _(spark, sf):
    t = U.terminal_morphology()
    return wct(spark, sf).select("image_id", t["supports"].alias("supports"), F.array_join(t["criteria"], ",").alias("criteria"))


@query("D16_limitations", "with $wct select image_id, array_to_string(lim, ',') as limitations from w4")
def _(spark, sf):
    return U.assess_wct(wct(spark, sf)).select("image_id", F.array_join("limitations", ",").alias("limitations"))


@query("D17_fault_tolerant_audit", "with $wct select image_id, case when hr is null then 'failed' else 'success' end as status, case when hr is null then 'heart_rate missing' end as error, case when hr is not null then len(bru) + len(ver) > 0 and scope = '' end as supports_vt from w4")
def _(spark, sf):
    error = F.when(F.col("heart_rate").isNull(), "heart_rate missing")
    out = U.assess_wct(wct(spark, sf)).withColumn("error", error)
    return out.select("image_id", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error", F.when(F.col("error").isNull(), F.col("supports_vt")).alias("supports_vt"))
