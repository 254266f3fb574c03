"""Queries that select thresholds, fit calibrations and resample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import thresholds as H
from .evaluation import sql_t_p, METRICS, SQL_ARMS, SQL_METRICS, SQL_RATES, arms, rounded, sql_counts, sql_ranking, sql_report
from .proxies import doc_scores, scores, scores_b
from .registry import query


def sql_candidates(source: str, by: str, name: str = "cand") -> str:
    return f"""{name}_mid as (select {by}, (prob + lead(prob) over (partition by {by} order by prob)) / 2 as mid from (select distinct {by}, prob from {source})),
{name} as (select distinct {by}, least(greatest(mid, 0.001::double), 0.999::double) as cutoff from {name}_mid where mid is not null union all select {by}, 0.5::double from {name}_mid group by {by} having count(mid) = 0)"""


def sql_rates(source: str, by: str, name: str = "rates", cuts: str = "cand", weight: str = "1") -> str:
    using = by.replace(" ", "")
    on = " and ".join(f"c.{k} = t.{k}" for k in using.split(","))
    keys = ", ".join(f"c.{k}" for k in using.split(","))
    return f"""{name}_t as (select {by}, prob, sum(y)::double as pos, sum((1 - y) * {weight})::double as neg from {source} group by {by}, prob),
{name}_all as (select {by}, sum(pos) as p, sum(neg) as q from {name}_t group by {by}),
{name}_u as (select {by}, prob as x, pos, neg, 0 as is_cut from {name}_t union all select {by}, cutoff, 0, 0, 1 from {cuts}),
{name}_r as (select {by}, x as cutoff, is_cut, sum(pos) over w as tp, sum(neg) over w as fp from {name}_u window w as (partition by {by} order by x desc, is_cut rows unbounded preceding)),
{name} as (select *, case when p = 0 then 0 else tp / p end as sensitivity, case when q = 0 then 0 else (q - fp) / q end as specificity, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision,
  case when p + tp + fp = 0 then 0 else 2 * tp / (p + tp + fp) end as f1, case when 4 * p + tp + fp = 0 then 0 else 5 * tp / (4 * p + tp + fp) end as f2 from {name}_r join {name}_all using ({by}) where is_cut = 1)"""


def sql_logit(p: str) -> str:
    return f"ln(least(greatest({p}, 1e-6), 1 - 1e-6) / (1 - least(greatest({p}, 1e-6), 1 - 1e-6)))"


def sql_poisson(seed: int, replicate: str, unit: str) -> tuple[str, str]:
    """A hash draw ``u``, and the Poisson(1) count of it."""
    at, total, steps = 0.36787944117144233, 0.0, []
    for k in range(6):
        total += at
        steps.append(f"(u >= {total!r}::double)::int")
        at /= k + 1
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {replicate}::varchar, {unit}::varchar)), 1, 13))::bigint::double / 4503599627370496::double as u", " + ".join(steps)


def sql_bootstrap(units: str, unit: str, by: str = "", replicates: int = 500) -> str:
    """CTEs: ``boot`` has the interval of sum(a) / sum(b) over ``units`` (by, unit, a, b)."""
    draw, count = sql_poisson(7, "replicate", unit)
    lead, using = (f"{by}, ", f"join ends using ({by})") if by else ("", ", ends")
    return f"""drawn as (select u.*, replicate, {draw} from {units} u, (select unnest(range(0, {replicates})) as replicate)), weighed as (select *, {count} as w from drawn),
value as (select {lead}replicate, sum(w * a) / sum(w * b) as value from weighed where w > 0 group by {lead}replicate having sum(w * b) > 0),
ends as (select {lead}quantile_cont(value, 0.025) as low, quantile_cont(value, 0.975) as high, count(*) as n_replicates from value {f"group by {by}" if by else ""}),
point as (select {lead}sum(a) / sum(b) as estimate, count(*) as n_units from {units} {f"group by {by}" if by else ""}),
boot as (select {lead}round(estimate, 4) as estimate, n_units, round(low, 4) as low, round(high, 4) as high, n_replicates from point {using})"""


def sql_platt(source: str, rounds: int = 12) -> str:
    """CTEs: ``platt`` has slope and intercept of each class, by Newton's method."""
    out = f"""px as (select class, sum(y)::double as pos, count(*)::double as n, {sql_logit('prob')} as x from {source} group by class, prob),
pf0 as (select class, 0::double as a, 0::double as b, sum(pos) as p, sum(n) as m from px group by class)"""
    for k in range(rounds):
        out += f""",
pg{k} as (select class, a, b, p, m, sum((n * q - pos) * x) + a as ga, sum(n * q - pos) as gb, sum(n * q * (1 - q) * x * x) + 1 as haa, sum(n * q * (1 - q) * x) as hab, sum(n * q * (1 - q)) as hbb from (select px.*, a, b, p, m, 1 / (1 + exp(-(a * x + b))) as q from px join pf{k} using (class)) group by class, a, b, p, m),
pf{k + 1} as (select class, case when haa * hbb - hab * hab > 1e-12 then a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) else a end as a, case when haa * hbb - hab * hab > 1e-12 then b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) else b end as b, p, m from pg{k})"""
    return out + f""",
platt as (select class, case when p > 0 and p < m and a > 0 then a end as slope, case when p > 0 and p < m and a > 0 then b end as intercept from pf{rounds})"""


SCAN = f"with $scores, {sql_candidates('scores', 'class')}, {sql_rates('scores', 'class')}"


@query("H1_candidate_cutoffs", f"with $scores, {sql_candidates('scores', 'class')} select class, count(*) as n, round(min(cutoff), 6) as lo, round(max(cutoff), 6) as hi, round(sum(cutoff), 6) as total from cand group by class")
def _(spark, sf):
    c = H.candidates(scores(spark, sf), ["class"])
    return rounded(c.groupBy("class").agg(F.count("*").alias("n"), F.min("cutoff").alias("lo"), F.max("cutoff").alias("hi"), F.sum("cutoff").alias("total")), "lo", "hi", "total")


@query("H2_operating_rates", SCAN + " select class, round(cutoff, 6) as cutoff, round(sensitivity, 6) as sensitivity, round(specificity, 6) as specificity, round(precision, 6) as precision from rates")
def _(spark, sf):
    s = scores(spark, sf)
    return rounded(H.rates_at(s, H.candidates(s, ["class"]), ["class"]).select("class", "cutoff", "sensitivity", "specificity", "precision"), "cutoff", "sensitivity", "specificity", "precision")


@query("H3_fbeta_threshold", SCAN + ", b as (select *, row_number() over (partition by class order by round(f2, 12) desc, cutoff) as place from rates) select class, round(cutoff, 6) as cutoff, round(f2, 6) as score from b where place = 1")
def _(spark, sf):
    return rounded(H.best_fbeta(scores(spark, sf), ["class"], 2.0).select("class", "cutoff", "score"), "cutoff", "score")


@query("F12_fbeta", SCAN + " select class, round(cutoff, 6) as cutoff, round(f1, 6) as f1, round(f2, 6) as f2 from rates where cutoff < 0.3::double")
def _(spark, sf):
    s = scores(spark, sf)
    at = H.rates_at(s, H.candidates(s, ["class"]), ["class"]).where("cutoff < 0.3D")
    return rounded(at.select("class", "cutoff", H.fbeta().alias("f1"), H.fbeta(2.0).alias("f2")), "cutoff", "f1", "f2")


@query("H4_min_sensitivity", SCAN + ", b as (select *, row_number() over (partition by class order by (sensitivity >= 0.9::double) desc, case when sensitivity >= 0.9::double then -specificity end, cutoff) as place from rates) select class, round(cutoff, 6) as cutoff, round(sensitivity, 6) as sensitivity, round(specificity, 6) as specificity from b where place = 1")
def _(spark, sf):
    return rounded(H.at_sensitivity(scores(spark, sf), ["class"], 0.9).select("class", "cutoff", "sensitivity", "specificity"), "cutoff", "sensitivity", "specificity")


@query("H5_min_specificity", SCAN + ", b as (select *, specificity >= 0.95::double as ok from rates), c as (select *, row_number() over (partition by class order by ok desc, case when ok then -sensitivity end, case when ok then cutoff else -cutoff end) as place from b) select class, round(cutoff, 6) as cutoff, round(sensitivity, 6) as sensitivity, round(specificity, 6) as specificity from c where place = 1")
def _(spark, sf):
    return rounded(H.at_specificity(scores(spark, sf), ["class"], 0.95).select("class", "cutoff", "sensitivity", "specificity"), "cutoff", "sensitivity", "specificity")


def sql_observed(source: str = "scores") -> str:
    return f"""seen as (select distinct class, prob as cutoff from {source}), {sql_rates(source, 'class', 'obs', 'seen')},
pick as (select class, least(greatest(cutoff, 0.02::double), 0.98::double) as cutoff from (select *, row_number() over (partition by class order by round(f1, 12) desc, cutoff) as place from obs where precision >= 0.3::double and p > 0) where place = 1),
chosen as (select c.class, coalesce(pick.cutoff, 0.5::double) as cutoff from (select distinct class from {source}) c left join pick using (class)), {sql_rates(source, 'class', 'ship', 'chosen')}"""


@query("H6_f1_threshold", f"with $scores, {sql_observed()} select class, round(cutoff, 6) as cutoff, round(f1, 6) as f1 from ship")
def _(spark, sf):
    return rounded(H.best_f1_observed(scores(spark, sf), ["class"]), "cutoff", "f1")


@query("H7_crossfit", f"""with $doc_scores, rep as (select unnest([0, 1]) as repeat), rows_ as (select d.*, repeat, 'all' as task, cast(('0x' || substr(md5(repeat::varchar || '|' || source), 1, 7)) as bigint) % 5 as block from doc_scores d, rep),
fit as (select r.*, held from rows_ r, (select unnest([0,1,2,3,4]) as held) where held <> block), {sql_candidates('fit', 'task, repeat, held')}, {sql_rates('fit', 'task, repeat, held')},
cut as (select task, repeat, held, cutoff from (select *, row_number() over (partition by task, repeat, held order by round(f1, 12) desc, cutoff) as place from rates) where place = 1),
each as (select task, r.repeat, count(*) filter (prob >= cutoff and y = 1) as tp, count(*) filter (prob < cutoff and y = 0) as tn, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from rows_ r join cut using (task, repeat) where cut.held = r.block group by task, r.repeat)
select task, round(avg(tp::double / p), 6) as sensitivity, round(avg(tn::double / q), 6) as specificity, (select round(quantile_cont(cutoff, 0.5), 6) from cut) as median_cutoff from each group by task""")
def _(spark, sf):
    return rounded(H.crossfit(doc_scores(spark, sf).withColumn("task", F.lit("all")), "source", ["task"]), "sensitivity", "specificity", "median_cutoff")


@query("H10_percentile", "with $scores select class, round(quantile_cont(prob, 0.025), 6) as low, round(quantile_cont(prob, 0.975), 6) as high from scores group by class")
def _(spark, sf):
    return rounded(scores(spark, sf).groupBy("class").agg(F.percentile("prob", 0.025).alias("low"), F.percentile("prob", 0.975).alias("high")), "low", "high")


SQL_TIER = f"with $scores, {sql_ranking('rk', 'scores', 'class')}, {sql_observed()}, t as (select class, rk.positives, rk.auroc, ship.f1, ship.cutoff from rk join ship using (class))"
SQL_TIER_CASE = "case when positives < 10 or auroc is null or f1 is null then 'research_only' when auroc >= 0.8::double and f1 >= 0.3::double then 'validated' else 'provisional' end as tier"


@query("H13_assign_tier", SQL_TIER + f" select class, positives, {SQL_TIER_CASE} from t")
def _(spark, sf):
    s = scores(spark, sf)
    return M.ranking(s, ["class"]).join(H.best_f1_observed(s, ["class"]), "class").select("class", "positives", H.assign_tier().alias("tier"))


@query("H11_platt_fit", f"with $scores, {sql_platt('scores')} select class, round(slope, 4) as slope, round(intercept, 4) as intercept from platt")
def _(spark, sf):
    return rounded(H.platt_fit(scores(spark, sf), ["class"]), "slope", "intercept", n=4)


@query("H12_fit_calibration", f"""with $scores, {sql_platt('scores')}, enough as (select class from scores group by class having sum(y) >= 10),
fitted as (select record_id, class, y, case when slope is null then prob else 1 / (1 + exp(-(slope * {sql_logit('prob')} + intercept))) end as prob from scores join enough using (class) join platt using (class)), {sql_ranking('rk', 'fitted', 'class')}, {sql_observed('fitted')}
select class, positives, round(auroc, 4) as auroc, round(cutoff, 4) as cutoff, round(f1, 4) as f1, {SQL_TIER_CASE} from rk join ship using (class)""")
def _(spark, sf):
    s = scores(spark, sf)
    enough = s.groupBy("class").agg(F.sum("y").alias("k")).where("k >= 10").select("class")
    fitted = s.join(enough, "class").join(F.broadcast(H.platt_fit(s, ["class"])), "class").withColumn("prob", S.platt())
    out = M.ranking(fitted, ["class"]).join(H.best_f1_observed(fitted, ["class"]), "class").withColumn("tier", H.assign_tier())
    return rounded(out.select("class", "positives", "auroc", "cutoff", "f1", "tier"), "auroc", "cutoff", "f1", n=4)


@query("H14_calibration_audit", SQL_ARMS + f", aud as (select * from arms where record_id % 10 = 9), {sql_report('aud', 'arm')} select arm, {SQL_METRICS} from m")
def _(spark, sf):
    audit = arms(spark, sf).where("record_id % 10 = 9")
    return rounded(M.multilabel_report(audit, ["arm"]), *METRICS)


@query("H15_arm_report", SQL_ARMS + f""", {sql_candidates('arms', 'arm, class')}, {sql_rates('arms', 'arm, class')}, inherited as (select arm, class, {sql_counts('prob >= 0.5::double')}, quantile_cont(prob, 0.5) filter (y = 1) as med1, quantile_cont(prob, 0.5) filter (y = 0) as med0 from arms group by arm, class),
best as (select arm, class, cutoff, f1 from (select *, row_number() over (partition by arm, class order by round(f1, 12) desc, cutoff) as place from rates) where place = 1)
select arm, class, tp, fp, tn, fn, round(med1, 6) as median_positive, round(med0, 6) as median_negative, round(cutoff, 6) as best_cutoff, round(f1, 6) as best_f1 from inherited join best using (arm, class)""")
def _(spark, sf):
    return rounded(_arm_report(spark, sf), "median_positive", "median_negative", "best_cutoff", "best_f1")


def _arm_report(spark, sf):
    rows, by = arms(spark, sf), ["arm", "class"]
    med = lambda v: F.percentile(F.when(F.col("y") == v, F.col("prob")), 0.5)
    inherited = rows.groupBy(*by).agg(*M.counts(F.col("prob") >= 0.5), med(1).alias("median_positive"), med(0).alias("median_negative"))
    best = H.best_fbeta(rows, by).select(*by, F.col("cutoff").alias("best_cutoff"), F.col("score").alias("best_f1"))
    return inherited.join(best, by)


@query("H16_sensitivity_gap", SQL_ARMS + f""", {sql_candidates('arms', 'arm, class')}, {sql_rates('arms', 'arm, class')}, inherited as (select arm, class, count(*) filter (prob >= 0.5::double and y = 1)::double / count(*) filter (y = 1) as sens, count(*) filter (prob < 0.5::double and y = 0)::double / count(*) filter (y = 0) as spec from arms group by arm, class),
clean as (select class, sens as clean_sens, spec as clean_spec from inherited where arm = 'clean'), iso as (select arm, class, max(sensitivity) as iso_sensitivity from rates join clean using (class) where specificity >= clean_spec - 1e-12 group by arm, class)
select arm, class, round(clean_sens - sens, 6) as gap, round(clean_sens - iso_sensitivity, 6) as iso_gap, round(sens * 0.05::double * 1000, 6) as true_alerts, round((1 - spec) * 0.95::double * 1000, 6) as false_alerts from inherited join iso using (arm, class) join clean using (class)""")
def _(spark, sf):
    rows, by = arms(spark, sf), ["arm", "class"]
    at = M.with_rates(rows.groupBy(*by).agg(*M.counts(F.col("prob") >= 0.5)))
    clean = at.where("arm = 'clean'").select("class", F.col("sensitivity").alias("clean_sens"), F.col("specificity").alias("clean_spec"))
    rates = H.rates_at(rows, H.candidates(rows, by), by)
    iso = rates.join(clean, "class").where("specificity >= clean_spec - 1e-12D").groupBy(*by).agg(F.max("sensitivity").alias("iso"))
    burden = H.alert_burden(F.col("sensitivity"), F.col("specificity"), 0.05)[:2]
    out = at.join(iso, by).join(clean, "class").select(*by, (F.col("clean_sens") - F.col("sensitivity")).alias("gap"), (F.col("clean_sens") - F.col("iso")).alias("iso_gap"), *burden)
    return rounded(out, "gap", "iso_gap", "true_alerts", "false_alerts")


@query("F10_alert_burden", f"with $doc_scores, c as (select lang, {sql_counts('prob >= 0.5::double')} from doc_scores group by lang), r as (select lang, case when tp + fn = 0 then 0 else tp::double / (tp + fn) end as se, case when tn + fp = 0 then 0 else tn::double / (tn + fp) end as sp from c) select lang, round(se * 20, 6) as true_alerts, round((1 - sp) * 980, 6) as false_alerts, round((se * 20 + (1 - sp) * 980) / nullif(se * 20, 0), 6) as alerts_per_true from r")
def _(spark, sf):
    r = M.with_rates(doc_scores(spark, sf).groupBy("lang").agg(*M.counts(F.col("prob") >= 0.5)))
    return rounded(r.select("lang", *H.alert_burden(F.col("sensitivity"), F.col("specificity"), 0.02)), "true_alerts", "false_alerts", "alerts_per_true")


@query("F11_prevalence_weight", "with $doc_scores, c as (select lang, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from doc_scores group by lang) select lang, pos, neg, round(case when pos > 0 and neg > 0 then pos * 0.95::double / 0.05::double / neg end, 6) as weight from c")
def _(spark, sf):
    return rounded(H.prevalence_weight(doc_scores(spark, sf), ["lang"], 0.05), "weight")


@query("H8_bootstrap_mean", f"with $doc_scores, units as (select record_id, sum(prob) as a, count(*)::double as b from doc_scores group by record_id), {sql_bootstrap('units', 'record_id')} select estimate, n_units, low, high, n_replicates from boot")
def _(spark, sf):
    # every record is a unit of its own
    s = doc_scores(spark, sf).withColumn("one", F.lit(1))
    return rounded(H.bootstrap_interval(s, "record_id", [], "prob", "one"), "estimate", "low", "high", n=4)


@query("H9_cluster_bootstrap", f"with $doc_scores, units as (select lang, source, count(*) filter (prob >= 0.5::double)::double as a, count(*)::double as b from doc_scores where y = 1 group by lang, source), {sql_bootstrap('units', 'source', 'lang')} select lang, estimate, n_units, low, high, n_replicates from boot")
def _(spark, sf):
    rows = doc_scores(spark, sf).where("y = 1").withColumns({"hit": (F.col("prob") >= 0.5).cast("int"), "one": F.lit(1)})
    return rounded(H.bootstrap_interval(rows, "source", ["lang"], "hit", "one"), "estimate", "low", "high", n=4)


@query("H9_bootstrap_auroc", f"""with $doc_scores, counted as (select source, prob, sum(y)::double as pos, sum(1 - y)::double as neg from doc_scores group by source, prob), drawn as (select c.*, replicate, {sql_poisson(7, 'replicate', 'source')[0]} from counted c, (select unnest(range(0, 100)) as replicate)),
ties as (select replicate, prob, sum(w * pos) as pos, sum(w * neg) as neg from (select *, {sql_poisson(7, 'replicate', 'source')[1]} as w from drawn) where w > 0 group by replicate, prob),
run as (select *, coalesce(sum(neg) over (partition by replicate order by prob rows between unbounded preceding and 1 preceding), 0) as below from ties),
value as (select sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as value from run group by replicate having sum(pos) > 0 and sum(neg) > 0)
select round(quantile_cont(value, 0.025), 4) as low, round(quantile_cont(value, 0.5), 4) as mid, round(quantile_cont(value, 0.975), 4) as high, count(*) as n_replicates from value""")
def _(spark, sf):
    auroc = lambda ties, by: M.ranking_of(ties, by).select(*by, F.col("auroc").alias("value"))
    return rounded(H.bootstrap_metric(doc_scores(spark, sf), "source", auroc, 100), "low", "mid", "high", n=4)


@query("H17_strategy_comparison", f"""with $scores, fit as (select * from scores where record_id % 5 < 4), held as (select * from scores where record_id % 5 = 4), {sql_candidates('fit', 'class')}, {sql_rates('fit', 'class')},
places as (select class, cutoff, row_number() over (partition by class order by round(f1, 12) desc, cutoff) as f1, row_number() over (partition by class order by (sensitivity >= 0.9::double) desc, case when sensitivity >= 0.9::double then -specificity end, cutoff) as sensitivity,
  row_number() over (partition by class order by (specificity >= 0.9::double) desc, case when specificity >= 0.9::double then -sensitivity end, case when specificity >= 0.9::double then cutoff else -cutoff end) as specificity from rates),
cuts as (select class, 'f1' as strategy, cutoff from places where f1 = 1 union all select class, 'sensitivity', cutoff from places where sensitivity = 1 union all select class, 'specificity', cutoff from places where specificity = 1),
c as (select strategy, class, {sql_counts('prob >= cutoff')} from held join cuts using (class) group by strategy, class) select strategy, class, tp, fp, tn, fn, {SQL_RATES.replace(', 6)', ', 4)')} from c""")
def _(spark, sf):
    s = scores(spark, sf)
    fit, held = s.where("record_id % 5 < 4"), s.where("record_id % 5 = 4")
    cuts = H.best_fbeta(fit, ["class"]).select("class", F.lit("f1").alias("strategy"), "cutoff").unionByName(H.at_sensitivity(fit, ["class"], 0.9).select("class", F.lit("sensitivity").alias("strategy"), "cutoff")).unionByName(H.at_specificity(fit, ["class"], 0.9).select("class", F.lit("specificity").alias("strategy"), "cutoff"))
    out = M.with_rates(held.join(F.broadcast(cuts), "class").groupBy("strategy", "class").agg(*M.counts(F.col("prob") >= F.col("cutoff"))))
    return rounded(out, "sensitivity", "specificity", "ppv", "npv", "accuracy", "f1", n=4)


SQL_SWEEP = f"""with $scores, cells as (select class, record_id % 3 as fold, record_id % 2 as seed, 'a' as arm, y, prob from scores union all select class, record_id % 3, record_id % 2, 'b', y, prob from scores_b),
{sql_ranking('rk', 'cells', 'arm, fold, seed, class')}, cell as (select arm, fold, seed, avg(average_precision) as value from rk group by arm, fold, seed)"""


def sweep(spark, sf):
    """Macro average precision of two arms over folds and seeds."""
    cells = scores(spark, sf).withColumn("arm", F.lit("a")).unionByName(scores_b(spark, sf).withColumn("arm", F.lit("b"))).withColumns({"fold": F.col("record_id") % 3, "seed": F.col("record_id") % 2})
    return M.ranking(cells, ["arm", "fold", "seed", "class"]).groupBy("arm", "fold", "seed").agg(F.avg("average_precision").alias("value"))


@query("A27_sweep_arms", SQL_SWEEP + " select arm, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd from cell group by arm")
def _(spark, sf):
    return rounded(sweep(spark, sf).groupBy("arm").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "mean", "sd")


def _paired(spark, sf):
    s = sweep(spark, sf)
    return s.where("arm = 'a'").select("fold", "seed", F.col("value").alias("a")).join(s.where("arm = 'b'").select("fold", "seed", F.col("value").alias("b")), ["fold", "seed"]).withColumn("delta", F.col("b") - F.col("a"))


SQL_DELTA = SQL_SWEEP + ", p as (select a.fold, a.seed, b.value - a.value as delta from cell a join cell b on a.fold = b.fold and a.seed = b.seed and a.arm = 'a' and b.arm = 'b')"


@query("J13_paired_cells", SQL_DELTA + " select fold, seed, round(delta, 6) as delta from p")
def _(spark, sf):
    return rounded(_paired(spark, sf).select("fold", "seed", "delta"), "delta")


@query("H18_paired_test", SQL_DELTA + f""", k as (select *, rank() over (order by round(abs(delta), 12)) + (count(*) over (partition by round(abs(delta), 12)) - 1) / 2::double as r from p where delta <> 0),
a as (select count(*) as n, count(*) filter (delta > 0) as wins, avg(delta) as mean, stddev_samp(delta) as sd, avg(delta) / (stddev_samp(delta) / sqrt(count(*))) as t from p), {sql_t_p('a', 't', 'n - 1', 'tp')}, l as (select list(r) as rs, least(coalesce(sum(r) filter (delta > 0), 0), coalesce(sum(r) filter (delta < 0), 0)) as w from k),
-- every choice of signs is a number with a bit for each rank
signs as (select w, list_sum(list_transform(rs, lambda r, i: case when (j >> (i - 1)) & 1 = 1 then r else 0 end)) as s from l, (select unnest(range(0, (select 2 ** count(*) from k)::bigint)) as j)),
wp as (select any_value(w) as w, least(1, 2 * avg(case when s <= w then 1 else 0 end)) as w_p from signs)
select n, wins, round(mean, 6) as mean, round(sd, 6) as sd, round(t, 4) as t, round(p, 6) as t_p, round(w, 6) as w, round(case when n >= 5 then w_p end, 6) as w_p from tp, wp""")
def _(spark, sf):
    return rounded(rounded(M.paired_test(_paired(spark, sf), [], "delta"), "mean", "sd", "t_p", "w", "w_p"), "t", n=4)
