"""Queries that scan, derive keys, project and write tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import caches as K
from ..operators import cohort as C
from ..operators import manifests as N
from ..operators import scans as A
from ..operators import tables as T
from . import decisions
from .proxies import audit, read, scores
from .registry import query


@query("S1_dict_literal_scan", "select event_id, cast(props::json->>'k' as double) as k from events")
def _(spark, sf):
    # the JSON text written as a dictionary literal with single quotes
    literal = read(spark, sf, "events").select("event_id", F.translate("props", '"', "'").alias("props"))
    return literal.select("event_id", T.dict_literal(F.col("props"))["k"].alias("k"))


def _metadata(spark, sf):
    """Event lines as CSV: some ids are no numbers, some are missing, some literals are cut off or hold no numbers, some lines are too long."""
    path = _scratch(spark, "metadata")
    k = F.col("event_id")
    literal = F.translate("props", '"', "'")
    text = F.when(k % 89 == 1, F.concat(literal, F.lit("{"))).when(k % 89 == 2, "{'k': 'high'}").when(k % 89 == 3, None).otherwise(literal)
    ident = F.when(k % 97 == 4, F.concat(F.lit("x"), k.cast("string"))).when(k % 97 == 5, "").otherwise(k.cast("string"))
    cells = F.concat_ws(",", ident, F.coalesce(text, F.lit("")), F.col("user_id").cast("string"), F.when(k % 101 == 6, "more"))
    read(spark, sf, "events").select(cells.alias("value")).write.text(path)
    return A.metadata_csv(spark, path, "event_id long, props string, user_id long", "event_id", "props", header=False)


SQL_META = """m as (select *, case when event_id % 101 = 6 then 'line' when event_id % 97 = 4 then 'value' when event_id % 97 = 5 then 'key' when event_id % 89 in (1, 2) then 'literal' end as reason from events)"""


@query("S1_csv_scan", f"with {SQL_META} select event_id, user_id, case when event_id % 89 <> 3 then cast(props::json->>'k' as double) end as k from m where reason is null")
def _(spark, sf):
    return _metadata(spark, sf)[0].select("event_id", "user_id", F.col("props")["k"].alias("k"))


@query("S1_csv_rejects", f"with {SQL_META} select reason, count(*) as n, count(*) as n_lines from m where reason is not null group by reason")
def _(spark, sf):
    return _metadata(spark, sf)[1].groupBy("reason").agg(F.count("*").alias("n"), F.count("line").alias("n_lines"))


@query("S2_label_vectors", "with $scores select record_id, cast(sum(y) as bigint) as positives from scores group by record_id")
def _(spark, sf):
    texts = scores(spark, sf).groupBy("record_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "y"))), lambda x: x["y"])).alias("labels_json"))
    return T.label_vectors(texts, "labels_json", "record_id", 6).select("record_id", F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("positives"))


@query("S3_strict_inventory", "select n_nationkey, n_name, n_regionkey from nation")
def _(spark, sf):
    nation = read(spark, sf, "nation")
    return T.strict_columns(nation.select("n_regionkey", "n_nationkey", "n_name"), ["n_nationkey", "n_name", "n_regionkey"])


@query("S4_int16_frames", "select vec_id, cast((k - 1) % 4 as bigint) as lead_idx, cast((k - 1) // 4 as bigint) as i, round(cast(floor(embedding[k] * 1000) as double) / 1000, 6) as mv from (select vec_id, embedding, unnest(range(1, 65)) as k from embeddings)")
def _(spark, sf):
    # 16 samples of 4 leads, written as little-endian int16
    value = lambda x: F.pmod(F.floor(x * 1000).cast("long"), F.lit(65536))
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    text = F.array_join(F.transform("embedding", lambda x: F.concat(byte(value(x.cast("double")) % 256), byte(F.floor(value(x.cast("double")) / 256)))), "")
    frames = read(spark, sf, "embeddings").select("vec_id", F.unhex(text).alias("content"))
    return T.int16_frames(frames, "content", 4, 16).select("vec_id", F.col("lead_idx").cast("long").alias("lead_idx"), F.col("i").cast("long").alias("i"), F.round("mv", 6).alias("mv"))


@query("S5_oriented_records", "select vec_id, cast(l as int) as lead_idx, cast(i as int) as i, round(embedding[l * 16 + i + 1]::double, 6) as mv from (select *, unnest(range(0, 16)) as i from (select vec_id, embedding, unnest(range(0, 4)) as l from embeddings))")
def _(spark, sf):
    v = read(spark, sf, "embeddings")
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16))
    turned = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.element_at("embedding", k * 16 + i + 1)))
    mixed = v.select("vec_id", F.when(F.col("vec_id") % 2 == 0, rows).otherwise(turned).alias("matrix"))
    return T.oriented(mixed, "matrix", 4).select("vec_id", "lead_idx", "i", F.round(F.col("mv").cast("double"), 6).alias("mv"))


@query("S6_fingerprints", "select doc_id, sha256(text) as sha256 from documents where text is not null")
def _(spark, sf):
    return T.fingerprints(read(spark, sf, "documents").where("text is not null").select("doc_id", "text"), "text").select("doc_id", "sha256")


@query("S7_expected_hash", "select item_id from benchmark")
def _(spark, sf):
    b = read(spark, sf, "benchmark").withColumn("expected", F.upper(F.sha2(F.col("text").cast("binary"), 256)))
    return T.expect_hash(T.fingerprints(b, "text"), "sha256", "expected").select("item_id")


@query("S8_natural_order", "with s as (select case when p_partkey % 3 = 0 then 'case' || p_partkey else p_partkey::varchar end as stem from part) select stem, row_number() over (order by try_cast(stem as bigint) is null, try_cast(stem as bigint), stem) as place from s order by place limit 500")
def _(spark, sf):
    stems = read(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("case"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("stem"))
    first = stems.orderBy(*T.natural_order("stem")).limit(500)
    from pyspark.sql.window import Window

    return first.withColumn("place", F.row_number().over(Window.orderBy(*T.natural_order("stem"))))  # 500 rows


@query("S9_sweep_scan", "with $scores, c as (select class || '_f' || (record_id % 3) || '_s' || (record_id % 2) || '.json' as file, prob from scores) select regexp_extract(file, '^(\\w+)_f(\\d+)_s(\\d+)\\.json$', 1) as arm, cast(regexp_extract(file, '_f(\\d+)_', 1) as int) as fold, cast(regexp_extract(file, '_s(\\d+)\\.', 1) as int) as seed, count(*) as n from c group by 1, 2, 3")
def _(spark, sf):
    k = F.col("record_id")
    name = F.concat("class", F.lit("_f"), (k % 3).cast("string"), F.lit("_s"), (k % 2).cast("string"), F.lit(".json"))
    return scores(spark, sf).select(name.alias("file")).select(*T.sweep_key(F.col("file"))).groupBy("arm", "fold", "seed").agg(F.count("*").alias("n"))


SQL_CELLS = """g as (select class, record_id % 3 as fold, record_id % 2 as seed, count(*) as n, sum(y) as positives from scores group by all),
c as (select *, case when fold = 1 and class like 'F%' then 'name' when fold = 2 and seed = 1 then 'json' when class = 'OR' then 'field' end as reason from g)"""


def _sweep(spark, sf):
    """A folder with one JSON file for each cell of class, fold and seed; some are cut off, misnamed or lack a field."""
    path = _scratch(spark, "sweep")
    k = F.col("record_id")
    g = scores(spark, sf).groupBy("class", (k % 3).alias("fold"), (k % 2).alias("seed")).agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    name = F.concat("class", F.when((F.col("fold") == 1) & F.col("class").startswith("F"), "-").otherwise("_"), F.lit("f"), "fold", F.lit("_s"), "seed", F.lit(".json"))
    text = F.when(F.col("class") == "OR", F.to_json(F.struct("n"))).otherwise(F.to_json(F.struct("n", "positives")))
    text = F.when((F.col("fold") == 2) & (F.col("seed") == 1), F.concat(F.lit("{"), text)).otherwise(text)
    g.select(text.alias("value"), name.alias("cell")).write.partitionBy("cell").text(path)  # 36 cells
    return A.sweep_files(spark, path, "n long, positives long")


@query("S9_sweep_files", f"with $scores, {SQL_CELLS} select class as arm, cast(fold as int) as fold, cast(seed as int) as seed, n, cast(positives as bigint) as positives from c where reason is null")
def _(spark, sf):
    return _sweep(spark, sf)[0].select("arm", "fold", "seed", "n", "positives")


@query("S9_sweep_rejects", f"with $scores, {SQL_CELLS} select class || case when reason = 'name' then '-' else '_' end || 'f' || fold || '_s' || seed || '.json' as cell, reason from c where reason is not null")
def _(spark, sf):
    return _sweep(spark, sf)[1].select(F.regexp_extract("file", "cell=([^/]+)/", 1).alias("cell"), "reason")


def _scratch(spark, name):
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``."""
    import tempfile
    import uuid

    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if held is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors would not see a local folder")
    held = held or tempfile.mkdtemp(prefix="reports-")
    return f"{held}/{name}-{uuid.uuid4().hex}"


@query("S10_report_sink", "with $gated select cast(image_id as varchar) as image_id, prediction, case when len(codes) = 0 then '[]' else '[\"' || array_to_string(codes, '\",\"') || '\"]' end as reason_codes from gated")
def _(spark, sf):
    path = _scratch(spark, "report")
    T.write_report(decisions.gated(spark, sf).select("image_id", "prediction", "reason_codes"), path)
    return spark.read.option("header", True).option("escape", '"').schema("image_id string, prediction string, reason_codes string").csv(f"{path}/csv")


@query("S11_manifest_sink", "select s_suppkey, s_name from supplier")
def _(spark, sf):
    path = _scratch(spark, "manifest")
    T.write_manifest(read(spark, sf, "supplier").select("s_suppkey", "s_name"), path)
    return spark.read.schema("s_suppkey long, s_name string").json(path)


@query("S12_validity_cache", "with $audit select image_id, median_correlation, coalesce(status = 'success' and median_correlation is not null, false) as valid from audit")
def _(spark, sf):
    rows = T.with_validity(audit(spark, sf), (F.col("status") == "success") & F.col("median_correlation").isNotNull()).select("image_id", "median_correlation", "valid")
    path = _scratch(spark, "cache")
    T.cached(rows, path)
    return T.cached(rows.limit(0), path)  # what is there is read, not made again


def _made(rows):
    """What a preprocessing step makes of audit records: a number, or why there is none."""
    error = F.when(F.col("status") != "success", "failed").when(F.col("median_correlation").isNull(), "no correlation")
    return rows.select("image_id", F.when(error.isNull(), F.round(F.col("median_correlation") * 100)).cast("int").alias("percent"), error.alias("error"))


def _refreshed(spark, sf):
    """A cache made of one state of the records, then refreshed with another: digests and hints changed, records gone and new."""
    path = _scratch(spark, "refreshed")
    k = F.col("image_id")
    ways = audit(spark, sf).withColumns({"version": F.lit("1"), "mode": F.lit("m"), "hint": F.when(k % 8 != 0, "h")})
    first = ways.where(k % 50 != 7).withColumn("digest", F.lit("d"))
    K.refresh(first, path, "image_id", _made)
    second = ways.where(k % 50 != 9).withColumns({"digest": F.when(k % 10 == 3, "e").otherwise("d"), "hint": F.when(k % 16 == 0, "g").otherwise(F.col("hint"))})
    K.refresh(second, path, "image_id", _made)
    return path


SQL_CACHE = """w as (select image_id, case when status <> 'success' then 'failed' when median_correlation is null then 'no correlation' end as error, cast(round(median_correlation * 100) as int) as percent,
 case when image_id % 50 = 7 or image_id % 10 = 3 or image_id % 16 = 0 then 2 else 1 end as made from audit where image_id % 50 <> 9)"""


@query("S12_refreshed_cache", f"with $audit, {SQL_CACHE} select image_id, percent, made as refresh from w where error is null")
def _(spark, sf):
    return K.values(spark, _refreshed(spark, sf), "image_id").select("image_id", "percent", "refresh")


@query("S12_cache_failures", f"with $audit, {SQL_CACHE} select image_id, error from w where error is not null")
def _(spark, sf):
    return K.failures(spark, _refreshed(spark, sf), "image_id")


SQL_SUB = "with $scores, sub as (select record_id, class, case when record_id % 17 <> 0 and prob >= 0.6::double then 1 else 0 end as decision from scores)"


def _submitted(spark, sf):
    path = _scratch(spark, "submission")
    rows = T.with_validity(scores(spark, sf), F.col("record_id") % 17 != 0)
    T.write_submission(T.submission(rows, 0.6).select("record_id", "class", "decision"), path, ["class"])
    return path


@query("S13_submission", f"{SQL_SUB} select record_id, class, decision from sub")
def _(spark, sf):
    return spark.read.option("header", True).schema("record_id long, class string, decision int").csv(f"{_submitted(spark, sf)}/rows")


@query("S13_submission_metadata", f"{SQL_SUB} select class, count(*) as n, cast(sum(decision) as bigint) as positives, round(avg(decision), 6) as positive_rate from sub group by class")
def _(spark, sf):
    meta = spark.read.schema("class string, n long, positives long, positive_rate double").json(f"{_submitted(spark, sf)}/metadata")
    return meta.withColumn("positive_rate", F.round("positive_rate", 6))


URL = "u as (select page_id, regexp_replace(url, '^https?://', '') as p from pages)"


@query("P4_leading_segment", f"with {URL} select page_id, split_part(p, '/', 1) as category from u")
def _(spark, sf):
    path = F.regexp_replace("url", "^https?://", "")
    return read(spark, sf, "pages").select("page_id", T.leading_segment(path).alias("category"))


@query("P5_reference_key", "select o_orderkey, case when o_orderpriority like '1-%' then 'ref_' || replace(o_clerk_, '1-', '') else o_clerk_ end as k from (select o_orderkey, o_orderpriority, case when o_orderkey % 2 = 0 then '1-' || o_orderkey else o_orderkey::varchar end as o_clerk_ from orders)")
def _(spark, sf):
    ident = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1-"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    return read(spark, sf, "orders").select("o_orderkey", T.reference_key(F.col("o_orderpriority"), ident, "1-", "ref_").alias("k"))


@query("P6_case_and_variant", "with s as (select p_partkey, case when p_partkey % 3 = 0 then 'c' || p_partkey else 'c' || p_partkey || '__v' || (p_partkey % 5) || '__x' end as stem from part) select p_partkey, split_part(stem, '__', 1) as case_id, case when contains(stem, '__') then substr(stem, instr(stem, '__') + 2) else 'original' end as variant from s")
def _(spark, sf):
    k = F.col("p_partkey")
    base = F.concat(F.lit("c"), k.cast("string"))
    stems = read(spark, sf, "part").select("p_partkey", F.when(k % 3 == 0, base).otherwise(F.concat(base, F.lit("__v"), (k % 5).cast("string"), F.lit("__x"))).alias("stem"))
    return stems.select("p_partkey", *[c.alias(n) for n, c in T.case_and_variant("stem").items()])


@query("P7_layout_suffix", "with l as (select p_partkey, case p_partkey % 2 when 0 then '3x4+1R' else '6x2' end as layout, case p_partkey % 3 when 0 then 'raw' else 'full' end as mode from part) select p_partkey, case when mode = 'raw' then regexp_replace(layout, '\\+1R$', '') else layout end as layout from l")
def _(spark, sf):
    k = F.col("p_partkey")
    layout, mode = F.when(k % 2 == 0, "3x4+1R").otherwise("6x2"), F.when(k % 3 == 0, "raw").otherwise("full")
    return read(spark, sf, "part").select("p_partkey", T.layout_without_rhythm(layout, mode, "raw").alias("layout"))


SQL_HINT = "h as (select p_partkey, (['3x4', 'Unknown', 'AUTO', '6x2'])[p_partkey % 4 + 1] as layout from part)"


def _hints(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ["3x4", "Unknown", "AUTO", "6x2"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("layout"))


@query("P8_layout_hints", f"with {SQL_HINT} select p_partkey, layout from h where lower(layout) not in ('unknown', 'auto')")
def _(spark, sf):
    return _hints(spark, sf).withColumn("layout", T.known_hint(F.col("layout"))).where("layout is not null")


@query("P19_layout_match", f"with {SQL_HINT} select p_partkey, coalesce(case when lower(layout) not in ('unknown', 'auto') then layout end, case when p_partkey % 5 = 0 then '3x4' when p_partkey % 5 = 1 then '6x2' end) as layout from h")
def _(spark, sf):
    text = F.when(F.col("p_partkey") % 5 == 0, "page of 3x4 with rhythm").when(F.col("p_partkey") % 5 == 1, "6x2 page").otherwise("page")
    return _hints(spark, sf).select("p_partkey", T.match_layout(text, T.known_hint(F.col("layout"))).alias("layout"))


@query("P9_reusable_records", "with $audit select count(*) as n from audit where status = 'success' and image_id % 3 = 1 and (case when image_id % 4 = 0 then null else 'h' end) is not distinct from (case when image_id % 8 = 0 then null else 'h' end)")
def _(spark, sf):
    k = F.col("image_id")
    r = audit(spark, sf).withColumns({"version": (k % 3).cast("string"), "mode": F.lit("m"), "digest": F.lit("d"), "hint": F.when(k % 4 != 0, "h")})
    return r.where(T.is_reusable(F.lit("1"), F.lit("m"), F.lit("d"), F.when(k % 8 != 0, "h"))).agg(F.count("*").alias("n"))


@query("P10_saved_signals", "select vec_id, len(list_filter(embedding, lambda x: abs(x) > 0.3)) >= 3 as active, len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x))) = 0 as sound from embeddings")
def _(spark, sf):
    return T.signal_state(read(spark, sf, "embeddings"), "embedding", 64, 0.3, 3).select("vec_id", "active", "sound")


@query("P16_flat_records", "with $audit select image_id, category, status, case when status = 'success' then layout_cost end as layout_cost, case when status = 'success' then median_correlation end as median_correlation, case when status = 'success' then median_rmse_mv end as median_rmse_mv from audit")
def _(spark, sf):
    ok = F.col("status") == "success"
    nested = audit(spark, sf).select("image_id", "category", "status", F.when(ok, F.struct("layout_cost", "raw_lines_count")).alias("diagnostics"), F.when(ok, F.struct("median_correlation", F.struct("median_rmse_mv").alias("absolute"))).alias("fidelity"))
    return T.flat(nested, ["image_id", "category", "status", "diagnostics.layout_cost", "fidelity.median_correlation", "fidelity.absolute.median_rmse_mv"])


@query("F7_content_address", """with r as (select sha256(s_name || '|' || s_suppkey) as r from supplier), p as (select substr(r, 1, 3) as p, sha256(string_agg(r, '' order by r)) as d, count(*) as n from r group by 1) select sha256(string_agg(p || d, '' order by p)) as manifest_id, cast(sum(n) as bigint) as n from p""")
def _(spark, sf):
    return C.content_address(read(spark, sf, "supplier"), ["s_suppkey", "s_name"])


SQL_MAN = """m as (select p_partkey as k, case when p_partkey % 11 = 0 then 'John' else 'case_' || (p_partkey % 400) end as case_id, 'ph' || (p_partkey % 1990) as photo_id, (['flat', 'angled', 'wild'])[p_partkey % 3 + 1] as variant, case when p_partkey % 400 = 7 and p_partkey % 2 = 1 then 'test' when p_partkey % 97 = 0 then 'other' else 'tune' end as split,
 case when p_partkey % 13 = 0 then '/abs/x' when p_partkey % 17 = 0 then 'a/../b' else 'img/' || p_partkey || '.png' end as path, case when p_partkey % 19 = 0 then upper(sha256(p_name)) else sha256(p_name) end as sha256, case when p_partkey % 23 = 0 then 'yes' else ' True ' end as phi from part)"""


def _manifest(spark, sf):
    k = F.col("p_partkey")
    text = k.cast("string")
    digest = F.sha2("p_name", 256)
    return read(spark, sf, "part").select(
        k.alias("k"), F.when(k % 11 == 0, "John").otherwise(F.concat(F.lit("case_"), (k % 400).cast("string"))).alias("case_id"), F.concat(F.lit("ph"), (k % 1990).cast("string")).alias("photo_id"),
        F.element_at(F.array(*map(F.lit, ["flat", "angled", "wild"])), (k % 3 + 1).cast("int")).alias("variant"), F.when((k % 400 == 7) & (k % 2 == 1), "test").when(k % 97 == 0, "other").otherwise("tune").alias("split"),
        F.when(k % 13 == 0, "/abs/x").when(k % 17 == 0, "a/../b").otherwise(F.concat(F.lit("img/"), text, F.lit(".png"))).alias("path"), F.when(k % 19 == 0, F.upper(digest)).otherwise(digest).alias("sha256"), F.when(k % 23 == 0, "yes").otherwise(" True ").alias("phi_reviewed"),
    )


@query("F8_safe_paths", f"with {SQL_MAN} select k, not (path like '/%') and not list_contains(string_split(path, '/'), '..') and path <> '' as safe, regexp_full_match(sha256, '[0-9a-f]{{64}}') as sound from m")
def _(spark, sf):
    return _manifest(spark, sf).select("k", C.safe_path(F.col("path")).alias("safe"), F.col("sha256").rlike(C.SHA_PATTERN).alias("sound"))


@query("F9_strict_boolean", f"with {SQL_MAN} select k, lower(trim(phi)) = 'true' as reviewed from m")
def _(spark, sf):
    return _manifest(spark, sf).select("k", C.strict_true(F.col("phi_reviewed")).alias("reviewed"))


SQL_ERRORS = f"""{SQL_MAN}, checks as (select case_id, unnest([struct_pack(field := 'case_id', rule := 'pattern', ok := regexp_full_match(case_id, 'case_[0-9]+')), struct_pack(field := 'phi_reviewed', rule := 'flag', ok := lower(trim(phi)) = 'true'), struct_pack(field := 'variant', rule := 'choice', ok := variant in ('flat', 'angled')),
 struct_pack(field := 'split', rule := 'choice', ok := split in ('tune', 'test')), struct_pack(field := 'path', rule := 'path', ok := not (path like '/%' or list_contains(string_split(path, '/'), '..') or path = '')), struct_pack(field := 'sha256', rule := 'digest', ok := regexp_full_match(sha256, '[0-9a-f]{{64}}'))]) as c from m),
errors as (select case_id, c.field as field, c.rule as rule from checks where not c.ok union all select case_id, 'split', 'leak' from m group by case_id having count(distinct split) > 1 union all select min(case_id), 'photo_id', 'repeat' from m group by photo_id having count(*) > 1)"""


@query("D18_manifest_validation", f"with {SQL_ERRORS} select field, rule, count(*) as n, count(distinct case_id) as n_cases from errors group by field, rule")
def _(spark, sf):
    e = C.manifest_errors(_manifest(spark, sf), ["flat", "angled"], ["tune", "test"], r"^case_[0-9]+$")
    return e.groupBy("field", "rule").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"))


RULES = N.SetRules(required_splits=("tune", "test"), splits=("tune", "test", "spare"), least_cases=10**9, least_sources=3)
SQL_SETS = """m as (select p_partkey as k, 'case' || lpad((p_partkey % 500)::varchar, case when p_partkey % 500 = 77 then 2 else 3 end, '0') as case_id, 'ph' || (p_partkey % 1990) as photo_id, (['front', 'angle', 'wild'])[p_partkey % 3 + 1] as variant,
 case when p_partkey % 7 = 0 then ' ' else '3x4' end as layout, 'd' as device_model, case when p_partkey % 2 = 0 then 'p' else 'q' end as printer_model, 'img/' || p_partkey || '.png' as photo_path, sha256(p_name) as photo_sha256,
 case when p_partkey % 11 = 0 then null else 'flatbed_scan' end as reference_type, case when p_partkey % 13 = 0 then '../r' else 'ref/' || (p_partkey % 500) end as reference_path,
 case when p_partkey % 997 = 5 then upper(sha256('r')) else sha256('r' || (p_partkey % 500)) end as reference_sha256, case when p_partkey % 500 < 100 then 'spare' when p_partkey % 211 = 3 then 'other' else 'tune' end as split, p_partkey % 17 <> 0 as phi_reviewed, 'x' as barcode from part),
f as (select 'img/' || p_partkey || '.png' as path, case when p_partkey % 31 = 0 then sha256('z') else sha256(p_name) end as found from part where p_partkey % 29 <> 0 union all select 'ref/' || k, sha256('r' || k) from (select unnest(range(0, 490)) as k)),
checks as (select case_id, unnest([struct_pack(field := 'case_id', rule := 'pattern', ok := regexp_full_match(case_id, 'case[0-9]{3,}')), struct_pack(field := 'phi_reviewed', rule := 'flag', ok := phi_reviewed), struct_pack(field := 'variant', rule := 'choice', ok := variant in ('front', 'angle')),
 struct_pack(field := 'reference_type', rule := 'choice', ok := reference_type is not null), struct_pack(field := 'split', rule := 'choice', ok := split <> 'other'), struct_pack(field := 'layout', rule := 'empty', ok := trim(layout) <> ''), struct_pack(field := 'reference_path', rule := 'path', ok := reference_path not like '..%'),
 struct_pack(field := 'reference_sha256', rule := 'digest', ok := regexp_full_match(reference_sha256, '[0-9a-f]{64}'))]) as c from m),
v as (select case_id as subject, c.field as field, c.rule as rule from checks where not c.ok
 union all select '', 'barcode', 'forbidden' union all select '', 'case_id', 'too_few' union all select '', 'device_model', 'too_few' union all select 'test', 'split', 'empty_split'
 union all select case_id, 'split', 'leak' from m group by case_id having count(distinct split) > 1 union all select case_id, 'reference_sha256', 'references' from m group by case_id having count(distinct reference_sha256) > 1
 union all select photo_id, 'photo_id', 'repeat' from m group by photo_id having count(*) > 1
 union all select case_id, case when found is null then 'photo_path' else 'photo_sha256' end, case when found is null then 'absent' else 'differs' end from m left join f on path = photo_path where found is null or found <> photo_sha256
 union all select case_id, case when found is null then 'reference_path' else 'reference_sha256' end, case when found is null then 'absent' else 'differs' end from m left join f on path = reference_path where reference_path not like '..%' and (found is null or (found <> reference_sha256 and lower(reference_sha256) = reference_sha256)))"""


@query("D18_manifest_sets", f"with {SQL_SETS} select field, rule, count(*) as n, count(distinct subject) as n_subjects from v group by field, rule")
def _(spark, sf):
    part = read(spark, sf, "part")
    k, case = F.col("p_partkey"), F.col("p_partkey") % 500
    text = lambda c: c.cast("string")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    m = part.select(
        F.concat(F.lit("case"), F.lpad(text(case), 3, "0")).alias("c3"), F.concat(F.lit("ph"), text(k % 1990)).alias("photo_id"), F.element_at(F.array(*map(F.lit, ["front", "angle", "wild"])), (k % 3 + 1).cast("int")).alias("variant"),
        F.when(k % 7 == 0, " ").otherwise("3x4").alias("layout"), F.lit("d").alias("device_model"), F.when(k % 2 == 0, "p").otherwise("q").alias("printer_model"), F.concat(F.lit("img/"), text(k), F.lit(".png")).alias("photo_path"), sha(F.col("p_name")).alias("photo_sha256"),
        F.when(k % 11 != 0, "flatbed_scan").alias("reference_type"), F.when(k % 13 == 0, "../r").otherwise(F.concat(F.lit("ref/"), text(case))).alias("reference_path"),
        F.when(k % 997 == 5, F.upper(sha(F.lit("r")))).otherwise(sha(F.concat(F.lit("r"), text(case)))).alias("reference_sha256"), F.when(case < 100, "spare").when(k % 211 == 3, "other").otherwise("tune").alias("split"), (k % 17 != 0).alias("phi_reviewed"), F.lit("x").alias("barcode"),
    ).withColumn("case_id", F.when(F.col("c3") == "case077", "case77").otherwise(F.col("c3"))).drop("c3")
    photos = part.where(k % 29 != 0).select(F.concat(F.lit("img/"), text(k), F.lit(".png")).alias("path"), F.when(k % 31 == 0, sha(F.lit("z"))).otherwise(sha(F.col("p_name"))).alias("found"))
    references = spark.range(490).select(F.concat(F.lit("ref/"), text(F.col("id"))).alias("path"), sha(F.concat(F.lit("r"), text(F.col("id")))).alias("found"))
    v = N.violations(m, RULES, photos.unionByName(references))
    return v.groupBy("field", "rule").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"))


@query("D19_inventory_to_manifest", f"with {SQL_ERRORS}, f as (select p_partkey as k, sha256(p_name) as found from part where p_partkey % 29 <> 0) select m.k, case_id, path, found as sha256, split from m join f using (k) where case_id not in (select case_id from errors) and lower(m.sha256) = found")
def _(spark, sf):
    files = read(spark, sf, "part").where("p_partkey % 29 <> 0").select(F.col("p_partkey").alias("k"), "p_name")  # some files are missing
    found = T.fingerprints(files, "p_name").select("k", F.col("sha256").alias("found"))
    return C.built_manifest(_manifest(spark, sf), found, "k", ["flat", "angled"], ["tune", "test"], r"^case_[0-9]+$").select("k", "case_id", "path", "sha256", "split")


@query("L1_linear_probe")
def _(spark, sf):
    from ..operators import models as L

    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding", (F.col("label") % 2).cast("int").alias("y"), (F.col("vec_id") % 5 == 0).alias("held_out"))
    fitted = v.where("not held_out")
    probe = L.fit_probe(fitted, "embedding", "y")
    cutoff = L.probe_cutoff(fitted, probe, "embedding", "y")  # held-out rows have no say in it
    scored = L.probe_scores(v, probe, "embedding")
    return scored.select("record_id", "y", F.round("prob", 4).alias("prob"), "held_out", (F.col("prob") >= cutoff).cast("int").alias("decision"))


@query("L2_batch_scoring", "select vec_id, vec_id % 9 <> 0 and len(embedding) = 64 as valid, case when vec_id % 9 <> 0 and len(embedding) = 64 then round(1 / (1 + exp(-list_avg(list_transform(embedding, lambda x: x::double)))), 5) end as prob from embeddings")
def _(spark, sf):
    from ..operators import models as L

    v = read(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("embedding"))
    return L.batch_scores(v, "embedding", 64, L.mean_predictor).select("vec_id", "valid", F.round("prob", 5).alias("prob"))
