from pyspark.sql import functions as F

import corpus_pipeline as P
from wavecohort.llm import language_id, packing, quality_rules

from .plain import near_components, repeated_bytes


def test_each_stage_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["quality", "language", "near_duplicates", "repeats", "pack"]
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = P.written(stage(spark, docs, sf), "test")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "quality":
            old = spark.read.parquet(f"{sf}/documents.parquet")
            rules = quality_rules.learn_from(old, spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {r.doc_id for r in quality_rules.assessed(old, rules).collect() if r.kept}
        if name == "near_duplicates":
            assert set(after) == {c for _, c in near_components([(i, r.text) for i, r in before.items()]).values()}
        if name == "repeats":
            want = repeated_bytes([(i, r.text) for i, r in before.items()])
            assert set(after) == set(before)
            assert all((r.text == before[i].text) == (want[i][1] == 0) for i, r in after.items())
            assert all(r.n_chars == len(r.text) for i, r in after.items() if want[i][1])
        elif name != "language":
            assert all(r == before[i] for i, r in after.items())
    pieces = P.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_rejected_languages_go_and_clean_ones_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34", "en", "s", 5), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    kept = P.language(spark, docs.unionByName(odd), sf)
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {10**6, 10**6 + 1} and len(ids) > 0.97 * docs.count()
    assert language_id.T and packing.END_ID == 1


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


def test_odd_tables(spark, sf, tmp_path):
    """Nulls in every column, repeated ids and rows, empty and long texts, columns that stages use as names, and no rows at all."""
    given = spark.read.parquet(f"{sf}/documents.parquet")
    some = given.limit(60)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, "s", 0), (None, "the cat sat on the mat and then it went away again and again", "en", None, None), (2, "word " * 40_000, "en", "s", 200_000)], given.schema
    )
    docs = some.unionByName(some.limit(5)).unionByName(odd)
    for k, name in enumerate(("__stats", "__lang", "__gone", "__cut", "__left", "spans", "kept", "batch", "registers", "sequence_id")):
        docs = docs.withColumn(name, F.lit(k))
    for rows in (docs, docs.limit(0)):
        folder = str(tmp_path / ("rows" if rows is docs else "none"))
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        held = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in P.STAGES[:-1]:
            before = held
            held = P.written(stage(spark, held, folder), f"odd-{name}")
            assert held.columns == before.columns and held.count() <= before.count()
        out = P.STAGES[-1][1](spark, held, folder)
        assert out.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()
        assert (out.count() > 0) == (rows is docs)
