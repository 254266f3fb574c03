import random

import numpy as np

from wavecohort.llm import substring_dedup as D

from .plain import repeated_words


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equals_all_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = repeated_words(rows)
    assert sum(v[1] for v in want.values()) > 0
    assert result(D.digest(docs)) == want


def test_odd_rows_over_many_batches(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "é", "d"])
    passage = [word() for _ in range(130)]
    rows = [(k, " ".join([word() for _ in range(rng.randrange(60))] + passage[k % 40 : 60 + k % 80] + ["z"] * (k % 50))) for k in range(60)]
    rows += [(90, None), (91, ""), (92, " \n\t"), (93, "one " * 34), (94, "two " * 35), (95, "three\n" * 36), (96, "four " * 5000), (97, " ".join(map(str, range(35)))), (98, " ".join(map(str, range(36)))), (99, " ".join(map(str, range(300))) + " " + " ".join(map(str, range(100, 150))))]
    docs = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, spans string").withColumnRenamed("spans", "batch")
    found = D.duplicate_passages(docs, batch_bytes=900)
    assert found.columns == docs.columns + ["n_words", "spans", "kept"]
    want = repeated_words(rows)
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans)) for r in found.collect()} == {k: v[:2] for k, v in want.items()}
    assert result(D.digest(docs)) == want
    assert D.digest(docs.limit(0)).count() == 0
    # a repeated row's passage repeats; a row without id is a document like others
    long = " ".join(map(str, range(40)))
    more = spark.createDataFrame([(1, long), (1, long), (None, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in D.digest(more).collect()) == [(0, 0), (40, 40), (40, 40)]


def test_parse_equals_counts():
    rng = np.random.default_rng(8)
    for trial in range(200):
        segments = [rng.integers(0, 2 + trial % 3, rng.integers(1, 40)).astype(np.uint64) for _ in range(rng.integers(1, 8))]
        weight = rng.integers(1, 3, len(segments))
        h, offsets = np.concatenate(segments), np.cumsum([0] + [len(s) for s in segments])
        got = D.parse(h, offsets, weight, width=5)
        seen = {}
        for s, w in zip(segments, weight):
            for k in range(len(s) - 4):
                seen[tuple(s[k : k + 5])] = seen.get(tuple(s[k : k + 5]), 0) + w
        want = [k + 5 <= len(s) and seen[tuple(s[k : k + 5])] > 1 for s in segments for k in range(len(s))]
        assert got.tolist() == want, trial


def test_segments_of_a_common_line_are_split(spark):
    rng = random.Random(6)
    line = [f"line{k}" for k in range(34)]
    near = lambda: [f"n{rng.randrange(4000)}" for _ in range(3)]
    rows = [(k, " ".join([f"x{k}"] * 2 + near() + line + near() + [f"y{k}"] * 2)) for k in range(4000)]

    class Watched(D.Words):
        def resolve(self, anchor, weight, content):
            assert np.unique(anchor, return_counts=True)[1].max(initial=0) <= 1000, "an anchor's segments are in one block"
            return super().resolve(anchor, weight, content)

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    extra = D.pa.schema([("n", D.pa.int64())])
    want = {k: v[1] for k, v in repeated_words(rows).items()}
    assert 0 < sum(v > 0 for v in want.values()) < len(rows)
    for size in (6_000_000, 100_000):
        out = D.routed.repeats(docs, Watched(), lambda _, s: (sum(z - a for a, z in D.spans(s, D.WIDTH)),), extra, "n long", batch_bytes=size)
        assert {r.doc_id: r.n for r in out.collect()} == want


def test_split_anchors_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole, split = (sorted(D.duplicate_passages(docs, batch_bytes=50_000, split=n).collect(), key=str) for n in (10**9, 1))
    assert whole == split and any(r.spans for r in whole)
