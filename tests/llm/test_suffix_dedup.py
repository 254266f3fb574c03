import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from wavecohort.llm import suffix_dedup as S

from .plain import repeated_bytes


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_equals_all_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = repeated_bytes(rows)
    assert sum(v[1] for v in want.values()) > 0
    assert result(S.digest(docs)) == want


def test_odd_rows_over_many_batches(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdé ") for _ in range(140))
    rows = [(k, "".join(rng.choice("abcd") for _ in range(rng.randrange(120))) + (passage[k % 40 : 60 + k % 80] if k % 3 else passage) + "z" * (k % 90)) for k in range(60)]
    rows += [(90, None), (91, ""), (92, "a" * 49), (93, "a" * 50), (94, "a" * 50), (95, "a" * 3000), (-7, passage), (96, "\0" * 70), (97, "\0" * 70 + "x"), (98, "é" * 40), (99, "é" * 40)]
    docs = spark.createDataFrame([(i, t, "b", i) for i, t in rows], "doc_id long, text string, batch string, bucket long")
    out = S.duplicate_spans(docs, batch_bytes=700)
    assert out.columns == docs.columns + ["n_bytes", "spans", "kept"]
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()} == repeated_bytes(rows)
    assert S.digest(docs.limit(0)).count() == 0
    clash = S.duplicate_spans(docs.withColumn("Spans", F.lit(1)).withColumn("kept", F.lit("x")), batch_bytes=700)
    assert clash.columns == docs.columns + ["n_bytes", "spans", "kept"] and clash.count() == len(rows)
    cut = S.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert {r.doc_id: r.text for r in cut.collect()}[90] is None
    # rows that share an id repeat nothing of each other; a row without id is larger than all
    more = spark.createDataFrame([(1, passage), (1, passage), (None, passage)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in S.digest(more).collect()) == [(0, len(passage.encode())), (1, 0), (1, 0)]


def test_suffix_array_of_small_alphabets():
    rng = random.Random(1)
    for trial in range(200):
        texts = [bytes(rng.choice(b"ab" if trial % 3 else b"\0a\xffb") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))]
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        order = S.suffix_array(data, ends, 200)
        own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        suffixes = [data.tobytes()[i : ends[own[i]]] for i in order]
        assert sorted(order.tolist()) == list(range(len(data))) and suffixes == sorted(suffixes)
        # of a part of the suffixes, the same order
        wanted = np.array([rng.randrange(0, len(t) + 1) for t in texts])
        some = S.suffix_array(data, ends, 200, wanted)
        begin = ends - [len(t) for t in texts]
        asked = [i for i in some.tolist() if i - begin[own[i]] < wanted[own[i]]]
        assert len(asked) == wanted.sum() and [data.tobytes()[i : ends[own[i]]] for i in asked] == sorted(data.tobytes()[i : ends[own[i]]] for i in asked)


def test_common_prefixes():
    data = np.frombuffer(b"abcdefgh12345678abcdefgh12345699abcdefgX12345678", np.uint8)
    assert S.common_prefixes(data, np.array([0, 16, 32]), 16).tolist() == [14, 7]
    assert S.common_prefixes(data, np.array([0, 16]), 10).tolist() == [10]


def test_segments_of_a_common_line_are_split(spark):
    rng = random.Random(6)
    line = "this common line has 49 bytes, one below a window"
    near = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = [(k, f"{k:09d}{near()}{line}{near()}{k:09d}") for k in range(4000)]

    class Watched(S.Bytes):
        def resolve(self, anchor, weight, content):
            assert np.unique(anchor, return_counts=True)[1].max(initial=0) <= 1000, "an anchor's segments are in one block"
            return super().resolve(anchor, weight, content)

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    extra = S.pa.schema([("n", S.pa.int64())])
    want = {k: v[1] for k, v in repeated_bytes(rows).items()}
    assert 0 < sum(v > 0 for v in want.values()) < len(rows)
    for size in (6_000_000, 50_000):
        out = S.routed.repeats(docs, Watched(), lambda _, s: (sum(z - a for a, z in S.spans(s, S.WIDTH)),), extra, "n long", batch_bytes=size)
        assert {r.doc_id: r.n for r in out.collect()} == want


def test_split_anchors_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole, split = (sorted(S.duplicate_spans(docs, batch_bytes=50_000, split=n).collect(), key=str) for n in (10**9, 1))
    assert whole == split and any(r.spans for r in whole)
