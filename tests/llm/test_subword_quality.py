import zlib

import numpy as np
import pyarrow as pa
import pytest

from wavecohort.llm import spans as S
from wavecohort.llm import subword_quality as Q

TEXTS = ["the cat sat", None, "", " \n", "a", "é 漢字 🙂 naïve naïve naïve", "q" * 50_000, "x y " * 9000, "the cat sat"]


def plain_bag(text):
    """Buckets of a text in a list, by loops over its words and their characters."""
    def bucket(data, seed):
        data = np.frombuffer(data, np.uint8)
        return int(Q._buckets(S.hashes(S.eights(data), np.array([0]), np.array([len(data)]), seed))[0])

    out, found = [], (text or "").encode().split()
    for w in found:
        out.append(bucket(w, 1))
        marked = "\x02" + w.decode() + "\x03"
        out += [bucket(marked[k : k + n].encode(), 2) for n in Q.GRAMS for k in range(len(marked) - n + 1)]
    for a, b in zip(found, found[1:]):
        h = [S.hashes(S.eights(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)])) for w in (a, b)]
        out.append(Q.REPEAT if a == b else int(Q._buckets(Q.mixed(h[0] * Q._PAIR + h[1]))[0]))
    return out


def test_folded_scores_equal_means_of_vectors():
    rng = np.random.default_rng(0)
    m = Q.Model(rng.normal(size=(Q.BUCKETS, 8)).astype(np.float32), rng.normal(size=(2, 8)).astype(np.float32), np.array([0.3, -0.1], np.float32))
    texts = [t for t in TEXTS if len(t or "") < 1000] + ["x y " * 90]
    found = Q.logits(*m.folded(), *S.buffers(pa.array(texts)))
    for t, z in zip(texts, found):
        held = plain_bag(t)
        mean = m.vectors[held].astype(float).mean(0) if held else np.zeros(8)
        assert np.allclose(z, m.out.astype(float) @ mean + m.bias, atol=1e-5), t
        ids, share = Q.bag(np.frombuffer((t or "").encode(), np.uint8), 1 << 20)
        assert ids.tolist() == sorted(set(held)) and np.allclose(share, [held.count(i) / len(held) for i in ids])
    ids, share = Q.bag(np.frombuffer(b"one two three four", np.uint8), 5)
    assert len(ids) == 5 and abs(share.sum() - 1) < 1e-9


def test_descent_is_the_gradient():
    """One step from a model moves each vector against the numerical gradient of the loss."""
    bags = [(np.array([1, 5, 9]), np.array([0.5, 0.25, 0.25])), (np.array([5, 7]), np.array([0.5, 0.5]))]
    y = np.array([1, 0])

    def loss(m):
        z = np.array([m.out.astype(float) @ (m.vectors[i].astype(float) * w[:, None]).sum(0) + m.bias for i, w in bags])
        return -np.log(Q.probabilities(z)[[0, 1], y]).sum()

    rng = np.random.default_rng(1)
    first = Q.train(bags, y, steps=1, rate=0.0)
    first.out[:] = rng.normal(size=first.out.shape)
    z = np.array([first.out @ (first.vectors[i] * w[:, None]).sum(0) + first.bias for i, w in bags])
    error = Q.probabilities(z) - np.eye(2)[y]
    for bucket in (1, 5, 7):
        back = sum(float(w[i == bucket].sum()) * (e @ first.out) for (i, w), e in zip(bags, error))
        for k in range(3):
            up, down = (Q.Model(first.vectors.astype(float), first.out, first.bias) for _ in range(2))
            up.vectors[bucket, k] += 1e-4
            down.vectors[bucket, k] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - back[k]) < 1e-4
    fitted = Q.train(bags * 8, np.tile(y, 8), steps=100)
    assert loss(fitted) < 0.5 * loss(Q.train(bags, y, steps=1, rate=0.0))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.train_on(docs, labels)
    again = Q.train_on(docs.repartition(5).unionByName(docs.limit(20)), labels.repartition(3))  # repeated rows are one
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.out, again.out)
    changed = Q.train_on(docs, labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 4) = 2, 1 - quality, quality) as quality"))
    assert np.array_equal(model.vectors, changed.vectors)  # held-out labels are never read
    out = Q.assessed(docs, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    rows = out.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    good, bad = [r for r in rows if r.held_out and r.quality == 1], [r for r in rows if r.held_out and r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.95 * len(good) and sum(1 - r.predicted for r in bad) >= 0.75 * len(bad)


@pytest.mark.parametrize("fitted", [True, False])
def test_odd_rows(spark, fitted):
    rng = np.random.default_rng(2)
    model = Q.Model(rng.normal(size=(Q.BUCKETS, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), np.array([0.0, 1.0], np.float32)) if fitted else None
    docs = spark.createDataFrame([(k, t, 1.0, "x") for k, t in enumerate(TEXTS)] + [(None, "the cat sat", 1.0, "x")], "doc_id long, text string, score double, y string")
    found = {r.doc_id: r for r in Q.assessed(docs, model).collect()}
    empty = 1 / (1 + np.exp(-1)) if fitted else 0.5
    assert all(abs(found[k].score - empty) < 1e-6 for k in (1, 2, 3)) and found[0].score == found[8].score == found[None].score
    assert not found[None].held_out and len(found) == len(TEXTS) + 1
    assert Q.assessed(docs.limit(0), model).count() == 0
    nothing = spark.createDataFrame([(None, 1), (5, None), (77, 1), (2, 1)], "doc_id long, quality int")
    assert Q.train_on(docs.limit(0), nothing) is None and Q.train_on(docs, nothing.limit(0)) is None
