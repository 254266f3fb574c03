import numpy as np

from wavecohort.llm import language_id as L


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    x = rng.integers(97, 103, (6, 3))
    mask = np.ones((6, 3), np.float32)
    mask[4:, 1] = 0
    d = L.Direction(*(rng.normal(0, 0.4, s) for s in ((9, 256), (9, 3), (9,))))
    given = rng.normal(0, 1, (6, 3, 3)).astype(np.float32)

    def loss():
        return float((L._run(d, x, mask).astype(np.float64) * given).sum())

    trace = []
    L._run(d, x, mask, trace)
    got = L._back(d, x, mask, trace, given)
    checked = 0
    for name in ("w", "u", "b"):
        p, g = getattr(d, name), getattr(got, name)
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(12)] + ([(2, 99), (5, 100), (8, 98)] if name == "w" else []):
            kept = p[at]
            p[at] = kept + 1e-2
            up = loss()
            p[at] = kept - 1e-2
            down = loss()
            p[at] = kept
            assert abs((up - down) / 2e-2 - g[at]) < 0.03 + 0.03 * abs(g[at])
            checked += abs(g[at]) > 1e-3
    assert checked > 10


def plain_probabilities(m, text):
    """Label probabilities of a text, byte by byte and number by number, in stretches of T bytes."""

    def states(d, data):
        hn = d.u.shape[1]
        h, out = [0.0] * hn, []
        gate = lambda v: min(1.0, max(0.0, v / 4 + 0.5))
        for c in data:
            inner = [sum(float(d.u[r, k]) * h[k] for k in range(hn)) + float(d.b[r]) for r in range(3 * hn)]
            z = [gate(float(d.w[r, c]) + inner[r]) for r in range(hn)]
            r_ = [gate(float(d.w[hn + r, c]) + inner[hn + r]) for r in range(hn)]
            n = [float(d.w[2 * hn + r, c]) + r_[r] * inner[2 * hn + r] for r in range(hn)]
            n = [v / (1 + abs(v)) for v in n]
            h = [z[r] * h[r] + (1 - z[r]) * n[r] for r in range(hn)]
            out.append(h)
        return out

    total = np.zeros(len(m.labels))
    for at in range(0, len(text), L.T):
        part = text[at : at + L.T]
        for f, b in zip(states(m.forward, part), states(m.backward, part[::-1])[::-1]):
            logit = [sum(float(w) * s for w, s in zip(row, f + b)) + float(c) for row, c in zip(m.out, m.bias)]
            e = np.exp(np.array(logit) - max(logit))
            total += e / e.sum()
    return total / max(1, len(text))


def test_prediction_equals_a_plain_loop():
    rng = np.random.default_rng(6)
    direction = lambda: L.Direction(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.5, (12, 256)), (0.5, (12, 4)), (0.3, (12,)))))
    m = L.Model(["a", "b", "c"], direction(), direction(), rng.normal(0, 1, (3, 8)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    texts = ["one", "", "über " * 70, "漢字 and more", "x" * L.T, "y" * (L.T + 1)]
    texts = [t.encode() for t in texts]
    found = L.predict(m, texts, block=2)
    for t, p in zip(texts, found):
        assert np.allclose(p, plain_probabilities(m, t), atol=2e-5)


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ③ ٣ 一"), (2, "½ ² ③ _ 12"), (3, "ª")], "doc_id long, text string")
    m = L.train([b"abc def", b"xyz uvw"], ["a", "b"], steps=3)
    assert [r.lang_pred == "und" for r in L.identified(docs, m).orderBy("doc_id").collect()] == [False, True, False]


def test_every_language_is_learned(spark):
    words = {f"l{k:02}": chr(97 + k % 26) + chr(97 + k // 26) + " " for k in range(70)}
    docs = spark.createDataFrame([(10 * k + i, w * 30, lang) for k, (lang, w) in enumerate(words.items()) for i in range(3)], "doc_id long, text string, lang string")
    model = L.train_on(docs, steps=2)
    learnable = {r.lang for r in docs.where(~L.held_out(docs.doc_id)).collect()}
    assert set(model.labels) == learnable and len(learnable) > 64


def test_lanes_hold_every_byte():
    texts = [b"", b"a", b"x" * L.T, b"y" * (2 * L.T + 5)]
    x, length, owner = L.lanes(texts)
    assert [b"".join(bytes(r[:n]) for r, n, o in zip(x, length, owner) if o == k) for k in range(4)] == texts


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train_on(docs, steps=150)
    out = L.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.lang and r.lang_pred != L.UNKNOWN]
    assert sum(r.lang_pred == r.lang for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " 12 \n!", "x"), (4, "The and the of " * 9000, None), (None, "é", "x"), (4, "漢字", "x")], "doc_id long, text string, lang_pred string")
    found = [(r.doc_id, r.lang_pred) for r in L.identified(odd, model).collect()]
    assert found[:4] == [(1, "und"), (2, "und"), (3, "und"), (4, "en")] and len(found) == 6
    kept = L.keep_identified(docs.union(docs.limit(0)), model)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()
    assert L.identified(odd.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.train_on(docs) is None
    assert L.identified(docs, None).first().lang_pred == "und"
