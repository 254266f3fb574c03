import random
import re
from collections import Counter, defaultdict

import numpy as np

from wavecohort.llm import phrases as P
from wavecohort.llm import quotient_filter as Q


def test_filters_give_back_what_went_in():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4):
        ids = rng.integers(0, 2**63, 300, np.int64).astype(np.uint64)
        grams = np.concatenate((ids[rng.integers(0, 300, (n, 20_000))], np.zeros((n, 3), np.uint64), np.full((n, 1), 2**64 - 1, np.uint64)), 1)
        assert (Q.restored(Q.permuted(grams)) == grams).all()
        want = Counter(zip(*grams.tolist()))
        parts = np.array_split(np.arange(grams.shape[1]), 7)
        filters = []
        for at in parts:
            keys, counts = Q.gathered(Q.permuted(grams[:, at]), np.ones(len(at), np.int64))
            assert (np.lexsort(keys[::-1]) == np.arange(keys.shape[1])).all()
            for bits in (0, 1, 5):
                for p in np.unique(keys[0] >> np.uint64(64 - bits)) if bits else [None]:
                    some = keys[0] >> np.uint64(64 - bits) == p if bits else np.ones(keys.shape[1], bool)
                    back = Q.unpacked(Q.packed(keys[:, some], counts[some] * 1000, bits))
                    assert (back[0] == keys[:, some]).all() and (back[1] == counts[some] * 1000).all()
            filters.append(Q.packed(keys, counts))
        keys, counts = Q.merged(filters)
        assert dict(zip(zip(*Q.restored(keys).tolist()), counts.tolist())) == want
    # keys that agree in the first word only, and large counters
    keys = np.array([[7, 7, 7, 9], [3, 1, 3, 0]], np.uint64)
    k, c = Q.gathered(keys, np.array([1, 2**50, 5, 127]))
    assert k.tolist() == [[7, 7, 9], [1, 3, 0]] and c.tolist() == [2**50, 6, 127]
    assert (Q.unpacked(Q.packed(k, c))[1] == c).all()
    empty = np.empty((2, 0), np.uint64)
    assert Q.unpacked(Q.packed(empty, np.empty(0, np.int64)))[0].shape == (2, 0)


def plain(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for k in range(len(w) - m + 1):
                    f[lang][tuple(w[k : k + m])] += 1
    out = {}
    for lang, g in f.items():
        often = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inside[p[k : k + m]] = max(inside[p[k : k + m]], a)
        held = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                held.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(held)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, n[lang], -score)
    return out


def result(df):
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_phrases_equal_plain_counts(spark, monkeypatch):
    rng = random.Random(6)
    words = ["a", "B", "b", "é", "É", "漢字", "longer-than-eight-bytes", "longer-than-eight-bytez", "x.y", "z\x00"] + [f"w{k}" for k in range(12)]
    rows = []
    for k in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", " new york city of "]) for _ in range(rng.randrange(1, 60)))
        rows.append((text, rng.choice(["en", "de", "und", None, ""])))
    rows += [(None, "en"), ("", None), (" \t", "en"), ("one two three four " * 20_000, "fr"), ("q" * 50_000 + " r", "fr")] + [("same text here , again", "es")] * 40
    docs = spark.createDataFrame([(t, g, k % 3, 1) for k, (t, g) in enumerate(rows)], "text string, lang string, id int, n int")
    want = plain(rows, 30, 40)
    assert result(P.top_phrases(docs.repartition(5), top=40)) == want
    # small filters, many ranges, maps full of false bits
    monkeypatch.setattr(P, "HELD", 64)
    monkeypatch.setattr(P, "RANGE", 4000)
    monkeypatch.setattr(P, "_on", lambda bits, mark: np.ones(len(mark), bool))
    assert result(P.top_phrases(docs.repartition(3), top=40)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), ("a b c", "en")], "text string, lang string")
    assert P.top_phrases(docs).count() == 0 and P.top_phrases(docs.limit(0)).count() == 0 and P.top_phrases(docs.limit(2)).count() == 0
    assert result(P.top_phrases(docs, least=1, top=2)) == {("en", 1): ("a b c", 1, 1, 1, 3, 1_000_000)}
