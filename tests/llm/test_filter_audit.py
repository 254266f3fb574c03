import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa

from wavecohort.llm import filter_audit as A
from wavecohort.llm import spans as S

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", " ", "a", "a a", "é É 漢字漢字 🙂🙂 x", "\x0b\x0cA\x00b ", "Ab#$ %&* |x" * 90, "naïve " * 200, "🙂" * 700, "é" * 255 + " " + "漢" * 171 + "b", "q" * 100_000, " x" * 300, "word1 word2 longer-than-eight longer-than-eighT longer-than-eight"]


def plain(text):
    words = WORD.findall(text or "")
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text or ""), len(text or ""), sum(c in "#$%&*|" for c in text or "")


def test_transducer_counts_as_plain_ones():
    texts = [*ODD, *ODD[::-1], "x", "x"]
    found = A.text_counts(*S.buffers(pa.array([None, *texts, None])))
    assert found.tolist() == [list(plain(t)) for t in (None, *texts, None)]
    assert A.text_counts(np.empty(0, np.uint8), np.zeros(3, np.int64)).tolist() == [[0] * 5] * 2
    # bytes that are no UTF-8: each a code point of its own
    assert A.text_counts(*S.buffers(pa.array([b"\xff\x80 \xc3", b"\xe6\xbc", b"\x80"], pa.binary()))).tolist() == [[2, 2, 0, 4, 0], [1, 1, 0, 1, 0], [1, 1, 0, 1, 0]]


def test_words_of_one_hash_are_told_apart():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 99, rng.integers(1, 20), np.uint8)) for _ in range(3000)]
    buffer = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts, owners = np.cumsum(lengths) - lengths, rng.integers(0, 3, len(words))
    seen: dict = {}
    want = [seen.setdefault((o, w), k) for k, (o, w) in enumerate(zip(owners.tolist(), words))]
    for h in (None, np.zeros(len(words), np.uint64), rng.integers(0, 2, 1).astype(np.uint64) + lengths.astype(np.uint64)):
        assert S.distinct(S.eights(buffer), starts, lengths, owners, h).tolist() == want


def audited(rows, labels):
    """The report in plain loops; rows: (doc_id, text, source)."""
    least: dict = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = defaultdict(list)
    for i, text, source in rows:
        n, d, caps, points, signs = plain(text)
        fails = {"A": n < 50, "B": 100 * d < 65 * n, "C": 100 * caps > 5 * points, "D": signs > 0, "E": i is not None and least[text or ""] < i}
        docs[source or ""].append((fails, (i, "quality") in labels, (i, "toxic") in labels))
    out, shapley = {}, Counter()
    for part, held in docs.items():
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in held)
                out[part, "".join(order), step] = [len(stay), len(gone), failing - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone), f]
                shapley[part, f] += len(gone)
                left = stay
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def test_audit_equals_plain_loops(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    odd = [(10_000 + k, t, ["s0", None][k % 2]) for k, t in enumerate(ODD + ODD[:4])] + [(None, rows[0][1], "s0"), (None, "", None), (10_001, None, ""), (3, rows[3][1], rows[3][2]), (3, rows[3][1], "other"), (3, "x", "other"), (-1, rows[5][1], None)]
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()] + [(10_000, 1, None), (10_000, 0, 1), (None, 1, 1)]
    told = {(i, c) for i, q, t in marks for c, v in (("quality", q), ("toxic", t)) if v == 1 and i is not None}
    given = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows + odd], "doc_id long, text string, source string, words int, part string")
    found = A.audited(given.repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    want = audited(rows + odd, told)
    assert len(found) == len(want) and {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in found} == want
    assert A.audited(given.limit(0), labels).count() == 0
    assert {r.good_lost + r.toxic_lost for r in A.audited(given, labels.limit(0)).collect()} == {0}
