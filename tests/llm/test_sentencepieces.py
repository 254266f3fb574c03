from collections import Counter

import numpy as np
import pytest

from wavecohort.llm import sentencepieces as S
from wavecohort.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
ODD = ["the  cat ▁x", "zé 漢字🙂\n a ", "", " ", "a", "   ", "x" * 3000, "the cat " * 4000, "\0\x7f"]


@pytest.fixture(scope="module")
def held():
    return S.Lattices(S.Vocabulary(PATH))


def test_round_trip_and_distinct(held):
    for text, found in zip(ODD, S.sample(held, list(range(len(ODD))), [t.encode() for t in ODD], 4)):
        assert 1 <= len(found) <= 4
        assert len({tuple(x[0]) for x in found}) == len(found)
        assert all(held.vocabulary.decode(x[0]).decode() == text for x in found)
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)


def exact(held, chunk):
    """All segmentations of one chunk with their probabilities."""
    v, out = held.vocabulary, {}
    pieces = {b: i for i, b in enumerate(v.bytes_of) if b and i not in set(v.byte_id.tolist())}

    def go(rest, ids, w):
        if not rest:
            out[ids] = w
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces:
                i = pieces[rest[:k]]
                go(rest[k:], (*ids, i), w + v.weight[i])

    go(chunk, (), 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: w - z for k, w in out.items()}


def test_log_probabilities_are_exact(held):
    want = exact(held, b" theson")
    found = S.sample(held, [3], [b"theson"], 200)[0]
    assert {tuple(x[0]): round(x[1], 9) for x in found} == {k: round(w, 9) for k, w in want.items()}
    assert all(x[3] == 0 for x in found)  # all were found, so all are surely in


@pytest.mark.parametrize("text", [b"    x", b"a   b", b"\xe6\xbc\xa2\xe5\xad\x97 !", b"  "])
def test_runs_of_spaces_and_odd_characters_have_all_their_segmentations(held, text):
    v = held.vocabulary
    pieces = {b for i, b in enumerate(v.bytes_of) if b and i not in set(v.byte_id.tolist())}
    whole = b" " + text
    ends = {len(whole[: k + 1].decode("utf-8", "ignore").encode()) for k in range(len(whole))} | {0}

    def count(at):
        if at == len(whole):
            return 1
        stop = min(e for e in ends if e > at)
        n = sum(count(e) for e in ends if e > at and whole[at:e] in pieces)
        return n if whole[at:stop] in pieces else n + count(stop)  # a character that is no piece is written in bytes

    found = S.sample(held, [5], [text], 5000)[0]
    assert len({tuple(x[0]) for x in found}) == len(found) == count(0)
    assert sum(np.exp(x[1]) for x in found) == pytest.approx(1)
    assert all(v.decode(x[0].tolist()) == text for x in found)


def test_long_chunks_are_cut_exactly(held, monkeypatch):
    text = ("\u6f22\u5b57\U0001f642abc\u00e9\u00df" * 40).encode()
    want = [(x[0].tolist(), round(x[1], 6)) for x in S.sample(held, [7], [text], 3)[0]]
    monkeypatch.setattr(S, "LONG", 10**9)
    whole = S.Lattices(held.vocabulary)
    assert [(x[0].tolist(), round(x[1], 6)) for x in S.sample(whole, [7], [text], 3)[0]] == want


def test_samples_without_replacement_have_the_right_frequencies(held):
    """The first is a draw from the distribution, and the second a draw from what is left of it."""
    want = exact(held, b" thes")
    n, first, pairs = 4000, Counter(), Counter()
    for found in S.sample(held, list(range(n)), [b"thes"] * n, 2):
        a, b = (tuple(x[0]) for x in found)
        first[a] += 1
        pairs[a, b] += 1
    for a, w in want.items():
        p = np.exp(w)
        assert abs(first[a] / n - p) < 5 * (p / n) ** 0.5 + 1e-3
        for b, x in want.items():
            if a != b:
                q = p * np.exp(x) / (1 - p)
                assert abs(pairs[a, b] / n - q) < 5 * (q / n) ** 0.5 + 1e-3


def test_inclusion_scores_weigh_to_one(held):
    """Each winner's probability over its inclusion probability sums to 1 on average."""
    n = 3000
    total = [sum(np.exp(x[1] - x[3]) for x in found) for found in S.sample(held, list(range(n)), [b"ons thes"] * n, 3)]
    assert abs(np.mean(total) - 1) < 5 * np.std(total) / n**0.5 + 1e-3


def test_query_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(50, None, "x"), (None, "the", "x"), (4, "a", "x")], "doc_id long, text string, ids string")
    out = S.encoded(docs, PATH, k=3, part_bytes=100)
    rows = out.withColumn("back", S.decoder(PATH)("ids")).collect()
    text = dict(enumerate(ODD)) | {50: "", None: "the"}
    assert all(r.back == text[r.doc_id] for r in rows)
    every = lambda df: sorted((str(r.doc_id), r.sample, tuple(r.ids), r.log_prob, r.perturbed, r.log_inclusion) for r in df.collect())
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, given):  # all columns are equal to the last bit
        assert every(S.encoded(df.repartition(3), PATH, k=3)) == every(S.encoded(df, PATH, k=3, part_bytes=100))
    assert all(r.text == text[r.doc_id] for r in S.encoded(docs, PATH, k=2, decoded=True).collect())
    assert S.encoded(docs.limit(0), PATH).count() == 0


def test_texts_of_many_ids_are_what_each_decodes_to(held):
    found = [x[0] for mine in S.sample(held, list(range(len(ODD))), [t.encode() for t in ODD], 3) for x in mine]
    bounds = np.append(0, np.cumsum([len(x) for x in found]))
    got = held.vocabulary.decoded(np.concatenate(found).astype(np.int32), bounds).to_pylist()
    assert got == [held.vocabulary.decode(x.tolist()).decode() for x in found]
    assert held.vocabulary.decoded(np.empty(0, np.int32), np.zeros(3, np.int64)).to_pylist() == ["", ""]
