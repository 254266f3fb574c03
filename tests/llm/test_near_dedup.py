import random

import numpy as np
import pytest

from wavecohort.llm import near_dedup as N

from .plain import near_components


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_every_pair_compared(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = N.near_duplicates(docs)
    assert result(found) == near_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_chains_edges_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(100, " ".join(base))]
    for k in range(1, 9):  # neighbours are links, the ends are not
        base = base[:]
        base[(k * 13) % 120] = f"x{k}"
        base[(k * 29) % 120] = f"y{k}"
        rows.append((100 + k, " ".join(base)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "a b c d e"), (8, "A b c d e"), (9, "é b c d É"), (10, "É b c d É"), (11, rows[0][1].upper()), (12, "long " * 30000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rep int, band string")
    assert result(N.near_duplicates(docs, block=3)) == near_components(rows)
    docs = docs.union(docs.where("doc_id in (5, 2)")).union(spark.createDataFrame([(None, "one two", 1, "x")], docs.schema))
    found = N.near_duplicates(docs).collect()
    assert len(found) == len(rows) + 3
    assert {(r.doc_id, r.component_id, r.kept) for r in found if r.doc_id in (5, 2, None)} == {(5, 4, False), (2, 2, True), (None, None, True)}
    assert N.near_duplicates(docs.limit(0)).count() == 0
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in near_components(rows).values()}  # the row without id is a copy of 4


def test_members_not_linked_to_the_hub_are_compared(spark):
    """Documents that share a band with a document they are no link of still find each other."""
    rng = random.Random(3)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared, rows = words(140), []
    for g in range(6):
        own = words(60)
        rows += [(g, " ".join(shared + own)), (20 + g, " ".join(shared + own[:-6] + words(6))), (40 + g, " ".join(shared[8:] + own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(N.near_duplicates(docs, block=2)) == near_components(rows)


def test_links_at_the_threshold_share_a_band_and_are_not_pruned():
    """400 pairs of J = 0.75, the hardest links there are, over set sizes from 7 to 1400."""
    rng = np.random.default_rng(8)
    agree = []
    for size in (7, 14, 70, 1400):
        h = rng.integers(0, 2**62, (100, size), np.int64).astype(np.uint64) * np.uint64(3)
        keep = size * 6 // 7  # both sides hold 6 of 7 parts: 6 / 8 of the union is shared
        extra = rng.integers(0, 2**62, (100, size - keep), np.int64).astype(np.uint64) * np.uint64(3)
        a, b = N.registers(list(h)), N.registers([np.concatenate((x[:keep], e)) for x, e in zip(h, extra)])
        assert (a.view(np.int64) == b.view(np.int64)).any(1).all()
        n = np.full(100, size, float)
        found = N.estimate(a, b, n, n)
        assert (found >= N.PRUNE).all()
        agree += found.tolist()
    assert abs(np.mean(agree) - 0.75) < 0.01 and np.std(agree) < 0.035  # binomial: 0.028


def test_intersections_and_forests():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90))).astype(np.uint64) for _ in range(40)]
    for left, right in ((sets[:1], sets[1:]), (sets[:13], sets[13:]), (sets[:2], sets[2:3])):
        want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
        assert N.intersections(left, right, columns=16).tolist() == want
    assert N.intersections([np.array([1, 2], np.uint64)] * 2, [np.array([5], np.uint64)]).tolist() == [[0], [0]]
    for p in (0.02, 0.1, 0.5):
        linked = rng.random((30, 25)) < p
        edges = N.forest(linked)
        assert all(linked[x, y] for x, y in edges) and len(edges) <= 54

        def parts(pairs):
            top = list(range(55))
            find = lambda x: x if top[x] == x else find(top[x])
            for x, y in pairs:
                top[find(x)] = find(30 + y)
            return [find(x) for x in range(55)]

        same = lambda label: {(x, y) for x in range(55) for y in range(55) if label[x] == label[y]}
        assert same(parts(edges)) == same(parts(zip(*np.nonzero(linked))))


@pytest.mark.parametrize("sizes", [(300, 300, 260), (40, 50, 36), (2000, 1500, 1400)])
def test_estimate_is_close(sizes):
    na, nb, both = sizes
    h = np.random.default_rng(1).integers(0, 2**62, na + nb - both, np.int64).astype(np.uint64) * np.uint64(3)
    a, b = np.sort(h[:na]), np.sort(h[na - both :])
    ra, rb = N.registers([a, b])
    assert abs(N.estimate(ra[None], rb[None], np.array([na]), np.array([nb]))[0] - both / len(h)) < 0.13


def test_unrelated_sets_are_corrected_to_nothing():
    h = np.random.default_rng(2).integers(0, 2**62, (40, 500), np.int64).astype(np.uint64)
    r = N.registers(list(h))
    found = [N.estimate(r[i : i + 1], r[j : j + 1], np.array([500]), np.array([500]))[0] for i in range(40) for j in range(i)]
    assert abs(np.mean(found)) < 1e-3


def test_one_row_of_each_component_stays(spark):
    """Repeated ids with different texts, repeated rows, and copies without ids."""
    a, b, c = ("alpha one two three four five six seven", "beta uno due tre quattro cinque sei sette", "gamma eins zwei drei vier fünf sechs acht")
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, "only copies here without any id at all"), (None, "only copies here without any id at all"), (4, None), (4, None)]
    rows += [(5, long), (5, long + " x"), (6, b.replace("beta", "delta") + " one more"), (2, long + " y")]
    docs = spark.createDataFrame([(i, t, k, {"k": k}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, h int, `of` map<string,int>")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    rest = [(r, t) for r, t in found if t is None or not t.startswith("w0")]
    assert sorted(rest, key=str) == sorted([(1, a), (2, b), (3, c), (None, rows[6][1]), (4, None), (4, None), (6, rows[12][1])], key=str)
    assert [(r, t) for r, t in found if t and t.startswith("w0")] == [(2, long + " y")]
    told = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(docs).where("doc_id in (1, 2, 5)").collect())
    assert told == [(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (5, 2, False), (5, 2, False)]
