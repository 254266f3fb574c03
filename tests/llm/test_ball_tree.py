import random

import numpy as np

from wavecohort.llm import ball_tree as B


def brute(rows, k, every):
    sound = {}
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            sound[i] = [int(np.floor(256.0 * float(np.float32(v)))) for v in x]
    out = []
    for q, x in sound.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in sound.items() if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, x, "extra") for i, x in rows], "id long, x array<float>, shard string")
    return sorted(tuple(r) for r in B.top_k(df, **options).collect())


def test_ties_odd_vectors_and_many_shards(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(400)]  # many ties
    rows += [(1000 + i, [0.25] * 4) for i in range(40)] + [(-20, [1.0] * 4), (-1, [-3.0] * 4)]
    rows += [(2000, None), (2010, [None, 1.0, 1.0, 1.0]), (2020, [float("nan"), 1.0, 1.0, 1.0]), (2030, [float("inf"), 1.0, 1.0, 1.0]), (None, [9.0] * 4), (2040, [1.0, 2.0]), (2050, [0.5, 2.0]), (2060, [])]
    want = brute([r for r in rows if r[1] != []], 5, 10)
    assert result(spark, rows, every=10, shard_rows=60, block_rows=9) == want
    assert result(spark, rows + rows[:30], every=10, shard_rows=1000) == want  # repeated rows are one candidate
    assert result(spark, rows[:3], every=10) == brute(rows[:3], 5, 10)  # fewer candidates than k
    assert result(spark, [], every=10) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(3e5 * ((i * 7) % 13 - 6)), float(2e5 * (i % 5))]) for i in range(60)]
    assert result(spark, rows, every=10) == brute(rows, 5, 10)


def test_repeated_ids_keep_all_their_vectors(spark):
    rows = [(i % 30, [float(i * 7 % 11 - 5), float(i % 4 - 1)]) for i in range(120)]
    scores = {}
    for q, x in rows:
        for i, y in rows:
            if q % 10 == 0 and q != i:
                s = sum(int(256 * a) * int(256 * b) for a, b in zip(x, y))
                scores[q, i] = max(s, scores.get((q, i), s))
    want = []
    for q in (0, 10, 20):
        best = sorted((-s, i) for (a, i), s in scores.items() if a == q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert result(spark, rows, every=10, shard_rows=17, block_rows=3) == sorted(want)


def test_blocks_visit_few_shards_of_clustered_vectors():
    """After the first visits only shards whose root may reach a kth score are left."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 2000, (40, 16))
    x = [np.floor(c + rng.normal(0, 40, (300, 16))) for c in centres]
    trees = [B.build_tree(np.arange(300) + 300 * k, v) for k, v in enumerate(x)]
    roots = {"shard": np.arange(40), "centre": np.stack([t["centre"][0] for t in trees]), "radius": np.array([t["radius"][0] for t in trees]), "most": np.array([np.abs(t["x"]).max() for t in trees])}
    left = 0
    for k in range(40):
        q = x[k][:20]
        state = {"id": np.arange(20) - 20, "x": q, "best": np.full((20, 5), B.NONE), "ids": np.zeros((20, 5), np.int64), "seen": np.empty(0, np.int64)}
        state["seen"] = B.reachable(state, roots, 4)
        found = [B.search(trees[s], state["id"], q, state["best"][:, -1], 5)[1] for s in state["seen"]]
        state["best"] = -np.sort(-np.concatenate(found, 1), axis=1)[:, :5]
        rest = B.reachable(state, roots, None)
        left += len(rest)
        every = np.concatenate([(q @ v.T) for v in x], 1)
        seen = np.concatenate([np.arange(300) + 300 * s for s in [*state["seen"], *rest]])
        assert (-np.sort(-every[:, seen.astype(int)], axis=1)[:, :5] == -np.sort(-every, axis=1)[:, :5]).all()
    assert left < 0.1 * 40 * 40


def test_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(spark, rows, shard_rows=130, block_rows=4) == brute(rows, 5, 50)


def test_packs_of_packs_and_parts_of_shards(spark, monkeypatch):
    """Several levels of packs, and a copy of packs and trees for every few blocks, give the same rows."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(0, 1, 6) + 4 * (i % 5)).tolist()) for i in range(500)]
    monkeypatch.setattr(B, "PACK", 3)
    monkeypatch.setattr(B, "TOGETHER", 2)
    want = brute(rows, 5, 10)
    assert result(spark, rows, every=10, shard_rows=25, block_rows=6) == want
    monkeypatch.setattr(B, "ROUNDS", ())
    assert result(spark, rows, every=10, shard_rows=25, block_rows=6) == want


def test_search_prunes():
    """A node whose bound is below the kth score is not opened."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 6, (900, 8)) + c for c in (0, 400)]).astype(float)
    tree = B.build_tree(np.arange(len(x)), x, leaf=16)
    opened = []
    kept, B._scores = B._scores, lambda q, y: opened.append(len(y)) or kept(q, y)
    try:
        ids, best = B.search(tree, np.array([-1]), np.full((1, 8), 300.0), np.array([B.NONE]), 5)
    finally:
        B._scores = kept
    assert sum(opened) < 950 and best[0].tolist() == sorted((x @ np.full(8, 300.0)).astype(int).tolist())[-5:][::-1]


def test_an_id_with_several_vectors_is_a_candidate_by_its_best(spark):
    rng = random.Random(12)
    rows = [(i % 60, [float(rng.randrange(-9, 10)) for _ in range(4)]) for i in range(900)]
    scores = {}
    for q, x in rows:
        for v, y in rows:
            if q % 10 == 0 and q != v:
                scores[q, v] = max(scores.get((q, v), B.NONE), sum(int(256 * a) * int(256 * b) for a, b in zip(x, y)))
    want = []
    for q in range(0, 60, 10):
        best = sorted((-s, v) for (a, v), s in scores.items() if a == q)[:5]
        want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    vectors = spark.createDataFrame(rows, "id long, x array<double>")
    for size in (8192, 100):
        assert sorted(tuple(r) for r in B.top_k(vectors, 5, 10, shard_rows=size, block_rows=7).collect()) == want
