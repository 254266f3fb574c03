"""Exact top-k inner-product search by ball trees.

Vectors are dealt to shards by their nearest pivot, of a bounded sample, and by hash where a pivot has many; each shard
builds a ball tree. Queries travel in blocks, and go in rounds: of the shards whose root may still reach a query's kth
score a block visits the most promising one, then a few, then all that are left, and takes the kth scores found so far
along. In a shard, branch and bound visits nodes in the order of their inner-product upper bound, q.centre + |q| * radius,
and skips those below. A tree stays where its shard is and is read once a round; blocks, which are smaller, move. Trees
and blocks are rows of bounded size, so that neither all vectors nor all queries meet in one task.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, id_hash, written

_EXACT = 2.0**53
NONE = np.iinfo(np.int64).min


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def build_tree(ids: np.ndarray, x: np.ndarray, leaf: int = 64) -> dict[str, np.ndarray]:
    """A ball tree over integer vectors: rows reordered so that each node is a range; children of node i in ``child``."""
    order = np.arange(len(ids))
    start, end, child, centre, radius = [], [], [], [], []

    def node(a: int, b: int) -> int:
        at = len(start)
        rows = x[order[a:b]]
        c = rows.mean(0)
        start.append(a), end.append(b), child.append(-1), centre.append(c)
        radius.append(float(np.sqrt(((rows - c) ** 2).sum(1).max())))
        return at

    stack = [node(0, len(ids))]
    while stack:
        at = stack.pop()
        a, b = start[at], end[at]
        if b - a <= leaf or radius[at] == 0:
            continue
        rows = x[order[a:b]]
        far = rows[((rows - centre[at]) ** 2).sum(1).argmax()]
        other = rows[((rows - far) ** 2).sum(1).argmax()]
        side = rows @ (other - far)
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(side, half)]
        child[at] = node(a, a + half)
        node(a + half, b)
        stack += [child[at], child[at] + 1]
    return {"ids": ids[order], "x": x[order], "start": np.array(start), "end": np.array(end), "child": np.array(child), "centre": np.array(centre), "radius": np.array(radius)}


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by float arithmetic where every partial sum is exact, else by Python's integers."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if bound < _EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)  # beyond a long: the nearest long


def search(tree: dict[str, np.ndarray], qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (k columns; score NONE where there is none) of each query's best vectors but its own.

    floor: for each query a score that its kth best is known to reach. Equal bounds are visited, since a tie may have
    a smaller id. A node is visited for all queries of the block whose kth score it may still reach, and nodes come in
    the order of the largest such bound.
    """
    n = len(qid)
    best = np.full((n, k), NONE)
    ids = np.zeros((n, k), np.int64)
    kth = floor.astype(float).copy()
    size = np.sqrt((q.astype(float) ** 2).sum(1))
    slack = 1e-9 * (1 + size) * max(1.0, float(np.abs(tree["x"]).max(initial=0))) * q.shape[1] + 1e-6

    def bound(at: int, rows: np.ndarray) -> np.ndarray:
        return q[rows] @ tree["centre"][at] + size[rows] * tree["radius"][at] + slack[rows]

    repeated = len(np.unique(tree["ids"])) < len(tree["ids"])
    everyone = np.arange(n)
    top = bound(0, everyone)
    heap = [(-float(top.max(initial=0)), 0, everyone, top)]
    while heap:
        _, at, rows, told = heapq.heappop(heap)
        rows = rows[told >= kth[rows]]
        if not len(rows):
            continue
        child = int(tree["child"][at])
        if child >= 0:
            for c in (child, child + 1):
                b = bound(c, rows)
                may = b >= kth[rows]
                if may.any():
                    heapq.heappush(heap, (-float(b[may].max()), c, rows[may], b[may]))
            continue
        a, z = int(tree["start"][at]), int(tree["end"][at])
        scores = _scores(q[rows], tree["x"][a:z])
        own = np.broadcast_to(tree["ids"][a:z], scores.shape)
        out = own == qid[rows, None]
        all_s = np.concatenate((best[rows], np.where(out, NONE, scores)), 1)
        all_i = np.concatenate((ids[rows], own), 1)
        if repeated:  # an id keeps its best score only
            o = np.lexsort((~all_s, all_i), axis=1)
            i = np.take_along_axis(all_i, o, 1)
            again = np.zeros(i.shape, bool)
            again[:, 1:] = i[:, 1:] == i[:, :-1]
            np.put_along_axis(all_s, o, np.where(again, NONE, np.take_along_axis(all_s, o, 1)), 1)
        order = np.lexsort((all_i, ~all_s), axis=1)[:, :k]  # ~s falls as s grows
        best[rows] = np.take_along_axis(all_s, order, 1)
        ids[rows] = np.take_along_axis(all_i, order, 1)
        kth[rows] = np.maximum(kth[rows], best[rows, -1])
    return ids, best


def usable(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """id and x = floor(scale * component) of the vectors whose components are all there and finite."""
    sound = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor() would give longs: a component is kept as the double that holds the same integer
    return vectors.where(sound).select("id", F.transform("x", lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("x"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = 8192, block_rows: int = 1024, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best vectors for each vector whose id is divisible by ``every``.

    vectors: id long, x array of numbers; vectors that are null or hold null or non-finite components take no part,
    nor do those of another dimension than the query's. A query's own id is no candidate; a repeated id is one
    candidate, with the best score that any of its vectors has with any of the query's. Ties go to the smaller id. Scores
    beyond a long are the nearest long. An empty table gives no rows.
    """
    held = checkpointed(usable(vectors, scale))
    facts = held.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("nq")).collect()  # a row for each dimension
    parts = [_one_dimension(held.where(F.size("x") == r["dim"]), k, every, shard_rows, block_rows) for r in facts if r["nq"] and r["dim"]]
    if not parts:
        return held.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


#: Vectors that stand for regions; a bounded sample, held by the driver and every task.
PIVOTS = 256
#: Balls that a block is held against at once: roots of shards, packs of these, and so on up to a single pack.
PACK = 1024
#: Packs on each level, and shards of each of the lowest, that a block visits in the first rounds; then all it may need.
ROUNDS = (1, 4)
#: Blocks that meet one pack, or one shard's tree, in a task; of more each such part gets a copy of the pack or tree.
TOGETHER = 64


def _regions(held: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds region, the nearest pivot of each vector."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (pivots * pivots).sum(1) / 2
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()).astype(float) if len(batch) else np.empty((0, pivots.shape[1]))
            yield batch.assign(region=(half - x @ pivots.T).argmin(1).astype(np.int32))

    return held.mapInPandas(nearest, "id long, x array<double>, region int")


def _parts(df: DataFrame, rows: int, name: str, seed: int) -> tuple[DataFrame, int]:
    """Adds ``name``, the number of a part of about ``rows`` rows of a region, and tells how many parts there are."""
    sizes = {r["region"]: -(-r["n"] // rows) for r in df.groupBy("region").agg(F.count("*").alias("n")).collect()}  # PIVOTS rows at most
    regions = range(PIVOTS)
    many = [sizes.get(k, 0) for k in regions]
    first = np.cumsum([0, *many]).tolist()
    at = F.col("region") + 1
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), at)
    return df.withColumn(name, of(first[:-1]) + F.pmod(id_hash("id", "x", seed=seed), F.greatest(of(many), F.lit(1)))), first[-1]


def _bounds(state: dict[str, np.ndarray], roots: dict[str, np.ndarray]) -> np.ndarray:
    """Upper bounds of each query's scores in each shard of a pack."""
    q, size = state["x"], np.sqrt((state["x"] ** 2).sum(1))
    slack = 1e-9 * (1 + size[:, None]) * np.maximum(1.0, roots["most"]) * q.shape[1] + 1e-6
    return q @ roots["centre"].T + size[:, None] * roots["radius"] + slack


def reachable(state: dict[str, np.ndarray], roots: dict[str, np.ndarray], most: int | None) -> np.ndarray:
    """Shards of a pack that a block has not seen and where a query may still reach its kth score; the ``most`` promising ones."""
    bound = _bounds(state, roots)
    bound[bound < state["best"][:, -1:]] = -np.inf
    reach = bound.max(0, initial=-np.inf)
    reach[np.isin(roots["shard"], state["seen"])] = -np.inf
    order = np.argsort(-reach, kind="stable")[:most]
    return roots["shard"][order[reach[order] > -np.inf]]


def _one_dimension(held: DataFrame, k: int, every: int, shard_rows: int, block_rows: int) -> DataFrame:
    # equal rows are one; an id's vectors are dealt each by itself, so that a common id fills no shard
    distinct = checkpointed(held.distinct())
    asked = distinct.where(F.col("id") % every == 0)
    # no more regions than there are full shards, or full blocks
    n, nq = (min(PIVOTS, max(1, df.count() // rows)) for df, rows in ((distinct, shard_rows), (asked, block_rows)))
    sample = distinct.orderBy(id_hash("id", "x", seed=2), "id").limit(max(n, nq)).toPandas()
    pivots = np.stack(sample["x"].to_numpy()).astype(float)
    vectors, shards = _parts(checkpointed(_regions(distinct, pivots[:n])), shard_rows, "shard", 3)
    queries, blocks = _parts(checkpointed(_regions(asked, pivots[:nq])), block_rows, "block", 5)

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        built = build_tree(part["id"].to_numpy(np.int64), np.stack(part["x"].to_numpy()).astype(float))
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "centre": [built["centre"][0]], "radius": [built["radius"][0]], "most": [float(np.abs(built["x"]).max(initial=0))], "tree": [_packed(**built)]})

    def block(part: pd.DataFrame) -> pd.DataFrame:
        n = len(part)
        state = _packed(id=part["id"].to_numpy(np.int64), x=np.stack(part["x"].to_numpy()).astype(float), best=np.full((n, k), NONE), ids=np.zeros((n, k), np.int64), seen=np.empty(0, np.int64))
        return pd.DataFrame({"block": [part["block"].iloc[0]], "state": [state]})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        """The balls of a pack, and a ball around them."""
        part = part.sort_values("node")
        centre, radius, most = np.stack(part["centre"].to_numpy()), part["radius"].to_numpy(float), part["most"].to_numpy(float)
        middle = centre.mean(0)
        around = float((np.sqrt(((centre - middle) ** 2).sum(1)) + radius).max())
        roots = _packed(shard=part["node"].to_numpy(np.int64), centre=centre, radius=radius, most=most)
        return pd.DataFrame({"pack": [part["pack"].iloc[0]], "roots": [roots], "centre": [middle], "radius": [around], "most": [most.max()]})

    def packs(nodes: DataFrame) -> DataFrame:
        held = nodes.withColumn("pack", F.expr(f"node div {PACK}")).groupBy("pack").applyInPandas(pack, "pack long, roots binary, centre array<double>, radius double, most double")
        return checkpointed(held)

    def wanted(batches: Iterator[pd.DataFrame], most: int | None, lowest: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                held = _unpacked(row.state)
                if not lowest:  # packs are no shards
                    held["seen"] = np.empty(0, np.int64)
                chosen = reachable(held, _unpacked(row.roots), most)
                yield pd.DataFrame({"block": np.full(len(chosen), row.block, np.int64), "node": chosen})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by shard and part, the tree first."""
        at, built = None, {}
        for batch in batches:
            for row in batch.itertuples():
                if row.block < 0:
                    at, built = row.shard, _unpacked(row.data)
                    continue
                assert at == row.shard
                state = _unpacked(row.data)
                ids, best = search(built, state["id"], state["x"], state["best"][:, -1], k)
                q, r = np.nonzero(best > NONE)
                yield pd.DataFrame({"block": np.full(len(q), row.block, np.int64), "query_id": state["id"][q], "place": q, "vec_id": ids[q, r], "score": best[q, r]})

    def merged(state: pd.DataFrame, found: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        held = _unpacked(state["state"].iloc[0])
        place, rank = found["place"].to_numpy(np.int64), found["rank"].to_numpy(np.int64) - 1
        held["best"][place, rank], held["ids"][place, rank] = found["score"].to_numpy(np.int64), found["vec_id"].to_numpy(np.int64)
        held["seen"] = np.append(held["seen"], seen)
        return pd.DataFrame({"block": state["block"], "state": [_packed(**held)]})

    trees = written(vectors.groupBy("shard").applyInPandas(tree, "shard long, centre array<double>, radius double, most double, tree binary"), "trees")
    levels = [packs(trees.select(F.col("shard").alias("node"), "centre", "radius", "most"))]
    number = -(-shards // PACK)
    while number > 1:
        levels.insert(0, packs(levels[0].select(F.col("pack").alias("node"), "centre", "radius", "most")))
        number = -(-number // PACK)
    salts = max(1, -(-blocks // TOGETHER))
    state = checkpointed(queries.groupBy("block").applyInPandas(block, "block long, state binary"))
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    steps = [m for m in ROUNDS if m < shards]
    found = None
    for most in [*steps, None]:
        # down from the single pack: each level tells the balls of the next that a block is held against
        # (0 as a column: a literal would leave the join without a key)
        pairs = state.select("block", F.expr("block div 9223372036854775807L").alias("node"))
        for level in levels:
            at = pairs.select("block", F.col("node").alias("pack"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
            balls = level.select("pack", "roots").join(at.select("pack", "salt").distinct(), "pack")
            asked = at.join(state, "block").join(balls.hint("shuffle_hash"), ["pack", "salt"]).select("block", "state", "roots")
            pairs = checkpointed(asked.mapInPandas(lambda b, most=most, lowest=level is levels[-1]: wanted(b, most, lowest), "block long, node long"))
        pairs = pairs.withColumnRenamed("node", "shard")
        # blocks go to the shards: a shard's tree leads its rows, in each part of a shard that many blocks visit
        parts = pairs.groupBy("shard").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
        one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        lead = trees.join(parts.select("shard", one), "shard").select("shard", "part", F.lit(-1).cast("long").alias("block"), F.col("tree").alias("data"))
        dealt = pairs.join(parts, "shard").select("shard", F.pmod(F.xxhash64("block"), "parts").alias("part"), "block")
        rows = lead.unionByName(dealt.join(state, "block").select("shard", "part", "block", F.col("state").alias("data")))
        hits = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "block").mapInPandas(visit, "block long, query_id long, place long, vec_id long, score long")
        found = hits if found is None else found.unionByName(hits)
        # an id's best score with a query's vector; a place is one vector of a query
        found = found.groupBy("block", "query_id", "place", "vec_id").agg(F.max("score").alias("score"))
        found = checkpointed(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        if most is not None:
            gone = pairs.groupBy("block").agg(F.collect_list("shard").alias("shards"))  # a few
            known = found.drop("query_id").join(gone, "block")
            state = checkpointed(state.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(lambda s, f: merged(s, f, f["shards"].iloc[0]) if len(f) else s, "block long, state binary"))
            found = found.drop("rank")
    final = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
