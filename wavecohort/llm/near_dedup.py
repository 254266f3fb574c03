"""Near-duplicate documents by HyperMinHash.

A document is the set of its five-word shingles. Each of its buckets has a hash function of its own and keeps, of the
least hash, the count of leading zeros and the first mantissa bits: two bytes. Buckets are banded four by four, a band
of two documents agreeing with probability J^4, so that a pair at the threshold shares none of 60 bands once in 10^10.
Documents are first compared with a few hubs of their bands, not with each other; a collision-corrected estimate of the
Jaccard index prunes, and full shingle sets confirm. What a band then still holds of different components is compared
across components. Both run in cells of bounded size, which give out rows of documents and as many links as connect them,
never pairs, so that no link between different texts is lost and no table grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_hash, mixed, release, spare_name, utf8, word_hashes, written
from .components import components

SHINGLE = 5
BANDS, ROWS = 60, 4
HUBS, NEAREST = 3, 4
SALTS = 64
MANTISSA = 10
#: A link needs 100 * intersection >= 75 * union.
PERCENT = 75
_BUCKETS = BANDS * ROWS
_STEPS = (np.random.default_rng(2**31 - 1).integers(0, 2**31, _BUCKETS, np.int64) * 2 + 1).astype(np.uint32)
_FACTORS = np.random.default_rng(2**31 - 2).integers(0, 2**62, SHINGLE, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes; fewer than five words are one shingle, no words are none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += h[k : k + n] * _FACTORS[k]
    return np.unique(mixed(total))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The buckets of nonempty sets, as uint16: leading zeros of the least hash above MANTISSA bits that follow its first one."""
    out = np.empty((len(sets), _BUCKETS), np.uint16)
    flat = np.concatenate(sets).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    turned = np.empty_like(flat)
    for j, step in enumerate(_STEPS):
        np.multiply(flat, step, out=turned)
        least = np.minimum.reduceat(turned, starts) | np.uint32(1)
        # the exponent and the first mantissa bits of a double are the same two numbers
        bits = least.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
        zeros = np.uint64(1023 + 31) - (bits >> np.uint64(MANTISSA))
        out[:, j] = (zeros << np.uint64(MANTISSA)) | (bits & np.uint64(2**MANTISSA - 1))
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the agreement that unrelated sets of these sizes show by chance.

    Two least hashes agree in a cell of relative width about 0.72 / 2**MANTISSA with probability
    0.72 * na * nb / (na + nb)**2 / 2**MANTISSA.
    """
    agree = (a == b).mean(1)
    chance = 0.72 * na * nb / (na + nb) ** 2.0 / 2**MANTISSA
    return (agree - chance) / (1 - chance)


#: Six standard deviations of the estimate below the threshold: a link is pruned once in 10^9.
PRUNE = PERCENT / 100 - 6 * (PERCENT / 100 * (1 - PERCENT / 100) / _BUCKETS) ** 0.5


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), n_shingles, set key (k1, k2: 128 bits that equal sets share) and registers (null for an empty set)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                sets = [shingle_set(t) for t in utf8(part["text"])]
                n = np.array([len(s) for s in sets], np.int64)
                regs: list = [None] * len(sets)
                full = np.flatnonzero(n)
                if len(full):
                    for i, row in zip(full, registers([sets[i] for i in full]).view(np.int64)):
                        regs[i] = row
                with np.errstate(over="ignore"):
                    k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    k2 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "h": part["h"].to_numpy(), "n_shingles": n, "k1": k1, "k2": k2, "registers": regs})
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInPandas(sign, "doc_id long, h long, n_shingles long, k1 long, k2 long, registers array<long>")


# A cell is a bounded piece of comparing: rows (k, i, j, id, role) of equal (k, i, j). Strays meet members there.
#: A member; a stray as a member; a stray as such; a stray that is both, where a grid has one cell.
MEMBER, ODD_MEMBER, STRAY, BOTH = range(4)
_CELL = ["k", "i", "j"]


def _dealt(cells: DataFrame, rows: int) -> DataFrame:
    """Cells dealt by hash to groups of about ``rows`` rows, so that small cells share a call."""
    groups = max(256, -(-cells.count() // rows))
    return cells.withColumn("dealt", F.pmod(F.xxhash64(*_CELL), F.lit(groups)))


def _cells(part: pd.DataFrame) -> Iterator[np.ndarray]:
    """The places of each cell's rows."""
    keys = [part[c].to_numpy(np.int64) for c in (*_CELL, "id")]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for c in keys[:3]:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return iter(np.split(order, np.flatnonzero(new)))


def promising(cells: DataFrame, reps: DataFrame, banded: bool) -> DataFrame:
    """Those rows of ``cells`` (k, i, j, id, role, component) that have a partner of another component with an estimate not below PRUNE.

    Where cells belong to bands (``banded``: the last six bits of k are the band's place) a pair counts in the first band
    that it shares only.
    """
    rows = _dealt(checkpointed(cells), 4000).join(reps.select(F.col("rep").alias("id"), "n_shingles", "registers"), "id")

    def pruned(part: pd.DataFrame) -> pd.DataFrame:
        ids, role, comp, n, k = (part[c].to_numpy(np.int64) for c in ("id", "role", "component", "n_shingles", "k"))
        keys = np.stack(part["registers"].to_numpy()).astype(np.int64)
        regs, size = keys.view(np.uint16), n.astype(float)
        wanted = np.zeros(len(ids), bool)
        for at in _cells(part):
            strays, members = at[role[at] >= STRAY], at[role[at] != STRAY]
            odd = role[members] != MEMBER
            for x in strays.tolist():
                # two strays meet twice, and count once
                near = members[(comp[members] != comp[x]) & (~odd | (ids[members] > ids[x])) & (100 * np.minimum(n[members], n[x]) >= PERCENT * np.maximum(n[members], n[x]))]
                if banded and len(near):
                    near = near[(keys[near] == keys[x]).argmax(1) == (k[x] & 63)]
                if len(near):
                    hit = near[estimate(regs[near], regs[x][None], size[near], size[x]) >= PRUNE]
                    wanted[hit] = True
                    wanted[x] |= len(hit) > 0
        return part.loc[wanted, [*_CELL, "id", "role"]]

    return checkpointed(rows.groupBy("dealt").applyInPandas(pruned, "k long, i long, j long, id long, role int"))


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sorted sets, left x right: products of membership matrices, some columns at a time."""
    known = left[0] if len(left) == 1 else np.unique(np.concatenate(left))
    owner = np.repeat(np.arange(len(right)), [len(r) for r in right])
    flat = np.concatenate(right)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    held = known[at] == flat
    if len(left) == 1:
        return np.bincount(owner[held], minlength=len(right))[None]
    owner, at = owner[held], at[held]
    used, at = np.unique(at, return_inverse=True)  # columns that both sides have
    known = known[used]
    first = np.repeat(np.arange(len(left)), [len(x) for x in left])
    flat = np.concatenate(left)
    to = np.searchsorted(known, flat)
    held = np.append(known, 0)[to] == flat
    held &= to < len(known)
    first, to = first[held], to[held]
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(known), columns):
        x, y = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        mine, yours = (to >= a) & (to < a + columns), (at >= a) & (at < a + columns)
        x[first[mine], to[mine] - a] = 1
        y[owner[yours], at[yours] - a] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Of the links of a matrix (rows and columns are two kinds of nodes) as many as connect what they all connect."""
    edges: list[tuple[int, int]] = []
    rows, columns = linked.any(1), linked.any(0)
    while rows.any():
        edge = np.array([int(rows.argmax())])
        rows[edge] = False
        while len(edge):
            reached = np.flatnonzero(linked[edge].any(0) & columns)
            columns[reached] = False
            edges += zip(edge[linked[np.ix_(edge, reached)].argmax(0)].tolist(), reached.tolist()) if len(reached) else ()
            edge = np.flatnonzero(linked[:, reached].any(1) & rows)
            rows[edge] = False
            edges += zip(edge.tolist(), reached[linked[np.ix_(edge, reached)].argmax(1)].tolist()) if len(edge) else ()
    return edges


def confirmed(cells: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between strays and members of ``cells`` by their texts' full shingle sets: in each cell as many as connect what its links connect."""
    # a class has the text of one of its rows; -1 stands for no doc_id, the hash tells its rows apart
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("of"), F.xxhash64("text").alias("h"), "text").where("text is not null")
    held = _dealt(cells, 1000).join(reps.select(F.col("rep").alias("id"), F.coalesce("doc_id", F.lit(-1)).alias("of"), "h"), "id").join(texts, ["of", "h"])

    def links(part: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t) for t in utf8(part["text"])]
        ids, role = part["id"].to_numpy(np.int64), part["role"].to_numpy(np.int64)
        full = np.array([len(s) > 0 for s in sets], bool)
        out: list[tuple[int, int]] = []
        for at in _cells(part):
            at = at[full[at]]
            at = at[np.append(True, (ids[at[1:]] != ids[at[:-1]]) | (role[at[1:]] != role[at[:-1]]))] if len(at) else at  # repeated rows
            strays, members = at[role[at] >= STRAY], at[role[at] != STRAY]
            if len(strays) and len(members):
                both = intersections([sets[x] for x in strays], [sets[x] for x in members])
                n, m = (np.array([len(sets[x]) for x in side], np.int64) for side in (strays, members))
                linked = 100 * both >= PERCENT * (n[:, None] + m[None] - both)
                out += ((ids[strays[x]], ids[members[y]]) for x, y in forest(linked))
        release()
        return pd.DataFrame(sorted({(min(x), max(x)) for x in out if x[0] != x[1]}), columns=["a", "b"]).astype(np.int64)

    return checkpointed(held.groupBy("dealt").applyInPandas(links, "a long, b long").distinct())


def _blocks(count: str, shingles: str, block: int) -> Column:
    """How many blocks hold ``count`` documents with ``shingles`` shingles: ``block`` documents, or 250 times as many shingles, each."""
    return F.greatest(F.ceil(F.col(count) / block), F.ceil(F.col(shingles) / (250 * block)))


def stars(members: DataFrame, block: int) -> DataFrame:
    """Cells of each hub with the documents that share a band with it: a hub is a stray, and meets each block of them."""
    # several hubs a band, each the least member in an order of its own, so that who is linked with none of them is rare
    least = [F.min_by("rep", id_hash("rep", seed=s)).alias(f"hub{s}") for s in range(1, HUBS)]
    hubs = members.groupBy("band").agg(F.min("rep").alias("hub0"), *least)
    pairs = members.join(hubs, "band").select("rep", "n", F.explode(F.array_distinct(F.array(*[f"hub{s}" for s in range(HUBS)]))).alias("hub")).where("rep <> hub")
    low, high = F.least("rep", "hub"), F.greatest("rep", "hub")
    pairs = pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.count("*").alias("bands"), F.min("hub").alias("k"), F.max(F.when(F.col("rep") == low, F.col("n"))).alias("n_low"), F.max(F.when(F.col("rep") == high, F.col("n"))).alias("n_high"))
    first = F.col("k") == F.col("low")
    spokes = pairs.select("k", "bands", F.when(first, F.col("high")).otherwise(F.col("low")).alias("id"), F.when(first, F.col("n_high")).otherwise(F.col("n_low")).alias("n"))
    # a few hubs connect a document that has a link at all: those it shares most bands with. What they miss, the grids compare
    nearest = Window.partitionBy("id").orderBy(F.desc("bands"), "k")
    spokes = checkpointed(spokes.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= NEAREST).drop("place", "bands"))
    sizes = spokes.groupBy("k").agg(F.count("*").alias("count"), F.sum("n").alias("shingles")).select("k", _blocks("count", "shingles", block).alias("blocks"))
    # a hub may have a third of all documents: they meet its size under SALTS keys
    several = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    zero = F.lit(0).cast("long").alias("j")
    spokes = spokes.withColumn("salt", F.pmod(id_hash("id", seed=54), F.lit(SALTS)).cast("int")).join(several, ["k", "salt"], "left").select("k", F.pmod(id_hash("id", seed=53), F.coalesce("blocks", F.lit(1))).alias("i"), zero, "id", F.lit(MEMBER).alias("role"))
    centres = sizes.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), zero, F.col("k").alias("id"), F.lit(STRAY).alias("role"))
    return spokes.unionByName(centres).withColumn("component", F.col("id"))


def grids(members: DataFrame, label: DataFrame, block: int) -> DataFrame:
    """Cells in which the documents of a band that do not belong to its largest component meet all the others of other components.

    Bands of the same documents stand for each other, the one with the least place for all.
    """
    placed = members.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = checkpointed(placed)
    mark = [F.xxhash64(F.lit(s), "rep") for s in (61, 62)]
    small = [F.sum(F.pmod(m, F.lit(2**31 - 1))).alias(f"m{k}") for k, m in enumerate(mark)]
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.bit_xor(mark[0]).alias("m"), *small)
    bands = parts.groupBy("band").agg(F.max(F.struct("n_docs", "component")).alias("most"), F.count("*").alias("components"), F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"), F.max_by("n", F.struct("n_docs", "component")).alias("n_most"), F.bit_xor("m").alias("m"), F.sum("m0").alias("m0"), F.sum("m1").alias("m1"))
    bands = bands.where("components > 1").withColumn("first", F.row_number().over(Window.partitionBy("m", "m0", "m1", "n_docs").orderBy(F.col("band").bitwiseAND(63), "band"))).where("first = 1")
    bands = bands.select("band", F.col("most.component").alias("main"), (F.col("n_docs") - F.col("most.n_docs")).alias("others"), (F.col("n") - F.col("n_most")).alias("n_others"), "n_docs", F.col("n").alias("n_all"))
    bands = bands.select("band", "main", _blocks("others", "n_others", block).alias("across"), _blocks("n_docs", "n_all", block).alias("down"))
    held = placed.join(bands, "band").withColumn("odd", F.col("component") != F.col("main"))
    # row i, column j of a band's grid: strays of part i meet all members of part j. In a grid of one cell a row stands for both
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    part = lambda seed, parts: F.pmod(id_hash("rep", seed=seed), parts)
    member = F.when(F.col("odd"), ODD_MEMBER).otherwise(MEMBER)
    as_member = F.transform(to(F.col("across")), lambda i: F.struct(i.alias("i"), part(52, F.col("down")).alias("j"), member.alias("role")))
    as_stray = F.transform(to(F.col("down")), lambda j: F.struct(part(51, F.col("across")).alias("i"), j.alias("j"), F.lit(STRAY).alias("role")))
    as_both = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(BOTH).alias("role")))
    cells = F.when(~F.col("odd"), as_member).when((F.col("across") == 1) & (F.col("down") == 1), as_both).otherwise(F.concat(as_member, as_stray))
    return held.select(F.col("band").alias("k"), "rep", "component", F.explode(cells).alias("c")).select("k", "c.i", "c.j", F.col("rep").alias("id"), "c.role", "component")


def classes(signed: DataFrame) -> DataFrame:
    """A row for each set: k1, k2, n_shingles, registers, doc_id and h of its first row (null ids last), and its number ``rep``.

    The number is that doc_id. Where one id is the first of several sets, and where a set has no id, it is a hash above
    all of them, so that no two sets are one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")
    held = signed.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(first, F.first("registers").alias("registers"))
    held = written(held.select("k1", "k2", "n_shingles", "registers", "first.doc_id", "first.h"), "sets")
    least = held.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "n_shingles")).alias("own")).where("n > 1").drop("n")
    odd = F.col("doc_id").isNull() | (F.col("own") != F.struct("k1", "k2", "n_shingles"))
    return held.join(least, "doc_id", "left").withColumn("rep", F.when(odd, id_hash("k1", "k2", "n_shingles", seed=57).bitwiseOR(F.lit(2**62))).otherwise(F.col("doc_id"))).drop("own")


def judged(docs: DataFrame, block: int = 1024) -> DataFrame:
    """doc_id, h, n_shingles and component (null for an empty set) of each row of ``docs``; least, the component's least doc_id (null: it has none)."""
    signed = written(signatures(docs), "signed")
    reps = written(classes(signed), "classes")
    banded = reps.select("rep", F.col("n_shingles").alias("n"), F.posexplode("registers").alias("at", "key"))
    banded = banded.select("rep", "n", F.xxhash64("at", "key").bitwiseAND(F.lit(-64)).bitwiseOR(F.col("at").cast("long")).alias("band"))
    several = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = checkpointed(banded.join(several.select("band"), "band"))
    links = confirmed(promising(stars(members, block), reps, False), reps, docs)
    label = components(links)
    further = confirmed(promising(grids(members, label, block), reps, True), reps, docs)
    if not further.isEmpty():
        label = components(links.unionByName(further))
    known = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n_shingles", "rep", "doc_id", F.coalesce("component", "rep").alias("component"))
    odd = known.where("rep >= bigint(pow(2, 62))")
    if odd.isEmpty():
        known = known.select("k1", "k2", "n_shingles", "component", F.col("component").alias("least"))
    else:  # a number that is no doc_id: the component's ids are looked up. A few, unless ids repeat
        others = odd.groupBy("component").agg(F.min("doc_id").alias("other"))
        numbered = F.when(F.col("component") < 2**62, F.col("component"))
        known = known.join(others, "component", "left").select("k1", "k2", "n_shingles", "component", F.least(numbered, "other").alias("least"))
    return signed.drop("registers").join(known, ["k1", "k2", "n_shingles"], "left").select("doc_id", "h", "n_shingles", "component", "least")


def near_duplicates(docs: DataFrame, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text; other columns are ignored).

    Equal shingle sets are one class, and only classes are compared. Null or empty texts have no shingles and are linked
    with nothing. Rows that repeat a doc_id are judged by their own texts; a row without doc_id gets no component (null)
    and is kept. A very long text is one row of a batch, and is read whole. Empty table: no rows.
    """
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), None).otherwise(F.col("least"))
    out = judged(docs, block).select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the least doc_id (null ids last), all columns unchanged; a column of any name stays.

    Rows go by their id and text, so that an id with two texts may keep either. Of rows that repeat id and text one
    stays. Texts without words all stay.
    """
    rows = written(judged(docs).where("component is not null").select("component", F.coalesce("doc_id", F.lit(-1)).alias("of"), F.col("doc_id").isNull().alias("none"), "h"), "judged")
    best = rows.groupBy("component").agg(F.min(F.struct("none", "of", "h")).alias("best"))
    counted = rows.groupBy("component", "none", "of", "h").agg(F.count("*").alias("n")).join(best, "component")
    stays = F.col("best") == F.struct("none", "of", "h")
    told = counted.where(~stays | (F.col("n") > 1)).select("none", "of", "h", stays.alias("stays"))  # no row: as it is
    names = {c: spare_name(docs, c) for c in ("none", "of", "h", "stays")}
    told = told.select(*[F.col(c).alias(n) for c, n in names.items()])
    given = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(*given, F.col("doc_id").isNull().alias(names["none"]), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias(names["of"]), F.xxhash64("text").alias(names["h"]))
    held = held.join(told, [names[c] for c in ("none", "of", "h")], "left")
    alone = held.where(F.col(names["stays"]).isNull()).select(*given)
    key = [names["none"], names["of"], names["h"]]
    repeats = held.where(F.col(names["stays"])).groupBy(*key).agg(F.min_by(F.struct(*given), F.to_json(F.struct(*given))).alias(names["stays"]))
    return alone.unionByName(repeats.select(*[F.col(names["stays"]).getField(c).alias(c) for c in docs.columns]))
