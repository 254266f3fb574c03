"""Repeated word passages by relative Lempel-Ziv parsing.

Segments of text that may repeat are routed to reference blocks (see ``routed``). A block indexes its windows of WIDTH
words by hash, with how often and where they first occur, and every segment is factored greedily against that index:
where a window occurs elsewhere too, the factor is the longest match with that reference; else the word is a literal.
A factor's windows are duplicates; windows across a factor's end are looked up one by one, so nothing is missed there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import routed
from .common import flat_ranges, mixed, runs, sliding_min, word_hashes
from .suffix_dedup import spans

WIDTH = 35
GRAM = 6
BLOCK_WORDS = 400_000
_FACTORS = np.random.default_rng(2**31 - 3).integers(0, 2**62, WIDTH, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_OTHERS = np.random.default_rng(2**31 - 4).integers(0, 2**62, WIDTH, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _FACTORS[0]
    for k in range(1, width):
        out += h[k : k + n] * _FACTORS[k]
    return mixed(out)


def inside(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` window starts lie in one text, given the texts' offsets."""
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    some = lengths > 0
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, offsets[:-1][some], 1)
    np.add.at(edges, (offsets[:-1] + lengths)[some], -1)
    return np.cumsum(edges[:n]) > 0


@dataclass
class Index:
    """The windows of a reference block: distinct hashes, their weighted counts, first and last places."""

    value: np.ndarray
    count: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, window: np.ndarray, place: np.ndarray, weight: np.ndarray) -> Index:
        value, first, at = np.unique(window, return_index=True, return_inverse=True)
        last = np.zeros(len(value), np.int64)
        np.maximum.at(last, at, place)
        return cls(value, np.bincount(at, weight).astype(np.int64), place[first], last)

    def find(self, window: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.value, window)


def parse(h: np.ndarray, offsets: np.ndarray, weight: np.ndarray, width: int = WIDTH, exact: np.ndarray | None = None) -> np.ndarray:
    """Which window starts of the segments (words ``h``, cut at ``offsets``, each seen ``weight`` times) are duplicates.

    All segments are parsed at once, a factor or literal of each at a time. ``exact`` numbers the words: hashes find a
    reference, and a window is accepted when its words are those of the reference.
    """
    exact = h if exact is None else exact
    n = len(h)
    window = np.zeros(n, np.uint64)
    window[: max(0, n - width + 1)] = windows(h, width)
    valid = inside(offsets, width, n)
    owner = np.repeat(np.arange(len(weight)), np.diff(offsets))
    at = np.flatnonzero(valid)
    duplicate = np.zeros(n, bool)
    if not len(at):
        return duplicate
    index = Index.of(window[at], at, weight[owner[at]].astype(float))
    across = np.arange(width)

    def accepted(p: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Another place of each window, or its own where its segment itself occurs again; whether the words are the same."""
        ref = np.where(index.first[found] != p, index.first[found], index.last[found])
        same = np.ones(len(p), bool)
        for a in range(0, len(p), 20_000):
            same[a : a + 20_000] = (exact[p[a : a + 20_000, None] + across] == exact[ref[a : a + 20_000, None] + across]).all(1)
        return ref, same & ((ref != p) | (weight[owner[p]] > 1))

    stop = offsets[1:]
    here = offsets[:-1].copy()
    active = np.flatnonzero(stop - here >= width)
    while len(active):
        p = here[active]
        found = index.find(window[p])
        elsewhere = index.count[found] > 1
        hit = np.flatnonzero(elsewhere)
        ref, elsewhere[hit] = accepted(p[hit], found[hit])
        ref = ref[elsewhere[hit]]
        # a literal: the parse goes on at the next word
        here[active[~elsewhere]] += 1
        rows, p, found = active[elsewhere], p[elsewhere], found[elsewhere]
        if len(rows):
            length = np.full(len(rows), width, np.int64)
            most = np.minimum(stop[rows] - p, stop[owner[ref]] - ref)
            growing = np.flatnonzero(length < most)
            # the same place is its own match; it grows to the end at once
            own = ref == p
            length[own] = most[own]
            growing = growing[~own[growing]]
            while len(growing):
                same = h[p[growing] + length[growing]] == h[ref[growing] + length[growing]]
                growing = growing[same]
                length[growing] += 1
                growing = growing[length[growing] < most[growing]]
            duplicate[flat_ranges(p, length - width + 1)] = True
            # windows across the factor's end
            tail = flat_ranges(p + length - width + 1, np.full(len(rows), width - 1))
            tail = tail[(tail < np.repeat(stop[rows], width - 1))]
            tail = tail[valid[tail]]
            found = index.find(window[tail])
            several = index.count[found] > 1
            tail = tail[several]
            duplicate[tail[accepted(tail, found[several])[1]]] = True
            here[rows] = p + length
        active = active[stop[active] - here[active] >= width]
    return duplicate


@dataclass
class _Batch:
    words: list[bytes]
    hashes: np.ndarray
    offsets: np.ndarray
    rows: int
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    row: np.ndarray
    alone: np.ndarray
    shared: np.ndarray
    kept: dict = field(default_factory=dict)


class Words(routed.Unit):
    """Windows of WIDTH words; one repeats if its word sequence begins anywhere else, its own document included."""

    width = WIDTH
    merge = np.add

    def load(self, ids, texts):
        cut = [t.split() for t in texts]
        offsets = np.cumsum([0] + [len(c) for c in cut])
        words = [w for c in cut for w in c]
        h = word_hashes(words)
        grams = windows(h, GRAM)
        reach = WIDTH - GRAM + 1
        least = sliding_min(grams, reach)
        at = np.flatnonzero(inside(offsets, WIDTH, len(least)))
        m = least[at]
        cutting = np.flatnonzero((m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first = np.concatenate(([0], cutting)) if len(at) else np.empty(0, np.int64)
        start, count, anchor = at[first], np.diff(np.append(first, len(at))), m[first]
        row = np.searchsorted(offsets, start, side="right") - 1
        # an anchor is shared here if its gram begins at two places of the batch
        alone = np.unique(anchor)
        where = np.searchsorted(alone, grams)
        hit = alone[np.minimum(where, max(0, len(alone) - 1))] == grams if len(alone) else np.zeros(len(grams), bool)
        shared = np.bincount(where[hit], minlength=len(alone)) > 1
        return _Batch(words, h, offsets, len(texts), start, count, anchor, row, alone, shared[: len(alone)])

    def segments(self, batch, hot):
        if "segments" not in batch.kept:
            pick = np.flatnonzero(np.isin(batch.anchor, hot)) if len(hot) else np.empty(0, np.int64)
            known: dict[bytes, int] = {}
            which = np.empty(len(pick), np.int64)
            words = batch.words
            for k, (a, n) in enumerate(zip(batch.start[pick].tolist(), batch.count[pick].tolist())):
                which[k] = known.setdefault(b" ".join(words[a : a + n + WIDTH - 1]), len(known))
            anchor = np.empty(len(known), np.uint64)
            anchor[which] = batch.anchor[pick]
            batch.kept["segments"] = (anchor, np.bincount(which, minlength=len(known)).astype(np.int64), list(known))
            batch.kept["pick"], batch.kept["which"] = pick, which
        return batch.kept["segments"]

    def resolve(self, anchor, weight, content):
        """The duplicate windows of each segment, numbered from its start."""
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(c, len(known)) for c in content], np.int64)
        texts = list(known)
        times = np.bincount(which, weight.astype(float), len(texts)).astype(np.int64)
        group = np.empty(len(texts), np.uint64)
        group[which] = anchor
        order = np.argsort(group, kind="stable")
        begin, end = runs(group[order])
        size = np.array([t.count(b" ") + 1 for t in texts], np.int64)
        filled = np.cumsum(size[order])
        found: list[np.ndarray | None] = [None] * len(texts)
        a = 0
        while a < len(begin):  # blocks of whole anchors
            base = filled[begin[a]] - size[order[begin[a]]]
            z = max(a + 1, int(np.searchsorted(filled[end - 1], base + BLOCK_WORDS, side="right")))
            block = order[begin[a] : end[z - 1]].tolist()
            words = [w for i in block for w in texts[i].split(b" ")]
            offsets = np.cumsum([0] + [int(size[i]) for i in block])
            number: dict[bytes, int] = {}
            exact = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            duplicate = parse(word_hashes(words), offsets, times[block], exact=exact)
            for i, s, e in zip(block, offsets.tolist(), offsets[1:].tolist()):
                hit = np.flatnonzero(duplicate[s : e - WIDTH + 1])
                found[i] = hit if len(hit) else None
            a = z
        return [found[i] for i in which.tolist()]

    def keys(self, batch, start):
        k1, k2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for k in range(WIDTH):
            h = batch.hashes[start + k]
            k1 += h * _FACTORS[k]
            k2 += h * _OTHERS[k]
        return mixed(k1), mixed(k2)

    def weights(self, batch, row):
        return np.ones(len(row), np.int64)

    def finish(self, batch, hot, told, single):
        self.segments(batch, hot)
        pick, which = batch.kept["pick"], batch.kept["which"]
        again = single.weight[single.which] > 1
        rows, starts = [single.row[again]], [single.start[again]]
        for k, (w, r, s) in enumerate(zip(which.tolist(), batch.row[pick].tolist(), batch.start[pick].tolist())):
            hit = told.get(w)
            if hit is not None:
                rows.append(np.full(len(hit), r))
                starts.append(hit + s)
        row, start = np.concatenate(rows), np.concatenate(starts)
        order = np.argsort(row, kind="stable")
        row, start = row[order], start[order] - batch.offsets[row[order]]
        return np.split(start, np.searchsorted(row, np.arange(1, batch.rows)))


def duplicate_passages(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) with n_words, spans (removed words, maximal runs) and kept.

    kept is the words that no repeated window covers, joined by one space. Null text has no words. Rows that repeat a
    doc_id are documents like others, so that their passages repeat. Columns of ``docs`` named like a new one give way to it.
    Empty table: no rows.
    """

    def finished(text, starts):
        words = text.split()
        gone = spans(starts, WIDTH)
        left = [w for a, z in zip([0] + [z for _, z in gone], [a for a, _ in gone] + [len(words)]) for w in words[a:z]]
        return len(words), [{"start": a, "end": z} for a, z in gone], b" ".join(left).decode("utf-8", "surrogatepass")

    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    extra = pa.schema([("n_words", pa.int64()), ("spans", kinds), ("kept", pa.string())])
    return routed.repeats(docs, Words(), finished, extra, "n_words long, spans array<struct<start:bigint,end:bigint>>, kept string", **options)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of ``duplicate_passages``."""
    out = duplicate_passages(docs.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
