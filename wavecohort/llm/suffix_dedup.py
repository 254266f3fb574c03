"""Repeated byte strings by suffix arrays, built by two-stage sorting.

Segments that may repeat are routed to blocks (see ``routed``). A block's suffix array sorts directly only suffixes
that are smaller than their successors; scanning the buckets of first characters in order induces the others. Windows
whose neighbours in the array have a common prefix of the full width are equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import routed
from .common import flat_ranges, mixed, runs, sliding_min, spare_name

WIDTH = 50
GRAM = 16
BLOCK = 1_000_000
_NO_ID = np.iinfo(np.int64).max
_FACTORS = np.random.default_rng(2**31 - 5).integers(0, 2**62, (2, 7), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each byte, little-endian; the end is padded with zeros."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), "<u8", padded.data, strides=(1,))


def suffix_array(data: np.ndarray, ends: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of the strings in ``data`` (string k ends before ``ends[k]``), sorted to ``depth`` bytes.

    A string's end is smaller than every byte. Suffixes that agree in ``depth`` bytes are neighbours in any order.
    ``wanted``: only suffixes that begin among a string's first so many bytes are asked for. Later ones are left out,
    but for those up to the first that is sorted directly, from which the wanted ones before it are induced.
    """
    n = len(data)
    # ends take a place of their own in the text: character 0 with bytes above it
    lengths = np.diff(np.concatenate(([0], ends)))
    codes = np.zeros(n + len(ends), np.uint16)
    place = np.arange(n) + np.repeat(np.arange(len(ends)), lengths)
    codes[place] = data.astype(np.uint16) + 1
    total = len(codes)
    stops = np.flatnonzero(codes == 0)
    # a suffix is smaller than its successor if, after a run of its first character, a larger one comes
    first, last = runs(codes)
    following = np.zeros(len(last), np.uint16)
    following[:-1] = codes[last[:-1]]
    smaller = np.repeat(codes[first] < following, last - first)
    smaller[stops] = False
    larger = ~smaller
    larger[stops] = False
    if wanted is not None:
        opens = np.concatenate(([0], stops[:-1] + 1))
        # of each string the first directly sorted suffix at or after the wanted ones; its end if there is none
        direct = np.concatenate((np.flatnonzero(smaller), [total]))
        last_needed = np.minimum(direct[np.searchsorted(direct, opens + np.maximum(wanted - 1, 0))], stops)
        needed = np.arange(total) <= np.repeat(last_needed, np.diff(np.concatenate(([-1], stops))))
        smaller &= needed
        larger &= needed
    # stage one: sort the smaller ones by their first bytes, eight at a time from the last
    own = np.flatnonzero(smaller)
    text = np.zeros(total, np.uint8)
    text[place] = data
    big = words_at(text).byteswap()
    left = np.repeat(stops, np.diff(np.concatenate(([-1], stops)))) - np.arange(total)  # bytes to the end
    keys = []
    for at in range(0, depth, 8):
        rest = np.clip(left[own] - at, 0, 8).astype(np.uint64)
        key = big[np.minimum(own + at, total - 1)]
        mask = np.where(rest >= 8, np.uint64(2**64 - 1), ~(np.uint64(2**64 - 1) >> (np.minimum(rest, 7) * np.uint64(8))))
        keys.append(key & mask)
    keys.append(np.minimum(left[own], depth))  # padding equals zero bytes, but the shorter string is the smaller
    own = own[np.lexsort(keys[::-1])]
    own_codes = codes[own]
    own_start = np.searchsorted(own_codes, np.arange(258))
    # stage two: scan the buckets; each suffix found places its predecessor, if that one is the larger
    queue: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[larger[before]]
        chars = codes[before]
        same = before[chars == c]
        before, chars = before[chars > c], chars[chars > c]
        if len(before):
            order = np.argsort(chars, kind="stable")
            a, z = runs(chars[order])
            for s, e in zip(a.tolist(), z.tolist()):
                queue[int(chars[order[s]])].append(before[order[s:e]])
        return same

    for c in range(257):
        wave = np.concatenate(queue[c]) if queue[c] else np.empty(0, np.int64)
        if c == 0:
            wave = stops
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        mine = own[own_start[c] : own_start[c + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, c)
    order = np.concatenate(out)
    order = order[codes[order] > 0]
    back = np.zeros(total, np.int64)
    back[place] = np.arange(n)
    return back[order]


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Bytes, ``cap`` at most, that each start in ``order`` but the first has in common with the one before it.

    Every start must have ``cap`` bytes after it.
    """
    eight = words_at(data)
    out = np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.arange(len(out))
    for at in range(0, cap, 8):
        a, b = eight[np.minimum(order[alive] + at, len(data) - 1)], eight[np.minimum(order[alive + 1] + at, len(data) - 1)]
        x = a ^ b
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        out[alive[differ]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[~differ]
    out[alive] = cap
    return np.minimum(out, cap)


@dataclass
class _Batch:
    data: bytes
    offsets: np.ndarray
    ids: np.ndarray
    start: np.ndarray  # of runs of windows
    count: np.ndarray
    anchor: np.ndarray
    row: np.ndarray
    alone: np.ndarray
    shared: np.ndarray
    kept: dict = field(default_factory=dict)


class Bytes(routed.Unit):
    """Strings of WIDTH bytes; a window repeats if it begins in a document with a smaller id too."""

    width = WIDTH
    merge = np.minimum
    numbers = 2  # the least document that has a segment, and the one that an answer is asked for

    def load(self, ids, texts):
        offsets = np.cumsum([0] + [len(t) for t in texts])
        data = b"".join(texts)
        whole = np.frombuffer(data, np.uint8)
        parts = []
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 500_000, side="right")) - 1)
            parts.append(self._runs(whole[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], a, int(offsets[a])))
            a = z
        start, count, anchor, row = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64 if k != 2 else np.uint64) for k in range(4))
        numbers = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        # an anchor is shared here if two documents have it; rows without an id are never larger than another
        order = np.lexsort((numbers[row], anchor))
        a_sorted, i_sorted = anchor[order], numbers[row][order]
        alone, first = np.unique(a_sorted, return_index=True)
        shared = i_sorted[first] != i_sorted[np.append(first[1:], len(order)) - 1] if len(alone) else np.empty(0, bool)
        return _Batch(data, offsets, numbers, start, count, anchor, row, alone, shared)

    @staticmethod
    def _runs(data, offsets, row, base):
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
        if len(data) < WIDTH:
            return none
        eight = words_at(data)
        h = mixed(eight[: len(data) - GRAM + 1] * np.uint64(0xA0761D6478BD642F) + np.ascontiguousarray(eight[GRAM - 8 :][: len(data) - GRAM + 1]) * np.uint64(0xE7037ED1A0B428DB))
        least = sliding_min(h, WIDTH - GRAM + 1)
        inside = np.zeros(len(least) + 1, np.int64)  # windows that lie in one text
        lengths = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
        some = lengths > 0
        np.add.at(inside, offsets[:-1][some], 1)
        np.add.at(inside, (offsets[:-1] + lengths)[some], -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        if not len(at):
            return none
        m = least[at]
        cut = np.flatnonzero((m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first = np.concatenate(([0], cut))
        start = at[first]
        owner = np.searchsorted(offsets, start, side="right") - 1
        return start + base, np.diff(np.append(first, len(at))), m[first], owner + row

    def segments(self, batch, hot):
        if "segments" not in batch.kept:
            pick = np.flatnonzero(np.isin(batch.anchor, hot)) if len(hot) else np.empty(0, np.int64)
            known: dict[bytes, int] = {}
            which = np.empty(len(pick), np.int64)
            data, starts, stops = batch.data, batch.start[pick].tolist(), (batch.start + batch.count + WIDTH - 1)[pick].tolist()
            for k, (a, z) in enumerate(zip(starts, stops)):
                which[k] = known.setdefault(data[a:z], len(known))
            content = list(known)
            anchor, weight = np.empty(len(content), np.uint64), np.full(len(content), _NO_ID)
            anchor[which] = batch.anchor[pick]
            own = batch.ids[batch.row[pick]]
            np.minimum.at(weight, which, own)
            # a segment that several documents of the batch have is asked for the next of them
            asked = np.full(len(content), _NO_ID)
            larger = own > weight[which]
            np.minimum.at(asked, which[larger], own[larger])
            asked = np.where(np.bincount(which[larger], minlength=len(content)) > 0, asked, weight)
            batch.kept["segments"] = (anchor, np.stack((weight, asked), 1), content)
            batch.kept["pick"], batch.kept["which"] = pick, which
        return batch.kept["segments"]

    def resolve(self, anchor, weight, content):
        """The least document of each window, where it is less than the one that is asked for."""
        weight, asked = weight.T
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(c, len(known)) for c in content], np.int64)
        texts = list(known)
        owner = np.full(len(texts), _NO_ID)
        np.minimum.at(owner, which, weight)
        group = np.empty(len(texts), np.uint64)
        group[which] = anchor
        order = np.argsort(group, kind="stable")
        size = np.array([len(t) for t in texts], np.int64)
        least: list[np.ndarray | None] = [None] * len(texts)
        begin, end = runs(group[order])
        filled = np.cumsum(size[order])
        a = 0
        while a < len(begin):  # blocks of whole anchors
            base = filled[begin[a]] - size[order[begin[a]]]
            z = max(a + 1, int(np.searchsorted(filled[end - 1], base + BLOCK, side="right")))
            block = order[begin[a] : end[z - 1]]
            for i, found in zip(block.tolist(), self.block_least([texts[i] for i in block], owner[block])):
                least[i] = found
            a = z
        answers: list[np.ndarray | None] = []
        for i, own in zip(which.tolist(), asked.tolist()):
            answers.append(least[i] if (least[i] < own).any() else None)
        return answers

    @staticmethod
    def block_least(texts, owner):
        """For each text the least owner of each of its windows, over all texts of the block."""
        size = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(size)
        order = suffix_array(data, ends, WIDTH, size - WIDTH + 1)
        text = np.repeat(np.arange(len(texts)), size)
        order = order[ends[text[order]] - order >= WIDTH]
        prefix = common_prefixes(data, order, WIDTH)
        first = np.concatenate(([0], np.flatnonzero(prefix < WIDTH) + 1))
        least = np.minimum.reduceat(owner[text[order]], first)
        by_start = np.empty(len(data), np.int64)
        by_start[order] = np.repeat(least, np.diff(np.append(first, len(order))))
        return [by_start[e - s : e - WIDTH + 1] for s, e in zip(size.tolist(), ends.tolist())]

    def keys(self, batch, start):
        eight = words_at(np.frombuffer(batch.data, np.uint8))
        k1, k2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for k, at in enumerate((0, 8, 16, 24, 32, 40, WIDTH - 8)):
            h = mixed(eight[start + at])
            k1 += h * _FACTORS[0, k]
            k2 += h * _FACTORS[1, k]
        return mixed(k1), mixed(k2)

    def weights(self, batch, row):
        return batch.ids[row]

    def finish(self, batch, hot, told, single):
        self.segments(batch, hot)
        pick, which = batch.kept["pick"], batch.kept["which"]
        row, start = batch.row[pick], batch.start[pick]
        ids = batch.ids[row]
        again = single.weight[single.which] < batch.ids[single.row]
        gone: list[tuple[np.ndarray, np.ndarray]] = [(single.row[again], single.start[again])]
        # an answer has the least document of each of its windows: which of them are less than each of its runs' own
        order = np.argsort(which, kind="stable")
        begin, end = runs(which[order])
        for a, z in zip(begin.tolist(), end.tolist()):
            answer = told.get(int(which[order[a]]))
            if answer is not None:
                mine = order[a:z]
                k, hit = np.nonzero(answer[None] < ids[mine][:, None])
                gone.append((row[mine][k], hit + start[mine][k]))
        rows, starts = np.concatenate([g[0] for g in gone]), np.concatenate([g[1] for g in gone])
        order = np.argsort(rows, kind="stable")
        rows, starts = rows[order], starts[order] - batch.offsets[rows[order]]
        return np.split(starts, np.searchsorted(rows, np.arange(1, len(batch.ids))))


def spans(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal covered stretches, start and end (exclusive), of windows that begin at ``starts``."""
    if not len(starts):
        return []
    s = np.unique(starts)
    cut = np.flatnonzero(s[1:] > s[:-1] + width)
    return list(zip(s[np.concatenate(([0], cut + 1))].tolist(), (s[np.append(cut, len(s) - 1)] + width).tolist()))


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    return b"".join(text[a:z] for a, z in zip([0] + [z for _, z in gone], [a for a, _ in gone] + [len(text)]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_DDL = "array<struct<start:bigint,end:bigint>>"


def duplicate_spans(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) with n_bytes, spans (repeated bytes, maximal runs) and kept (the rest, binary).

    A byte is repeated if it lies in a WIDTH-byte string that begins in a document with a smaller doc_id too. Null text
    is empty. A row without doc_id counts as the largest id there is; rows that share an id repeat nothing of each other.
    Columns of ``docs`` named like a new one give way to it. Empty table: no rows.
    """

    def finished(text, starts):
        gone = spans(starts, WIDTH)
        return len(text), [{"start": a, "end": z} for a, z in gone], without(text, gone)

    extra = pa.schema([("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])
    return routed.repeats(docs, Bytes(), finished, extra, f"n_bytes long, spans {_SPANS_DDL}, kept binary", **options)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``duplicate_spans``."""
    out = duplicate_spans(docs.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents, same columns, without their repeated bytes; a character that a cut goes through goes too.

    Where there is a column n_chars, it is counted anew for texts that changed. Null texts stay null.
    """

    def finished(text, starts):
        gone = spans(starts, WIDTH)
        return bool(gone), without(text, gone).decode("utf-8", "ignore") if gone else None

    cut, left = spare_name(docs, "cut"), spare_name(docs, "left")
    extra = pa.schema([(cut, pa.bool_()), (left, pa.string())])
    out = routed.repeats(docs, Bytes(), finished, extra, f"`{cut}` boolean, `{left}` string")
    new = {"text": F.when(F.col(cut), F.col(left)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(cut), F.length(left)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
