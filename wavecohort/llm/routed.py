"""Exact repeats of fixed-length windows across a corpus, by anchors.

A window's anchor is the least hash of the grams inside it, so equal windows have equal anchors, and consecutive
windows mostly share one. The work is four exchanges of packed rows:

1. Documents are dealt to batches by id hash. A batch sends each bucket the distinct anchors it holds (40 bits each).
2. A bucket tells each batch which of them other batches hold too: a bit each.
3. A batch sends each bucket its distinct segments of shared anchors: the text of a run of windows of one anchor.
4. A bucket, which now has every window of its anchors, resolves them and tells each batch about its segments.

At the edges of a common line or passage each document makes a segment of its own, of one anchor. In step 1 a batch
tells how much text it has of an anchor, and the anchors that have more than ``split`` segments in all are split: in step
3 their windows go out one by one, each to a bucket by its own key of 128 bits, once a batch. Equal windows still meet,
and a bucket holds a row for each batch of such a window, whatever the number of documents.

Rows are packed per batch and bucket and equal segments of a batch are sent once, so that a passage held by a third of
all documents costs a row for each batch. Batches and buckets have a bounded size and their number grows with the
corpus. The exchange of documents by batch occurs three times in the plan and runs once.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_ranges, id_hash, release, runs

BATCH_BYTES = 6_000_000
#: Segments (of two widths) of one anchor above which its windows are dealt one by one.
SPLIT = 1000
_POSITION = "__{}"


class Unit:
    """What repeats are made of: bytes or words."""

    width: int
    #: How the weights of equal windows make one.
    merge: np.ufunc
    #: What a segment's weight is made of.
    numbers = 1

    def load(self, ids: list[int | None], texts: list[bytes]) -> Any:
        """A batch in memory, with ``start``, ``count``, ``row`` and ``anchor`` of each run of windows, ``alone`` (distinct anchors) and ``shared`` (those of them that repeat within the batch)."""
        raise NotImplementedError

    def segments(self, batch: Any, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Distinct segments of the runs whose anchors are in ``hot``: anchor, weight (``numbers`` of them), content."""
        raise NotImplementedError

    def resolve(self, anchor: np.ndarray, weight: np.ndarray, content: list[bytes]) -> list[np.ndarray | None]:
        """What each sender of a segment must know about it; None if nothing."""
        raise NotImplementedError

    def keys(self, batch: Any, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window that begins at ``start``."""
        raise NotImplementedError

    def weights(self, batch: Any, row: np.ndarray) -> np.ndarray:
        """What a window of each row weighs."""
        raise NotImplementedError

    def windows(self, batch: Any, heavy: np.ndarray) -> Windows:
        """The windows whose anchors are in ``heavy``."""
        pick = np.flatnonzero(np.isin(batch.anchor, heavy)) if len(heavy) else np.empty(0, np.int64)
        start, row = flat_ranges(batch.start[pick], batch.count[pick]), np.repeat(batch.row[pick], batch.count[pick])
        if not len(start):
            none = np.empty(0, np.int64)
            return Windows(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
        k1, k2 = self.keys(batch, start)
        order, begin, which = _equal(k1, k2)
        return Windows(start, row, which, k1[order[begin]], k2[order[begin]], self.merge.reduceat(self.weights(batch, row)[order], begin))

    def finish(self, batch: Any, hot: np.ndarray, told: dict[int, np.ndarray], single: Windows) -> list[np.ndarray]:
        """For each text the starts of its repeated windows; ``single`` has the weights over all batches."""
        raise NotImplementedError


@dataclass
class Windows:
    """Windows of split anchors, with the place of each among the distinct ones; keys and weights of those."""

    start: np.ndarray
    row: np.ndarray
    which: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    weight: np.ndarray


def _equal(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the two keys, where each group of equal keys begins in it, and the group of each."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket, with the buckets that occur and where each begins."""
    b = _bucket(anchor, buckets)
    order = np.argsort(b, kind="stable")
    found, start = np.unique(b[order], return_index=True)
    return order, found, np.append(start, len(b))


def _loaded(table: pa.Table, unit: Unit, at: tuple[int, int]) -> tuple[Any, np.ndarray]:
    """The batch with its rows ordered by id and text, so that each pass sees the same, and that order."""
    ids, texts = table.column(_POSITION.format(at[0])).to_pylist(), table.column(_POSITION.format(at[1])).to_pylist()
    texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], texts[i]) if ids[i] is not None else (False, 0, texts[i]))
    return unit.load([ids[i] for i in order], [texts[i] for i in order]), np.array(order, np.int64)


def _loads(batch: Any, width: int) -> np.ndarray:
    """How many segments of two widths the text of each of ``alone`` makes; 1 at least."""
    units = np.bincount(np.searchsorted(batch.alone, batch.anchor), batch.count + width - 1.0, len(batch.alone))
    return np.ceil(units / (2 * width)).astype(np.uint32)


def _hot(batch: Any, told: pa.Table | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that other batches hold, or that repeat in this one: those that stay whole, and the split ones; sorted."""
    order, found, start = _by_bucket(batch.alone, buckets)
    place = {int(b): k for k, b in enumerate(found)}
    hot, heavy = batch.shared.copy(), np.zeros(len(batch.alone), bool)
    for b, bits in zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist()) if told is not None else ():
        k = place[b]
        mine = order[start[k] : start[k + 1]]
        half = -(-len(mine) // 8)
        hot[mine] |= np.unpackbits(np.frombuffer(bits, np.uint8, half), count=len(mine)).astype(bool)
        if len(bits) > half:
            heavy[mine] = np.unpackbits(np.frombuffer(bits, np.uint8, offset=half), count=len(mine)).astype(bool)
    return batch.alone[hot & ~heavy], batch.alone[hot & heavy]


def repeats(docs: DataFrame, unit: Unit, finished, extra: pa.Schema, extra_ddl: str, batch_bytes: int = BATCH_BYTES, split: int = SPLIT) -> DataFrame:
    """All rows and columns of ``docs`` with further ones, which take the place of columns of the same names.

    ``finished(text, starts)`` makes a row's further values, those of ``extra``, from its text and its repeated windows.
    """
    names = docs.columns
    at = (names.index("doc_id"), names.index("text"))
    plain = docs.select(*[(F.col(f"`{c}`").cast("long") if i == at[0] else F.col(f"`{c}`")).alias(_POSITION.format(i)) for i, c in enumerate(names)])
    text = F.col(_POSITION.format(at[1]))
    total = plain.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-total // batch_bytes))
    key: Column = F.pmod(id_hash(F.coalesce(_POSITION.format(at[0]), F.xxhash64(text)), seed=10), F.lit(buckets))
    dealt = plain.withColumn("batch", key)

    def anchors(table: pa.Table) -> pa.Table:
        batch, _ = _loaded(table, unit, at)
        order, found, start = _by_bucket(batch.alone, buckets)
        low, load = batch.alone[order], _loads(batch, unit.width)[order]
        blobs = []
        for a, b in zip(start, start[1:]):
            many = np.flatnonzero(load[a:b] > 1).astype(np.uint32)  # the others have one segment
            blobs.append(np.int64(b - a).tobytes() + (low[a:b] & np.uint64(2**32 - 1)).astype(np.uint32).tobytes() + ((low[a:b] >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes() + many.tobytes() + load[a:b][many].tobytes())
        n = len(found)
        return pa.table({"bucket": pa.array(found, pa.int64()), "batch": pa.array([table.column("batch")[0].as_py()] * n, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        held, loads = [], []
        for b in blobs:
            n = int(np.frombuffer(b, np.int64, 1)[0])
            held.append(np.frombuffer(b, np.uint32, n, 8).astype(np.uint64) | (np.frombuffer(b, np.uint8, n, 8 + 4 * n).astype(np.uint64) << np.uint64(32)))
            many, load = np.frombuffer(b[8 + 5 * n :], np.uint32).reshape(2, -1)
            loads.append(np.ones(n, np.int64))
            loads[-1][many] = load
        values = np.concatenate(held)
        order = np.argsort(values)
        begin, end = runs(values[order])
        same, heavy = np.empty(len(values), bool), np.empty(len(values), bool)
        same[order] = np.repeat(end - begin > 1, end - begin)
        heavy[order] = np.repeat(np.add.reduceat(np.concatenate(loads)[order], begin) > split, end - begin)
        cut = np.cumsum([len(h) for h in held])[:-1]
        parts = list(zip(np.split(same, cut), np.split(heavy, cut)))
        bits = [np.packbits(x).tobytes() + (np.packbits(y).tobytes() if y.any() else b"") for x, y in parts]
        keep = [bool(x.any() or y.any()) for x, y in parts]
        out = pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})
        return out.filter(pa.array(keep))

    def segments(docs: pa.Table, told: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()), "blob": pa.array([], pa.binary()), "single": pa.array([], pa.bool_())})
        if not docs.num_rows:
            return empty
        batch, _ = _loaded(docs, unit, at)
        hot, heavy = _hot(batch, told, buckets)
        anchor, weight, content = unit.segments(batch, hot)
        order, found, start = _by_bucket(anchor, buckets)
        pack = zstandard.ZstdCompressor(level=3)
        blobs = []
        for a, b in zip(start, start[1:]):
            mine = order[a:b]
            size = np.array([len(content[i]) for i in mine], np.int64)
            blobs.append(pack.compress(np.int64(b - a).tobytes() + anchor[mine].tobytes() + weight[mine].tobytes() + size.tobytes() + b"".join(content[i] for i in mine)))
        w = unit.windows(batch, heavy)
        order, more, start = _by_bucket(w.k1, buckets)
        for a, b in zip(start, start[1:]):
            mine = order[a:b]
            blobs.append(pack.compress(w.k1[mine].tobytes() + w.k2[mine].tobytes() + w.weight[mine].tobytes()))
        single = [False] * len(found) + [True] * len(more)
        return pa.table({"bucket": pa.array([*found.tolist(), *more.tolist()], pa.int64()), "batch": pa.array([docs.column("batch")[0].as_py()] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary()), "single": pa.array(single, pa.bool_())})

    def resolve(table: pa.Table) -> pa.Table:
        one = table.column("single").to_pylist()
        table = table.drop_columns(["single"])
        out = [resolved(t) for resolved, t in ((whole, table.filter(pa.array([not x for x in one]))), (windows, table.filter(pa.array(one)))) if t.num_rows]
        release()
        return pa.concat_tables(out)

    def answered(table: pa.Table, blobs: list[bytes | None], single: bool) -> pa.Table:
        out = pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array([None] * len(blobs), pa.binary()), "blob": pa.array(blobs, pa.binary()), "single": pa.array([single] * len(blobs), pa.bool_())})
        return out.filter(pa.array([b is not None for b in blobs]))

    def windows(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint64).reshape(3, -1) for b in table.column("blob").to_pylist()]
        k1, k2, weight = np.concatenate(sent, 1)
        order, begin, which = _equal(k1, k2)
        weight = weight.view(np.int64)
        total = unit.merge.reduceat(weight[order], begin)[which]
        pack, at_row, blobs = zstandard.ZstdCompressor(level=3), 0, []
        for s in sent:
            mine = total[at_row : at_row + s.shape[1]]
            index = np.flatnonzero(mine != weight[at_row : at_row + s.shape[1]])
            at_row += s.shape[1]
            blobs.append(pack.compress(index.tobytes() + mine[index].tobytes()) if len(index) else None)
        return answered(table, blobs, True)

    def whole(table: pa.Table) -> pa.Table:
        anchor, weight, content, count = [], [], [], []
        for blob in table.column("blob").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            count.append(n)
            anchor.append(np.frombuffer(raw, np.uint64, n, 8))
            held = np.frombuffer(raw, np.int64, n * unit.numbers, 8 + 8 * n)
            weight.append(held if unit.numbers == 1 else held.reshape(n, unit.numbers))
            first = 8 + 8 * n * (2 + unit.numbers)
            ends = first + np.cumsum(np.frombuffer(raw, np.int64, n, first - 8 * n))
            content += [raw[a:b] for a, b in zip([first, *ends.tolist()], ends.tolist())]
        answers = unit.resolve(np.concatenate(anchor), np.concatenate(weight), content)
        pack, at_row, blobs = zstandard.ZstdCompressor(level=3), 0, []
        for n in count:
            mine = answers[at_row : at_row + n]
            at_row += n
            index = np.array([i for i, x in enumerate(mine) if x is not None], np.int64)
            size = np.array([len(mine[i]) for i in index], np.int64)
            blobs.append(pack.compress(np.int64(len(index)).tobytes() + index.tobytes() + size.tobytes() + b"".join(mine[i].astype(np.int64).tobytes() for i in index)) if len(index) else None)
        return answered(table, blobs, False)

    def finish(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.schema([f for f in docs.schema if f.name != "batch"] + list(extra)).empty_table()
        batch, rows = _loaded(docs, unit, at)
        is_bits = pc.is_valid(told.column("bits"))
        hot, heavy = _hot(batch, told.filter(is_bits), buckets)
        answers = told.filter(pc.and_(pc.invert(is_bits), pc.invert(told.column("single"))))
        anchor, _, _ = unit.segments(batch, hot)
        order, found, start = _by_bucket(anchor, buckets)
        place = {int(b): k for k, b in enumerate(found)}
        known: dict[int, np.ndarray] = {}
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()):
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            index, size = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
            ends = np.cumsum(size)
            values = np.frombuffer(raw, np.int64, int(ends[-1]), 8 + 16 * n)
            mine = order[start[place[b]] :]
            for i, a, z in zip(index.tolist(), (ends - size).tolist(), ends.tolist()):
                known[int(mine[i])] = values[a:z]
        w = unit.windows(batch, heavy)
        order, found, start = _by_bucket(w.k1, buckets)
        place = {int(b): k for k, b in enumerate(found)}
        answers = told.filter(told.column("single"))
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()):
            index, total = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(2, -1)
            w.weight[order[start[place[b]] :][index]] = total
        starts = unit.finish(batch, hot, known, w)
        texts = docs.column(_POSITION.format(at[1])).to_pylist()
        made: list = [None] * len(texts)
        for i, s in zip(rows.tolist(), starts):
            made[i] = finished(b"" if texts[i] is None else texts[i].encode("utf-8", "surrogatepass"), s)
        out = docs.drop_columns(["batch"])
        for k, field in enumerate(extra):
            out = out.append_column(field, pa.array([m[k] for m in made], field.type))
        release()
        return out

    kinds = ", ".join(f"`{_POSITION.format(i)}` {t}" for i, t in enumerate(t for _, t in plain.dtypes))
    sent = dealt.groupBy("batch").applyInArrow(anchors, "bucket long, batch long, blob binary")
    bits = sent.groupBy("bucket").applyInArrow(shared, "batch long, bucket long, bits binary")
    parts = dealt.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(segments, "bucket long, batch long, blob binary, single boolean")
    answers = parts.groupBy("bucket").applyInArrow(resolve, "batch long, bucket long, bits binary, blob binary, single boolean")
    told = bits.select("batch", "bucket", "bits", F.lit(None).cast("binary").alias("blob"), F.lit(False).alias("single")).unionByName(answers)
    out = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(finish, f"{kinds}, {extra_ddl}")
    made = {x.lower() for x in extra.names}
    return out.select(*[F.col(_POSITION.format(i)).alias(c) for i, c in enumerate(names) if c.lower() not in made], *extra.names)
