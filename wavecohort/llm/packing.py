"""Packing: first-fit decreasing by a tournament tree of bin capacities, in randomised groups of documents.

Each document is tokenised, given an end id and cut at multiples of the bin size; the pieces of a group, longest first,
go to the leftmost bin with room. Groups hold a bounded share of the documents, so that a group is one task's work at
any size of the corpus, and its bins do not depend on other groups.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_ranges, id_hash, release

END_ID = 1
#: Fixed value: how this byte-level vocabulary cuts text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(r"\s\s| $|^ ")


class CachedTokenizer:
    """Ids as packed unsigned 32-bit words, remembered per chunk between single spaces.

    A byte-level BPE first cuts a text by a pattern, and a lone space between two other characters always begins a
    token there, so that chunks cut before such spaces have ids of their own. Texts with other white space around a
    space are encoded whole. The cache holds about ``most`` chunks of each of two generations, so that rare chunks go and are encoded anew.
    """

    def __init__(self, path: str, ranks: str | None = None, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path).encode_batch_fast
        self._joined = self._joined_encoder(ranks) if ranks else None
        self._most = most
        # two generations: when the younger is full it becomes the older, whose entries come back when they are used
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @staticmethod
    def _joined_encoder(ranks: str):
        """The same ids by a faster library, for many chunks at once: they are joined, and cut again by their bytes."""
        import base64

        import tiktoken

        with open(ranks, "rb") as file:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = np.zeros(max(known.values()) + 1, np.int64)
        size[list(known.values())] = [len(b) for b in known]
        encode = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary

        def packed(chunks: list[str]) -> list[bytes]:
            ids = np.array(encode("".join(chunks)), "<u4")
            stops = np.cumsum([len(c.encode()) for c in chunks])
            ends = np.searchsorted(np.cumsum(size[ids]), stops) + 1
            raw = ids.tobytes()
            return [raw[4 * a : 4 * z] for a, z in zip([0, *ends.tolist()], ends.tolist())]

        return packed

    def _fresh(self, chunks: list[str]) -> list[tuple[str, bytes]]:
        """Ids of new chunks. Chunks of a space and printable characters keep their cuts when they are joined."""
        plain = [c for c in chunks if self._joined and c[:1] == " " and len(c) > 1 and c.replace("\n", "").isprintable()]
        rest = list(set(chunks).difference(plain)) if len(plain) < len(chunks) else []
        return [*(zip(plain, self._joined(plain)) if plain else ()), *zip(rest, self._packed(rest))]

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._encode(texts, add_special_tokens=False)]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self._known) > self._most:
            self._known, self._older = {}, self._known
        known = self._known
        found = list(map(known.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in missing:
            ids = self._older.get(chunks[i])
            if ids is None:
                fresh.append(chunks[i])
            else:
                known[chunks[i]] = ids
        if fresh:
            known.update(self._fresh(fresh))
        for i in missing:
            found[i] = known[chunks[i]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        cut = [k for k, t in enumerate(texts) if "<|" not in t and not _SPACES.search(t)]
        if cut:
            # Arrow cuts the texts and numbers the words; a text's first word has no space before it
            lists = pc.split_pattern(pa.array([texts[k] for k in cut], pa.large_string()), " ")
            count = pc.list_value_length(lists).to_numpy().astype(np.int64)
            coded = pc.list_flatten(lists).dictionary_encode()
            words = coded.dictionary.to_pylist()
            code = coded.indices.to_numpy().astype(np.int64)
            opening = np.cumsum(count) - count
            firsts = np.unique(code[opening])
            code[opening] = len(words) + np.searchsorted(firsts, code[opening])
            ids = self._ids([" " + w for w in words] + [words[k] for k in firsts.tolist()])
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), "<u4")
            raw = flat[flat_ranges((np.cumsum(size) - size)[code], size[code])].tobytes()
            ends = 4 * np.cumsum(np.add.reduceat(size[code], opening))
            for k, a, z in zip(cut, [0, *ends.tolist()], ends.tolist()):
                out[k] = raw[a:z]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._packed([texts[k] for k in rest])):
            out[k] = x
        return out

    def forget(self) -> None:
        self._known, self._older = {}, {}


_tokenizers: dict[tuple[str, str | None], CachedTokenizer] = {}


def tokenizer(path: str, ranks: str | None = None) -> CachedTokenizer:
    if (path, ranks) not in _tokenizers:
        _tokenizers[path, ranks] = CachedTokenizer(path, ranks)
    return _tokenizers[path, ranks]


def pieces(docs: DataFrame, path: str, size: int = 2048, keep_ids: bool = False, ranks: str | None = None) -> DataFrame:
    """Pieces of at most ``size`` ids of every document: doc_id, start, length, ids_crc32, doc_tokens[, ids].

    path: the tokenizer; ranks: the same vocabulary as ranks, if there is such a file. A null or empty text is the end id
    alone. Repeated rows are documents of their own.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path, ranks).encode
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                rows: list[tuple] = []
                for doc, ids in zip(part["doc_id"], encode(["" if t is None or t != t else t for t in part["text"]])):
                    ids += end
                    n = len(ids) // 4
                    for k in range(0, n, size):
                        piece = ids[4 * k : 4 * (k + size)]
                        rows.append((doc, k, len(piece) // 4, zlib.crc32(piece), n) + ((np.frombuffer(piece, "<u4").astype(np.int64).tolist(),) if keep_ids else ()))
                out = pd.DataFrame(rows, columns=names)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
        tokenizer(path, ranks).forget()
        release()

    kinds = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long"} | ({"ids": "array<long>"} if keep_ids else {})
    names = list(kinds)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` fall and are 1 to ``size``.

    The tree's leaves are the bins' free capacities and each inner node holds its children's maximum, so the leftmost
    bin with room is found in one descent.
    """
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = int(np.searchsorted(-lengths, -size, side="right"))  # these fill a bin each
    where[:full] = np.arange(full)
    leaves = 1
    while leaves < n - full:
        leaves *= 2
    tree = [size] * (2 * leaves)
    for i in range(full, n):
        need = int(lengths[i])
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        where[i], offset[i] = full + at - leaves, size - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
    return where, offset


def packed(docs: DataFrame, path: str, size: int = 2048, group_docs: int = 4096, keep_ids: bool = False, ranks: str | None = None) -> DataFrame:
    """Pieces with the sequence_id and offset they are packed at.

    Groups are dealt by a hash of doc_id, about ``group_docs`` documents each; a sequence_id is the group number times
    2**32 plus the bin. Ties of length are ordered by doc_id (null first), start and checksum. Empty table: no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, path, size, keep_ids, ranks)
    cut = cut.withColumn("__group", F.pmod(id_hash("doc_id", F.when(F.col("doc_id").isNull(), F.col("ids_crc32")), seed=7), F.lit(groups)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        where, offset = first_fit_decreasing(part["length"].to_numpy(np.int64), size)
        part["sequence_id"], part["offset"] = part["__group"].to_numpy(np.int64) * 2**32 + where, offset
        return part.drop(columns="__group")

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep_ids else "") + ", sequence_id long, offset long"
    return cut.groupBy("__group").applyInPandas(pack, kinds)
