"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: glibc's; other C libraries have none
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what setCheckpointDir was told.

    Where neither is set, a local master gets a new folder of its own; on a cluster that would be a folder which
    executors don't see, and it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs a read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def spare_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give memory that a finished task held back to the system: Python workers live on, and executors have many uses for it."""
    _words.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def id_hash(*columns: str | Column, seed: int = 0) -> Column:
    """A 63-bit hash of the columns, the same on every cluster and in every partitioning."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def utf8(texts: pd.Series) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [b"" if t is None or t is pd.NA or t != t else t.encode("utf-8", "surrogatepass") for t in texts]


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= _MULTIPLIER
    x ^= x >> np.uint64(32)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling: log2(width) passes over the array."""
    if len(x) < width:
        return x[:0]
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    if done < width:
        rest = width - done
        x = np.minimum(x[: len(x) - rest], x[rest:])
    return x


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of maximal runs of equal values."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + l) ...])`` without the loop."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
