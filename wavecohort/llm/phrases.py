"""Phrases: word sequences that occur more often than their parts let expect, counted exactly over a whole corpus.

Counting takes three passes. Words are counted as they are, and each (language, word) gets a 64-bit id, with another seed
if two share one. Pairs of frequent words, then triples and fours all of whose pairs are frequent, are counted in quotient
filters: each task packs what it has seen, cut into ranges of the permuted key, and a group merges one range. What is
frequent travels as a bit map of bounded size: a false bit costs a count, and nothing that is frequent is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quotient_filter as Q
from .common import flat_ranges, id_hash, mixed, release, written
from .spans import buffers, distinct, eights, hashes, steps, words

#: Fixed values of the contract.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
LONGEST, MIN_COUNT, SCALE, PART_OF_PERCENT, TOP = 4, 30, 2_000_000, 80, 2000
UNKNOWN = "und"

#: A bit map has 32 bits for each frequent entry, but no more than 2**27 (16 MB).
MAP_BITS = 1 << 27
#: Entries that a task holds before it packs a filter, and words of the corpus for each range of keys that a group merges.
HELD, RANGE = 1 << 19, 1 << 21
SALTS = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK, _BLANK = (np.isin(np.arange(256), np.frombuffer(b, np.uint8)) for b in (BREAKS, BLANKS))
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _texts(docs: DataFrame) -> DataFrame:
    """lang and UTF-8 bytes of the texts that there are."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")


def _word_spans(batch: pa.RecordBatch, seed: int):
    """Steps of a batch: bytes in lower case, its view, words' starts and lengths, ids, languages' numbers, and whether the next word follows in the same piece; and the languages."""
    langs = batch.column(0).dictionary_encode()
    names, of = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held, at = buffers(names)
    seeds = hashes(eights(held), at[:-1], np.diff(at), seed)
    buffer, offsets = buffers(batch.column(1))
    for a, z in steps(offsets, 1 << 22):
        part, cut = _LOWER[buffer[offsets[a] : offsets[z]]], offsets[a : z + 1] - offsets[a]
        view = eights(part)
        starts, lengths, text = words(part, cut, _BREAK | _BLANK)
        lang = of[a:z][text]
        piece = np.cumsum(_BREAK[part], dtype=np.int32)[starts]
        follows = np.append((piece[1:] == piece[:-1]) & (text[1:] == text[:-1]), False)[: len(starts)]
        yield part, view, starts, lengths, hashes(view, starts, lengths, seeds[lang]), lang, follows, names


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, n: all words. A task counts what a step holds, Spark adds up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, view, starts, lengths, ids, lang, _, names in _word_spans(batch, seed):
                kinds, times = np.unique(distinct(view, starts, lengths, lang, ids), return_counts=True)
                size = lengths[kinds]
                told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(kinds), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(part[flat_ranges(starts[kinds], size)])])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[kinds])).cast(pa.string()), told.cast(pa.binary()), pa.array(ids[kinds].view(np.int64)), pa.array(times)], names=["lang", "word", "id", "n"])
        release()

    rows = _texts(docs).mapInArrow(count, "lang string, word binary, id long, n long")
    return rows.groupBy("lang", F.col("word").cast("string").alias("word"), "id").agg(F.sum("n").alias("n"))


def numbered_words(docs: DataFrame) -> DataFrame:
    """``word_counts`` as a table in which every (lang, word) has an id of its own."""
    for seed in range(12, 112):
        found = written(word_counts(docs, seed), "words")
        if found.groupBy("id").count().where("count > 1").isEmpty():
            return found.withColumn("seed", F.lit(seed))
    raise ValueError("no seed tells all words apart")


def _bit_map(marks: DataFrame) -> np.ndarray:
    """The bits of the column ``mark`` (64-bit hashes), bounded by MAP_BITS whatever the table's size."""
    bits = 1 << 16
    entries = marks.count()
    while bits < MAP_BITS and bits < 32 * entries:
        bits *= 2
    place = F.col("mark").bitwiseAND(F.lit(bits - 1))
    cells = marks.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((mark & {bits - 1}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.view(np.uint8)


def _on(bits: np.ndarray, mark: np.ndarray) -> np.ndarray:
    at = (mark & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _pair_mark(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _PAIR + b)


def frequent_grams(docs: DataFrame, seed: int, maps: list, lengths: tuple[int, ...], ranges: int, least: int) -> DataFrame:
    """ids, f and mark (of a pair) of n-grams of these lengths with f >= least. ``maps``: broadcast bit maps of frequent words and, if there is a second, pairs."""
    bits = ranges.bit_length() - 1

    def pack(held: dict[int, list]) -> Iterator[pd.DataFrame]:
        for n, parts in held.items():
            if parts:
                keys, counts = Q.gathered(np.concatenate([k for k, _ in parts], 1), np.concatenate([c for _, c in parts]))
                part = (keys[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(keys.shape[1], np.int64)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                rows = [(n, int(part[a]), Q.packed(keys[:, a:z], counts[a:z], bits)) for a, z in zip(cut, np.append(cut[1:], len(part)))]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["n", "part", "filter"]).astype({"n": "int32"}), preserve_index=False)
                parts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, *double = [m.value for m in maps]
        held: dict[int, list] = {n: [] for n in lengths}
        for batch in batches:
            for _, _, _, _, ids, _, follows, _ in _word_spans(batch, seed):
                known = _on(single, ids)
                pair = np.flatnonzero(follows[:-1] & known[:-1] & known[1:])
                if double:
                    pair = pair[_on(double[0], _pair_mark(ids[pair], ids[pair + 1]))]
                is_pair = np.zeros(len(ids) + LONGEST, bool)
                is_pair[pair] = True
                for n in lengths:
                    at = pair
                    for k in range(1, n - 1):
                        at = at[is_pair[at + k]]
                    if len(at):
                        held[n].append(Q.gathered(Q.permuted(np.stack([ids[at + k] for k in range(n)])), np.ones(len(at), np.int64)))
                if sum(k.shape[1] for parts in held.values() for k, _ in parts) > HELD:
                    for n, parts in held.items():
                        parts[:] = [Q.gathered(np.concatenate([k for k, _ in parts], 1), np.concatenate([c for _, c in parts]))] if parts else []
                    if sum(k.shape[1] for parts in held.values() for k, _ in parts) > HELD // 2:
                        yield from pack(held)
        yield from pack(held)
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [f for batch in batches for f in batch.column("filter").to_pylist()]
        keys, counts = Q.merged(filters)
        often = counts >= least
        grams, counts = Q.restored(keys[:, often]), counts[often]
        n = len(grams)
        mark = _pair_mark(grams[0], grams[1]) if n == 2 else np.zeros(len(counts), np.uint64)
        ids = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(counts) + 1, n, dtype=np.int32)), pa.array(grams.T.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(mark.view(np.int64))], names=["ids", "f", "mark"])
        release()

    filters = _texts(docs).mapInArrow(count, "n int, part long, filter binary")
    return filters.groupBy("n", "part").applyInArrow(merge, "ids array<long>, f long, mark long")


def counted_phrases(docs: DataFrame, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """All words (lang, word, id, n), and all phrases of 2 to LONGEST words with f >= ``least`` (ids, f), as tables."""
    spark = docs.sparkSession
    every = numbered_words(docs)
    seed, total = every.agg(F.max("seed"), F.sum("n")).first() or (None, None)
    if total is None:
        return every, spark.createDataFrame([], "ids array<long>, f long")
    ranges = 1
    while ranges * RANGE < total:
        ranges *= 2
    maps = [spark.sparkContext.broadcast(_bit_map(every.where(F.col("n") >= least).select(F.col("id").alias("mark"))))]
    pairs = written(frequent_grams(docs, seed, maps, (2,), ranges, least), "pairs")
    maps.append(spark.sparkContext.broadcast(_bit_map(pairs.select("mark"))))
    longer = written(frequent_grams(docs, seed, maps, tuple(range(3, LONGEST + 1)), ranges, least), "longer")
    return every, pairs.select("ids", "f").unionByName(longer.select("ids", "f"))


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored_phrases(every: DataFrame, found: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """lang, ids, a, l, r, score of the phrases ``found`` at their lowest cut; those inside a longer one that is as common are left out."""
    size = F.size("ids")
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), F.slice("ids", 1, k).alias("head"), F.slice("ids", k + 1, size - k).alias("tail")))
    # parts of one word may be common to many phrases: they are met under SALTS keys
    salt = F.pmod(id_hash("ids", seed=121), F.lit(SALTS)).cast("int")
    of = lambda part: F.when(F.size(part) == 1, salt).otherwise(0)
    one = every.where(F.col("n") >= least).select(F.array("id").alias("part"), F.col("n").alias("count"), "lang", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    parts = one.unionByName(found.select(F.col("ids").alias("part"), F.col("f").alias("count"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("salt")))
    rows = found.select("ids", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("ids", "a", "c.k", "c.head", "c.tail")
    rows = rows.withColumn("salt", of("head")).join(parts.select(F.col("part").alias("head"), "salt", F.col("count").alias("l"), "lang"), ["head", "salt"])
    rows = rows.withColumn("salt", of("tail")).join(parts.select(F.col("part").alias("tail"), "salt", F.col("count").alias("r")), ["tail", "salt"])
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")  # ties to the smallest k
    rows = rows.withColumn("score", score).groupBy("ids", "a").agg(best, F.max("lang").alias("lang"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("ids", i, n))))
    cover = found.where(F.size("ids") > 2).select("f", F.explode(inside).alias("ids")).groupBy("ids").agg(F.max("f").alias("longer"))
    rows = rows.join(cover, "ids", "left")
    covered = F.coalesce(F.lit(100).cast("decimal(3,0)") * _wide("longer") >= F.lit(PART_OF_PERCENT).cast("decimal(3,0)") * _wide("a"), F.lit(False))
    return rows.where(~covered).select("lang", "ids", "a", "best.l", "best.r", "best.score")


def top_phrases(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Null texts hold nothing, null languages are ``und``. Ties go by a, then by the phrase's bytes. Rows that repeat count
    as often as they are there; a row's id and other columns are ignored. A very long text is one step of a batch and is
    read whole. Empty table: no rows.
    """
    every, found = counted_phrases(docs, least)
    scored = scored_phrases(every, found, least).withColumn("salt", F.pmod(id_hash("ids", seed=122), F.lit(64)))
    # no task sorts all of a language: first the best of each of its parts, with ties, then of those in all
    order = [F.desc("score"), F.desc("a")]
    some = scored.withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top).drop("place")
    some = written(some, "phrases")
    told = some.select("ids", F.posexplode("ids").alias("at", "id")).join(every.select("id", "word"), "id")
    told = told.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    some = some.join(told, "ids")
    order.append(F.asc("phrase"))
    for by in (("lang", "salt"), ("lang",)):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return some.join(every.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
