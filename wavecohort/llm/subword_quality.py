"""Document quality by supervised subword embeddings.

A text is the bag of its words, their character n-grams and its word pairs, each hashed to a bucket that has a learned
vector. The vectors' mean goes through a softmax over the labels. Training is numpy stochastic gradient descent on a
bounded sample; as the mean and the output layer are linear, scoring adds each bucket's logits and never forms a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash, mixed, release, spare_name
from .spans import buffers, distinct, eights, hashes, steps, words

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: The bucket of all pairs of a word with itself.
REPEAT = 0
_WHITE = np.isin(np.arange(256), np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8))
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x dimensions
    out: np.ndarray  # labels x dimensions
    bias: np.ndarray  # labels

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each bucket (labels x BUCKETS), and the bias."""
        return (self.out @ self.vectors.T).astype(np.float64), self.bias.astype(np.float64)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_features(view: np.ndarray, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words and buckets, in pairs: of each word itself, and of the n-grams of its characters between marks of its two ends."""
    own, bucket = [np.arange(len(starts))], [_buckets(hashes(view, starts, lengths, 1))]
    sizes = lengths + 2
    to = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), np.uint8)
    owner = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(flat)) - to[owner]
    edge = (at == 0) | (at == sizes[owner] - 1)
    flat[edge] = np.where(at[edge] == 0, 2, 3)  # control characters: no letters of any text's words but odd ones
    flat[~edge] = buffer[(starts[owner] + at - 1)[~edge]]
    marked = eights(flat)
    begins = np.flatnonzero((flat & 0xC0) != 0x80)  # characters
    of = owner[begins]
    begins = np.append(begins, len(flat))
    for n in GRAMS:
        whole = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.empty(0, np.int64)
        own.append(of[whole])
        bucket.append(_buckets(hashes(marked, begins[whole], begins[whole + n] - begins[whole], 2)))
    return np.concatenate(own), np.concatenate(bucket)


def parsed(buffer: np.ndarray, offsets: np.ndarray):
    """Of some texts: each word's text and its place among the distinct words; pairs' texts and buckets; and ``word_features`` of the distinct words."""
    view = eights(buffer)
    starts, lengths, text = words(buffer, offsets, _WHITE)
    h = hashes(view, starts, lengths)
    first = distinct(view, starts, lengths, np.zeros(len(starts), np.int64), h)
    kinds, kind = np.unique(first, return_inverse=True)
    follows = np.flatnonzero(text[1:] == text[:-1])
    pair = np.where(kind[follows] == kind[follows + 1], REPEAT, _buckets(mixed(h[follows] * _PAIR + h[follows + 1])))
    return text, kind, text[follows], pair, len(kinds), *word_features(view, buffer, starts[kinds], lengths[kinds])


def logits(folded: np.ndarray, bias: np.ndarray, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logits of each text (rows) for each label; a text without words has the bias."""
    text, kind, pair_text, pair, n_kinds, own, bucket = parsed(buffer, offsets)
    n = len(offsets) - 1
    size = np.bincount(text, np.bincount(own, minlength=n_kinds)[kind], n) + np.bincount(pair_text, minlength=n)
    out = np.empty((n, len(bias)))
    for k, (row, b) in enumerate(zip(folded, bias)):
        value = np.bincount(own, row[bucket], n_kinds)
        out[:, k] = b + (np.bincount(text, value[kind], n) + np.bincount(pair_text, row[pair], n)) / np.maximum(size, 1)
    return out


def probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def bag(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their shares. Of more than ``most`` buckets that many are drawn by hash, and their shares add up to 1."""
    _, kind, _, pair, n_kinds, own, bucket = parsed(text, np.array([0, len(text)]))
    weight = np.bincount(bucket, np.bincount(kind, minlength=n_kinds)[own], BUCKETS) + np.bincount(pair, minlength=BUCKETS)
    held = np.flatnonzero(weight)
    if len(held) > most:
        held = np.sort(held[np.argsort(mixed(held.astype(np.uint64)), kind="stable")[:most]])
    return held, weight[held] / max(1, weight[held].sum())


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: int = 2, dimensions: int = 8, steps: int = 1000, batch: int = 32, rate: float = 8.0, seed: int = 13) -> Model:
    """Stochastic gradient descent on the cross-entropy, in batches drawn without replacement from all rows, and again when none is left; the rate falls to nothing."""
    rng = np.random.default_rng(seed)
    m = Model(rng.uniform(-1, 1, (BUCKETS, dimensions)).astype(np.float32) / dimensions, np.zeros((labels, dimensions), np.float32), np.zeros(labels, np.float32))
    share = np.bincount(y, minlength=labels) + 1.0
    m.bias[:] = np.log(share / share.sum())
    left = rng.permutation(len(bags))
    for done in range(steps):
        some, left = left[:batch], left[batch:]
        left = left if len(left) else rng.permutation(len(bags))
        ids, weight = (np.concatenate([bags[i][k] for i in some]) for k in range(2))
        row = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
        used, place = np.unique(ids, return_inverse=True)
        held = m.vectors[used]
        x = np.zeros((len(some), len(used)), np.float32)
        x[row, place] = weight
        mean = x @ held
        error = probabilities(mean @ m.out.T + m.bias)
        error[np.arange(len(some)), y[some]] -= 1
        step = rate * (1 - done / steps)
        back = x.T @ (error @ m.out)
        m.out -= (step / len(some) * (error.T @ mean)).astype(np.float32)
        m.bias -= (0.1 * step / len(some) * error.sum(0)).astype(np.float32)
        m.vectors[used] = held - (step * back).astype(np.float32)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, sample: int = 4000, most: int = 4096, **options) -> Model | None:
    """A model of labelled documents that are not held out, or None if there are none.

    At most ``sample`` (doc_id, text) are drawn, by hash, with at most ``most`` buckets each: 200 MB on the driver at the
    defaults, whatever the table's size. Of several labels of a doc_id the least counts; null ones don't. Null texts are
    empty. Rows that repeat are one.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    ids = marked.orderBy(id_hash("id", seed=13), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = texts.join(F.broadcast(ids), "id")
    drawn = rows.select("id", "h").distinct().orderBy(id_hash("id", "h", seed=14), "id", "h").limit(sample)
    rows = rows.join(F.broadcast(drawn), ["id", "h"]).select("id", "h", "y", F.col("text").cast("binary").alias("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = buffers(batch.column(3))
            found = [bag(buffer[a:z], most) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            held = [pa.array([np.asarray(b[k], t).tobytes() for b in found], pa.binary()) for k, t in ((0, "<u2"), (1, "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *held], names=["id", "h", "y", "ids", "weight"])
        release()

    bags = rows.mapInArrow(take, "id long, h long, y int, ids binary, weight binary").groupBy("id", "h").agg(F.first("y").alias("y"), F.first("ids").alias("ids"), F.first("weight").alias("weight"))
    found = bags.orderBy(id_hash("id", "h", seed=14), "id", "h").toArrow()
    if not found.num_rows:
        return None
    held = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(w, "<f4")) for i, w in zip(found["ids"].to_pylist(), found["weight"].to_pylist())]
    return train(held, found["y"].to_numpy().astype(np.int64), **options)


def scored(docs: DataFrame, model: Model | None, *keep: Column, score: str = "score") -> DataFrame:
    """The columns ``keep``, which must have names, and the probability of label 1 of each whole text.

    Null and empty texts, and texts without words, have what the bias says; without a model all have 0.5. A very long
    text is one step of a batch and is read whole. Empty table: no rows.
    """
    text = spare_name(docs, "text")
    rows = docs.select(*keep, F.col("text").cast("binary").alias(text))
    folded, bias = model.folded() if model else (np.zeros((2, BUCKETS)), np.zeros(2))
    n = len(keep)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = buffers(batch.column(n))
            found = [probabilities(logits(folded, bias, buffer[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]))[:, 1] for a, z in steps(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.concatenate(found) if found else [], pa.float64())], names=[*batch.schema.names[:n], score])
        release()

    told = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]] + [f"`{score}` double"])
    return rows.mapInArrow(judge, told)


def assessed(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1, label 1) and predicted (1 from ``threshold`` on), row by row; other columns are ignored."""
    out = scored(docs, model, F.col("doc_id"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
