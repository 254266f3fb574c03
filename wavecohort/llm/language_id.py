"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read as lanes of T consecutive bytes; both directions run over each lane, every byte position is labelled,
and a document's probabilities are the mean over all its positions. Training is numpy backpropagation through time
on a bounded sample; prediction runs on every byte of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash, release, spare_name, utf8

T = 128
UNKNOWN = "und"
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L): fractions, superscripts and other number signs are none."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass
class Direction:
    """Gate weights in rows z, r, n of H each; ``w`` has a column for each byte value."""

    w: np.ndarray  # 3H x 256
    u: np.ndarray  # 3H x H
    b: np.ndarray  # 3H: inside the reset gate, so that it is kept apart from w


@dataclass
class Model:
    labels: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # C x 2H
    bias: np.ndarray  # C


def _run(d: Direction, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States after each step, T x H x B, of lanes x (T x B); where mask is 0 the state stays 0.

    Gates are piecewise linear sigmoids, clip(v / 4 + 1/2, 0, 1), and the candidate is v / (1 + |v|): several times
    cheaper than exponentials, and as trainable here. The gates' scale and shift are folded into the weights.
    """
    hn = d.u.shape[1]
    scale = np.ones((3 * hn, 1), np.float32)
    scale[: 2 * hn] = 0.25
    w, u, b = d.w * scale, d.u * scale, d.b[:, None] * scale
    w[: 2 * hn] += 0.5
    h = np.zeros((hn, x.shape[1]), np.float32)
    states = np.empty((len(x), hn, x.shape[1]), np.float32)
    a = np.empty((3 * hn, x.shape[1]), np.float32)
    for t in range(len(x)):
        np.take(w, x[t], axis=1, out=a, mode="clip")
        c = u @ h
        c += b
        gates = a[: 2 * hn] + c[: 2 * hn]
        np.clip(gates, 0, 1, out=gates)
        z, r, cn = gates[:hn], gates[hn:], c[2 * hn :]
        n = r * cn
        n += a[2 * hn :]
        n /= np.abs(n) + 1
        new = h - n
        new *= z
        new += n
        new *= mask[t]
        if trace is not None:
            trace.append((h, z, r, n, cn))
        h = states[t] = new
    return states


def _back(d: Direction, x: np.ndarray, mask: np.ndarray, trace: list, given: np.ndarray) -> Direction:
    """Gradients through time; ``given`` is the loss gradient of each state."""
    hn = d.u.shape[1]
    gu, gb = np.zeros_like(d.u), np.zeros_like(d.b)
    inputs = np.empty((3 * hn, *x.shape), np.float32)
    dh = np.zeros_like(given[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, cn = trace[t]
        dh = (dh + given[t]) * mask[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = 0.25 * dh * (h - n) * ((z > 0) & (z < 1))
        dr = 0.25 * dn * cn * ((r > 0) & (r < 1))
        inner = np.concatenate((dz, dr, dn * r))
        inputs[: 2 * hn, t], inputs[2 * hn :, t] = inner[: 2 * hn], dn
        gu += inner @ h.T
        gb += inner.sum(1)
        dh = dh * z + d.u.T @ inner
    seen = x.ravel()
    gw = np.array([np.bincount(seen, row.ravel(), 256) for row in inputs], np.float32)
    return Direction(gw, gu, gb)


def lanes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (lanes x T, padded), lane lengths, and each lane's text."""
    counts = np.array([-(-len(t) // T) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    x = np.frombuffer(b"".join(t.ljust(-(-len(t) // T) * T, b"\0") for t in texts), np.uint8).reshape(-1, T)
    first = np.cumsum(counts) - counts
    at = np.arange(len(owner)) - first[owner]
    total = np.array([len(t) for t in texts], np.int64)
    return x, np.minimum(T, total[owner] - at * T), owner


def _columns(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-major bytes and mask."""
    return np.ascontiguousarray(x.T).astype(np.intp), (np.arange(T)[:, None] < length[None, :]).astype(np.float32)


def position_probabilities(m: Model, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Label probabilities of every position: T x C x B."""
    hn = m.forward.u.shape[1]
    f, b = _run(m.forward, x, mask), _run(m.backward, x[::-1], mask[::-1])[::-1]
    logits = m.out[:, :hn] @ f + m.out[:, hn:] @ b + m.bias[:, None]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(1, keepdims=True)
    return p


def predict(m: Model, texts: list[bytes], block: int = 2048) -> np.ndarray:
    """Mean label probabilities of each text over its positions; zeros for an empty text."""
    x, length, owner = lanes(texts)
    total = np.zeros((len(texts), len(m.labels)))
    for at in range(0, len(x), block):
        xs, mask = _columns(x[at : at + block], length[at : at + block])
        p = (position_probabilities(m, xs, mask) * mask[:, None, :]).sum(0)
        np.add.at(total, owner[at : at + block], p.T)
    return total / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


def train(texts: list[bytes], langs: list[str], hidden: int = 8, steps: int = 240, batch: int = 96, rate: float = 0.02, seed: int = 9) -> Model:
    """Fit on lanes of at most T bytes, classes equally often; Adam on the cross-entropy of every position."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)

    def direction() -> Direction:
        return Direction(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.1, (3 * hidden, 256)), (hidden**-0.5, (3 * hidden, hidden)), (0.0, (3 * hidden,)))))

    m = Model(labels, direction(), direction(), rng.normal(0, 0.1, (len(labels), 2 * hidden)).astype(np.float32), np.zeros(len(labels), np.float32))
    x, length, owner = lanes([t[:T] for t in texts])
    y = np.array([labels.index(v) for v in langs], np.int64)[owner]
    members = [np.flatnonzero(y == c) for c in range(len(labels))]
    params = [m.forward.w, m.forward.u, m.forward.b, m.backward.w, m.backward.u, m.backward.b, m.out, m.bias]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, max(1, batch // len(labels))) for c in members])
        xs, mask = _columns(x[pick], length[pick])
        tf, tb = [], []
        f = _run(m.forward, xs, mask, tf)
        b = _run(m.backward, xs[::-1], mask[::-1], tb)[::-1]
        both = np.concatenate((f, b), 1)
        logits = m.out @ both + m.bias[:, None]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        p[:, y[pick], np.arange(len(pick))] -= 1
        p *= mask[:, None, :] / mask.sum()
        given = m.out.T @ p
        gf = _back(m.forward, xs, mask, tf, given[:, :hidden])
        gb = _back(m.backward, xs[::-1], mask[::-1], tb, given[::-1, hidden:])
        grads = [gf.w, gf.u, gf.b, gb.w, gb.u, gb.b, np.einsum("tcb,thb->ch", p, both), p.sum((0, 2))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for q, g, (a, v) in zip(params, grads, moment):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            q -= (rate * min(1.0, 2 * (1 - step / (steps + 1)))) * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, per_lang: int = 600, **options) -> Model | None:
    """A model of the learnable documents: lang and text not null, id not held out. None if there are none.

    Every language is learned, from about 1.5 * ``per_lang`` documents chosen by id hash, and from three stretches of T
    characters of each, so that the sample has a bound for each language whatever the texts' lengths. Rows that repeat
    an id are chosen together.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row for each language
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.5 * per_lang / r["n"]))])
    draw = id_hash("doc_id", seed=9)
    chosen = rows.where((F.pmod(draw, F.lit(1_000_003)) / 1_000_003.0) < share[F.col("lang")])
    chosen = chosen.orderBy(draw, "doc_id", "lang").limit(3 * per_lang * len(counts))
    room = F.greatest(F.length("text") - T, F.lit(0))
    sample = chosen.select("lang", *[F.substring("text", (room * k / 2).cast("int") + 1, F.lit(T)).alias(f"part{k}") for k in range(3)]).toPandas()
    texts, langs = [], []
    for k in range(3):
        for t, lang in zip(utf8(sample[f"part{k}"]), sample["lang"]):
            if t:
                texts.append(t)
                langs.append(lang)
    return train(texts, langs, **options) if texts else None


def labelled(model: Model | None):
    """A scalar pandas UDF of text: struct of lang_pred and score (mean probability of that label, 0 to 1).

    Of labels of the same probability the first in alphabetical order is predicted.
    """

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pred, score = [], []
            for at in range(0, len(texts), 512):
                part = texts.iloc[at : at + 512]
                spoken = [isinstance(t, str) and has_letter(t) for t in part]
                p = predict(model, [t if s else b"" for t, s in zip(utf8(part), spoken)]) if model else None
                for i, s in enumerate(spoken):
                    pred.append(model.labels[int(p[i].argmax())] if s and model else UNKNOWN)
                    score.append(min(1.0, float(p[i].max())) if s and model else 0.0)
            yield pd.DataFrame({"lang_pred": pred, "score": score})
        release()

    return label


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text, row by row; other columns are ignored.

    Null text, or text without a letter: ``und`` with score 0; likewise everything if nothing could be learned.
    """
    rows = docs.select("doc_id", labelled(model)("text").alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model | None, margin: float = 1.2) -> DataFrame:
    """The documents, all columns unchanged, whose language is known: its score is ``margin`` times what chance gives each label, or 0.9.

    A column of any name stays. Nothing learned: no document is known, and none is kept.
    """
    least = min(0.9, margin / max(1, len(model.labels))) if model else 1.0
    told = spare_name(docs, "lang")
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns], labelled(model)("text").alias(told))
    return held.where((F.col(f"{told}.lang_pred") != UNKNOWN) & (F.col(f"{told}.score") >= least)).drop(told)
