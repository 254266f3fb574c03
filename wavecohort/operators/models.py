"""Model-facing operators: a linear probe on embeddings, and batch scoring with a validity mask."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Probe:
    """A logistic model on raw vectors (standardising is folded in), and how its fit ended."""

    weights: np.ndarray
    intercept: float
    rounds: int
    gradient: float


def _sums(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part(x, y)``, a flat vector of a length that only the dimension decides.

    A task gives one row for each entry of its sum; Spark adds them by entry, so that the driver gets one vector.
    """

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                s = part(np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(float))
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    found = rows.mapInPandas(summed, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["k"]] = r["v"]
    return out


def newton_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, class_weight: np.ndarray) -> np.ndarray:
    """Loss, gradient and the Gram matrix of a batch, flat; the last entry of ``beta`` is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    z = a @ beta
    s = class_weight[y.astype(int)]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    loss = float((s * (np.logaddexp(0, z) - y * z)).sum())
    gram = a.T @ (a * (s * p * (1 - p))[:, None])
    return np.concatenate([[loss], a.T @ (s * (p - y)), gram.ravel()])


def fit_probe(df: DataFrame, embedding: str, label: str, c: float = 1.0, most_rounds: int = 50, tolerance: float = 1e-9) -> Probe:
    """A class-balanced logistic model with an L2 penalty (1 / c, none on the intercept) on standardised vectors.

    Newton's method: each round is one pass that adds up gradient and Gram matrix, of a size that only the dimension
    decides; a step that doesn't lessen the loss is halved. Rows teach nothing if their label isn't 0 or 1, or their vector
    is null, of another length than the longest, or holds a null or non-finite number. One class alone is an error, as is an
    empty table. A column that never varies gets no weight.
    """
    held = df.where(F.col(label).cast("double").isin(0.0, 1.0)).select(F.col(embedding).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    held = held.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    size = held.agg(F.max(F.size("x"))).first()[0]
    if not size or size < 0:
        raise ValueError("no sound vectors to learn from")
    rows = held.where(F.size("x") == size)

    first = _sums(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
    n, positives, mean = first[0], first[1], first[2:] / first[0]
    if positives in (0, n):
        raise ValueError("one class only")
    std = np.sqrt(_sums(rows, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n)
    scale = np.where(std > 0, std, np.inf)
    class_weight = np.array([n / (2 * (n - positives)), n / (2 * positives)])
    penalty = np.append(np.full(size, 1 / c), 0.0)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = _sums(rows, lambda x, y: newton_sums((x - mean) / scale, y, beta, class_weight))
        return s[0] + (penalty * beta**2).sum() / 2, s[1 : size + 2] + penalty * beta, s[size + 2 :].reshape(size + 1, size + 1) + np.diag(penalty)

    beta = np.zeros(size + 1)
    loss, gradient, gram = at(beta)
    rounds = 0
    while rounds < most_rounds and np.abs(gradient).max() > tolerance * n:
        step, share = np.linalg.solve(gram, gradient), 1.0
        new = at(beta - step)
        while new[0] > loss + 1e-9 * abs(loss) and share > 1e-6:
            share /= 2
            new = at(beta - share * step)
        beta, (loss, gradient, gram), rounds = beta - share * step, new, rounds + 1
    weights = beta[:-1] / scale
    return Probe(weights, float(beta[-1] - (weights * mean).sum()), rounds, float(np.abs(gradient).max() / n))


def probe_scores(df: DataFrame, probe: Probe, embedding: str) -> DataFrame:
    """Adds prob, the positive class's probability; null without a vector of the model's length."""
    w = F.array(*[F.lit(float(v)) for v in probe.weights])
    product = F.aggregate(F.zip_with(F.col(embedding).cast("array<double>"), w, lambda x, v: x * v), F.lit(probe.intercept), lambda a, x: a + x)
    return df.withColumn("prob", F.when(F.size(embedding) == len(probe.weights), 1 / (1 + F.exp(-product))))


def probe_cutoff(df: DataFrame, probe: Probe, embedding: str, label: str) -> float:
    """The cutoff of the greatest F1 on the rows the probe was fitted on; the default where none has enough precision."""
    from .thresholds import best_f1_observed

    scored = probe_scores(df, probe, embedding).where(F.col("prob").isNotNull() & F.col(label).isNotNull())
    return best_f1_observed(scored.select(F.lit("all").alias("g"), F.col(label).cast("int").alias("y"), "prob"), ["g"]).first()["cutoff"]


def mean_predictor() -> Callable[[np.ndarray], np.ndarray]:
    """A predictor that a worker makes once: the sigmoid of a vector's mean."""

    def predict(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-x.mean(axis=1)))

    return predict


def batch_scores(df: DataFrame, vector: str, size: int, make_predictor: Callable, batch: int = 1024) -> DataFrame:
    """Adds valid and prob; rows without a sound vector are scored as zeros and get a null prob."""
    sound: Column = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    score = predict_batch_udf(make_predictor, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[size]])
    held = df.withColumns({"valid": sound, "__x": F.when(sound, F.col(vector).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), size))})
    return held.withColumn("__p", score("__x")).withColumn("prob", F.when(F.col("valid"), F.col("__p"))).drop("__x", "__p")
