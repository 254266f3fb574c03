"""Quality rules: text statistics and a learned decision list over them.

Sequential covering learns the list from labelled rows: a rule is a conjunction of thresholds, grown condition by
condition on two thirds of the uncovered rows and pruned from its end on the other third; covered rows leave, and the
next rule is learned on the rest. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_hash, release, spare_name, utf8

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

_SYMBOLS, _WHITE = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (SYMBOLS, WHITE))
_REST = (np.arange(256) & 0xC0) == 0x80  # UTF-8 bytes that do not begin a code point
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_HAS_WORD = re.compile(rb"[^\x20\x09-\x0d]")


def repeated_window_words(words: list, width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words that begin at two places of the text or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # exact: each step renumbers the distinct (window, next word) pairs
    key = codes[:n]
    for k in range(1, width):
        _, key = np.unique(key * len(ids) + codes[k : k + n], return_inverse=True)
    found = np.bincount(key)[key] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += found
    edges[width : width + n] -= found
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if _HAS_WORD.search(x)]
    return (
        len(words),
        int(chars.sum() - chars[_REST].sum() - chars[_WHITE].sum()),
        int(chars[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        int(chars[65:91].sum()),
        int(chars[_MARKS].sum()),
        len(lines),
    )


@F.pandas_udf(STATS_TYPE)
def text_stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """COUNTS of each whole text; null and empty texts count 0 everywhere."""
    for texts in batches:
        found = np.array([text_counts(t) for t in utf8(texts)], np.int64).reshape(-1, len(COUNTS))
        yield pd.DataFrame(found, columns=list(COUNTS))
    release()


#: What rules may test: counts, and ratios that do not depend on a text's length. Each is never null.
FEATURES = {
    "n_words": "n_words",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def features(stats: str) -> list[Column]:
    """FEATURES as doubles of a struct column of counts."""
    def of(expression: str) -> str:
        return re.sub(r"\b(n_\w+|word_chars)\b", lambda m: f"{stats}.{m[0]}", expression)

    return [F.expr(of(e)).cast("double").alias(name) for name, e in FEATURES.items()]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that some rule covers is rejected, any other is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x) for c in rule])
        return out

    def expression(self, feature: dict[str, Column]) -> Column:
        """The list as one conditional expression: true keeps."""
        out = None
        for rule in self.rules:
            met = F.lit(True)
            for c in rule:
                met = met & ((feature[c.feature] >= c.threshold) if c.above else (feature[c.feature] < c.threshold))
            out = F.when(met, False) if out is None else out.when(met, False)
        return F.lit(True) if out is None else out.otherwise(True)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> list[Condition]:
    """Add the condition of the greatest information gain until no good row is covered, or no condition gains."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name in x:
            v = x[name][inside]
            edges = np.unique(np.quantile(v[bad[inside]], np.linspace(0, 1, cuts)))
            for at in edges:
                for above in (True, False):
                    m = v >= at if above else v < at
                    p = int((m & bad[inside]).sum())
                    n = int(m.sum()) - p
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, above, float(at)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Drop conditions from the end while (bad - good) / (bad + good) on the pruning rows does not fall."""
    def worth(r: list[Condition]) -> float:
        m = np.logical_and.reduce([c.holds(x) for c in r])
        return ((m & bad).sum() - (m & ~bad).sum()) / max(m.sum(), 1)

    best = list(rule)
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, min_precision: float = 0.95, min_covered: int = 5, most_rules: int = 12, most_conditions: int = 4, cuts: int = 24, seed: int = 7) -> DecisionList:
    """Sequential covering over labelled rows; learning ends at a rule that is not precise enough to spare good rows."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bad), bool)
    for k in range(most_rules):
        if (left & bad).sum() < min_covered:
            break
        part = np.random.default_rng(seed + k).random(len(bad))
        grow, prune = left & (part < 2 / 3), left & (part >= 2 / 3)
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], most_conditions, cuts)
        if not rule:
            break
        if prune.any():
            rule = _prune(rule, {f: v[prune] for f, v in x.items()}, bad[prune])
        covers = left & np.logical_and.reduce([c.holds(x) for c in rule])
        if covers.sum() < min_covered or (covers & bad).sum() < min_precision * covers.sum():
            break
        rules.append(tuple(rule))
        left &= ~covers
    return DecisionList(tuple(rules))


def learn_from(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> DecisionList:
    """The list for ``labels`` (doc_id, quality: 0 is bad), fitted on at most ``sample_rows`` labelled documents.

    The sample is the labelled rows of the smallest id hash: bounded, the same in every partitioning, and small enough
    to broadcast and to fit on the driver. Where ids repeat, at most twice as many rows are taken, in the same order.
    Null labels and labels without a document teach nothing.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(id_hash("doc_id", seed=6), "doc_id", "quality").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", text_stats("text").alias("s")).select("doc_id", "quality", *features("s"))
    order = ["doc_id", "quality", *FEATURES]  # one order in any partitioning
    rows = rows.orderBy(id_hash("doc_id", seed=6), *order).limit(2 * sample_rows).toPandas().sort_values(order)
    if rows.empty:
        return DecisionList(())
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["quality"].to_numpy() == 0, **options)


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def assessed(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every whole text; ids and rows are left as they are.

    Null or empty text: counts 0, so base_failed. Repeated rows are judged one by one; other columns are ignored.
    """
    rows = docs.select("doc_id", text_stats("text").alias("s"))
    verdict = rules.expression({f.split(" AS ")[0]: c for f, c in zip(FEATURES, features("s"))})
    failed = base_failed("s")
    return rows.select("doc_id", *[F.col(f"s.{c}") for c in COUNTS], failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents, all their columns unchanged, that pass the base rules and the list; a column of any name stays."""
    stats = spare_name(docs, "stats")
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns], text_stats("text").alias(stats))
    verdict = rules.expression(dict(zip(FEATURES, features(stats))))
    return held.where(~base_failed(stats) & verdict).drop(stats)
