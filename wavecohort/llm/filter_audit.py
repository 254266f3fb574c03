"""How filters on documents interact: what each removes, in every order in which they can be applied.

A table-driven byte transducer reads each text once: a state and a byte give the next state and what to count. Where it
enters or leaves a word, the word's span goes into a hash table that compares bytes. Counts become failure flags, flags
become counters of failure patterns for each part, and orders are evaluated on those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, spare_name
from .spans import buffers, distinct, eights, steps

#: Fixed values of the contract.
SYMBOLS = b"#$%&*|"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5

COUNTS = ("words", "distinct_words", "capitals", "code_points", "symbols")
LANE = 256
#: Between words; in a word; in a word's code point of which 1, 2 or 3 bytes are to come.
GAP, WORD, ONE, TWO, THREE = range(5)
#: What a byte may give out, as counters of 16 bits in one number: a lane has 256 bytes.
_WORDS, _CAPITALS, _POINTS, _SIGNS = (1 << (16 * k) for k in range(4))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of (state, byte), at 256 * state + byte. A byte that no UTF-8 text has there is a code point of its own."""
    step, out = np.empty((5, 256), np.uint16), np.zeros((5, 256), np.int64)
    for byte in range(256):
        white, follows = byte in WHITE, 0x80 <= byte < 0xC0
        to = GAP if white else ONE if 0xC2 <= byte < 0xE0 else TWO if 0xE0 <= byte < 0xF0 else THREE if 0xF0 <= byte < 0xF5 else WORD
        for state in range(5):
            if state >= ONE and follows:
                step[state, byte] = state - 1
                continue
            step[state, byte] = to
            out[state, byte] = _POINTS + _WORDS * (state == GAP and not white) + _CAPITALS * (65 <= byte < 91) + _SIGNS * (byte in SYMBOLS)
    return step.ravel() * 256, out.ravel()


_NEXT, _OUT = _tables()


def transduced(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text (rows; words, capitals, code points, symbols), and all words: starts, lengths and their texts.

    Texts are read in lanes of LANE bytes, all lanes a byte at a time. A lane begins with a code point, so that the byte
    before tells its state.
    """
    sizes = np.diff(offsets)
    lanes = -(-sizes // LANE)
    owner = np.repeat(np.arange(len(sizes)), lanes)
    first = np.cumsum(lanes) - lanes
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * LANE
    for _ in range(3):
        start = start - ((start > offsets[:-1][owner]) & ((buffer[start] & 0xC0) == 0x80) if len(start) else 0)
    begins = start == offsets[:-1][owner]
    length = np.append(start[1:], offsets[-1]) - start
    white = np.isin(buffer[np.maximum(start, 1) - 1], np.frombuffer(WHITE, np.uint8)) if len(start) else begins
    order = np.argsort(-length, kind="stable")  # at each byte the lanes that go on are the first ones
    at, left = start[order], length[order]
    state = np.where(begins | white, GAP, WORD)[order].astype(np.uint16) * 256
    total = np.zeros(len(order), np.int64)
    inside = np.zeros(len(buffer) + 1, bool)
    alive = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
    for t, n in enumerate(alive.tolist()):
        place = at[:n] + t
        key = state[:n] | buffer[place]
        total[:n] += _OUT[key]
        state[:n] = now = _NEXT[key]
        inside[place] = now != GAP
    counts = np.zeros((len(sizes), 4), np.int64)
    for k in range(4):
        counts[:, k] = np.bincount(owner[order], (total >> (16 * k)) & 0xFFFF, len(sizes))
    ends = np.zeros(len(buffer) + 1, bool)
    ends[offsets] = True  # words of neighbouring texts are two
    edge = inside[1:] != inside[:-1]
    begin, end = inside.copy(), np.zeros(len(buffer) + 1, bool)
    begin[1:] &= edge | ends[1:]
    end[1:] = inside[:-1] & (edge | ends[1:])
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    return counts, begin, end - begin, np.searchsorted(offsets, begin, "right") - 1


def text_counts(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text, one in a row."""
    counts, starts, lengths, owner = transduced(buffer, offsets)
    new = distinct(eights(buffer), starts, lengths, owner) == np.arange(len(starts))
    return np.column_stack((counts[:, 0], np.bincount(owner[new], minlength=len(counts)), counts[:, 1:]))


def counted(docs: DataFrame, *keep: Column) -> DataFrame:
    """The columns ``keep`` of each row, which must have names, and COUNTS of its whole text; null counts as empty."""
    text = spare_name(docs, "text")
    rows = docs.select(*keep, F.col("text").cast("binary").alias(text))
    fields = rows.schema.fields[:-1]
    schema = pa.schema([pa.field(c, pa.int64()) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = buffers(batch.column(len(fields)))
            found = [text_counts(buffer[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]) for a, z in steps(offsets)]
            columns = np.concatenate(found) if found else np.empty((0, len(COUNTS)), np.int64)
            kept = batch.select(list(range(len(fields))))
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, np.ascontiguousarray(columns.T))], schema=pa.schema([*kept.schema, *schema]))
        release()

    told = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} long" for c in COUNTS])
    return rows.mapInArrow(count, told)


#: Failure conditions of one text by its counts; E, the copy of an earlier text, needs the whole table.
FILTERS = {
    "A": f"words < {MIN_WORDS}",
    "B": f"100 * distinct_words < {MIN_DISTINCT_PERCENT} * words",
    "C": f"100 * capitals > {MAX_CAPITAL_PERCENT} * code_points",
    "D": "symbols > 0",
}
COPY = "E"


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (a bit for each failing filter, A the least), good, toxic, n: documents by what they fail.

    A text is a copy if a row with a smaller doc_id has the same text (SHA-256). Rows are counted by (text, part, flags)
    before any text's least id is looked up, so that a text that a third of all documents have is a few rows then.
    Rows without doc_id are no copies and make none. A doc_id with several labels has each that one of them has.
    """
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest")
    rows = counted(docs, F.col("doc_id").cast("long").alias("doc_id"), part, digest)
    mask = sum((F.when(F.expr(c), F.lit(1 << k)).otherwise(0) for k, c in enumerate(FILTERS.values())), F.lit(0)).cast("int")
    rows = rows.select("doc_id", "part", "digest", mask.alias("mask")).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    key = ["digest", "part", "mask", "good", "toxic"]
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    none = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    texts = rows.groupBy(*key, "doc_id").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.sum("n").alias("n"), none.alias("no_id"), F.min(F.struct(first.alias("id"), "n")).alias("first"))
    # a text has as many rows now as it has parts and flags
    least = texts.groupBy("digest").agg(F.min("first.id.doc_id").alias("least"))
    texts = texts.join(least, "digest")
    alone = F.col("no_id") + F.when(F.col("first.id.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    counts = texts.groupBy("part", "mask", "good", "toxic").agg(F.sum(alone).alias("alone"), F.sum(F.col("n") - alone).alias("copies"))
    both = F.array(F.struct("mask", F.col("alone").alias("n")), F.struct((F.col("mask") + (1 << len(FILTERS))).alias("mask"), F.col("copies").alias("n")))
    return counts.select("part", F.explode(both).alias("c"), "good", "toxic").select("part", "c.mask", "good", "toxic", "c.n").where("n > 0")


def audit(counts: DataFrame, names: str) -> DataFrame:
    """The report of ``patterns``: a row for each part, order of the filters ``names`` (a letter each, bits of the mask) and step.

    Orders are a table of n! * n rows, told in the plan, so that n is small. Columns: part, filter_order, step, and long
    counts kept (after the step), removed (in it), redundant (failing, removed before), unique_fails (failing nothing
    else), good_lost, toxic_lost (of removed), shapley (what the filter removes, summed over all orders).
    """
    orders = []
    for order in permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order, 1):
            orders.append(F.struct(F.lit("".join(names[j] for j in order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(1 << k).alias("own"), F.lit(before).alias("before")))
            before |= 1 << k
    fails = F.col("mask").bitwiseAND(F.col("o.own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("o.before")) != 0
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long").alias(name)
    # a few rows a part: patterns and labels
    told = counts.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).select("*", F.explode(F.array(*orders)).alias("o"))
    report = told.groupBy("part", "o.filter_order", "o.step", "o.own").agg(
        count(~fails & ~gone, "kept"), count(fails & ~gone, "removed"), count(fails & gone, "redundant"), count(F.col("mask") == F.col("o.own"), "unique_fails"),
        count(fails & ~gone & F.col("good"), "good_lost"), count(fails & ~gone & F.col("toxic"), "toxic_lost"),
    )
    shapley = report.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return report.join(shapley, ["part", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic).

    Null texts are empty and fail A only; a null source is the part of the empty name. Rows that repeat an id with the
    same text are no copies of each other. A very long text is one step of a batch and is read whole; other columns are
    ignored, whatever their names. Empty table: no rows.
    """
    return audit(patterns(docs, labels), "".join(FILTERS) + COPY)
