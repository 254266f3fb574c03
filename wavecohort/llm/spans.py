"""Spans of bytes in one buffer: read by eights, hashed, and told apart in an open-addressing table that compares bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mixed

#: Bytes of text that one step of the operators takes on, so that its arrays stay small whatever the batch; a longer text is one step.
STEP = 1 << 21
_KEEP = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
_FACTOR = np.uint64(0xBF58476D1CE4E5B9)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary or string column's bytes and its row offsets (n + 1); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8), offsets


def steps(offsets: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, min(n, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1))
        yield a, z
        a = z


def eights(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; behind the end are zeros."""
    held = np.concatenate((buffer, np.zeros(8, np.uint8)))
    return np.ndarray((len(buffer) + 1,), "<u8", held, 0, (1,))


def _piece(view: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of spans of which ``left`` bytes are left."""
    x = view[starts]
    short = left < 8
    return np.where(short, x & _KEEP[np.where(short, left, 0)], x)


def hashes(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """64-bit hashes of spans. ``seed`` may be an array, one for each span."""
    h = mixed(_piece(view, starts, lengths) * _FACTOR ^ lengths.astype(np.uint64) ^ mixed(np.zeros(1, np.uint64) + np.asarray(seed, np.uint64)))
    at, rest = np.flatnonzero(lengths > 8), 8
    while len(at):
        h[at] = mixed(h[at] * _FACTOR ^ _piece(view, starts[at] + rest, lengths[at] - rest))
        rest += 8
        at = at[lengths[at] > rest]
    return h


def equal(view: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of equal lengths from ``a`` and from ``b`` hold the same bytes."""
    same = _piece(view, a, lengths) == _piece(view, b, lengths)
    at, rest = np.flatnonzero(same & (lengths > 8)), 8
    while len(at):
        same[at] = _piece(view, a[at] + rest, lengths[at] - rest) == _piece(view, b[at] + rest, lengths[at] - rest)
        rest += 8
        at = at[same[at] & (lengths[at] > rest)]
    return same


def distinct(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """Of each span the first place, in the given order, of a span with the same owner and bytes.

    Spans go into a table of twice as many slots by their hash. Who finds a slot taken compares owner, length and bytes
    with who took it, and goes on to the next slot if they differ: equal hashes don't make spans equal.
    """
    n = len(starts)
    if h is None:
        h = hashes(view, starts, lengths, owners)
    size = 1 << max(4, (2 * n).bit_length())
    table = np.full(size, n, np.int64)
    first = np.empty(n, np.int64)
    slot = (h & np.uint64(size - 1)).astype(np.int64)
    at = np.arange(n)
    while len(at):
        free = at[table[slot[at]] == n]
        table[slot[free[::-1]]] = free[::-1]  # of several the first stays
        held = table[slot[at]]
        same = (lengths[held] == lengths[at]) & (owners[held] == owners[at]) & (h[held] == h[at])
        maybe = np.flatnonzero(same & (held != at))
        same[maybe] = equal(view, starts[at[maybe]], starts[held[maybe]], lengths[at[maybe]])
        first[at[same]] = held[same]
        at = at[~same]
        slot[at] = (slot[at] + 1) & (size - 1)
    return first


def words(buffer: np.ndarray, offsets: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and texts of all maximal runs of bytes that are not ``white`` (256 booleans); no run goes from one text to the next."""
    inside = np.append(~white[buffer], False)
    cut = np.zeros(len(inside), bool)
    cut[offsets] = True
    begin, end = inside.copy(), np.zeros(len(inside), bool)
    begin[1:] &= ~inside[:-1] | cut[1:]
    end[1:] = inside[:-1] & (~inside[1:] | cut[1:])
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    return begin, end - begin, np.searchsorted(offsets, begin, "right") - 1
