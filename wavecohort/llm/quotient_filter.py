"""Counting quotient filters of packed n-grams: compact, lossless, and merged as sorted lists.

An n-gram of 64-bit word ids is permuted, invertibly, so that its first word is spread evenly whatever the ids are. The
first bits are the quotient, all others the remainder. A filter keeps remainders by quotient: a bit for each quotient
that occurs, a bit for each entry that ends its quotient's run, the remainders, and counters of as many bytes as they
need. Nothing is rounded: the n-grams and their counts come back exactly.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import mixed

_HEAD = struct.Struct("<BBBxIQ")
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = tuple(np.uint64(pow(int(x), -1, 2**64)) for x in _ODD)


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mixed``."""
    x = x ^ (x >> np.uint64(32))
    x = x * _BACK[0]
    x ^= (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x *= _BACK[1]
    return x ^ (x >> np.uint64(32))


def permuted(grams: np.ndarray) -> np.ndarray:
    """A permutation of n-grams (n x count, uint64): two rounds in which each word changes the next, and the last the first."""
    x = grams.copy()
    for _ in range(2):
        x[0] = mixed(x[0])
        for k in range(1, len(x)):
            x[k] ^= mixed(x[k - 1] + np.uint64(k))
        if len(x) > 1:
            x[0] += mixed(x[-1])
    return x


def restored(x: np.ndarray) -> np.ndarray:
    """The n-grams of permuted ones."""
    x = x.copy()
    for _ in range(2):
        if len(x) > 1:
            x[0] -= mixed(x[-1])
        for k in range(len(x) - 1, 0, -1):
            x[k] ^= mixed(x[k - 1] + np.uint64(k))
        x[0] = _unmixed(x[0])
    return x


def gathered(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (columns) and the sums of their counts; sorted stretches are merged, not sorted anew."""
    if not keys.shape[1]:
        return keys, counts
    order = np.argsort(keys[0], kind="stable")
    x = keys[:, order]
    tie = x[0, 1:] == x[0, :-1]
    same = tie & (x[:, 1:] == x[:, :-1]).all(0)
    if (tie & ~same).any():  # different keys with one first word: all words decide
        order = np.lexsort(keys[::-1])
        x = keys[:, order]
        same = (x[:, 1:] == x[:, :-1]).all(0)
    first = np.flatnonzero(np.append(True, ~same))
    return np.ascontiguousarray(x[:, first]), np.add.reduceat(counts[order], first)


def _packed_counts(v: np.ndarray) -> bytes:
    """Seven bits a byte, low ones first; the high bit says that more follow."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[at[on] + k] = ((v[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[on] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def _unpacked_counts(b: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(b < 128)
    start = np.append(0, end[:-1] + 1)
    out = np.zeros(len(end), np.uint64)
    for k in range(int((end - start).max(initial=-1)) + 1):
        on = np.flatnonzero(start + k <= end)
        out[on] |= (b[start[on] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray, prefix_bits: int = 0) -> bytes:
    """The filter of sorted distinct keys that share their first ``prefix_bits`` bits. The quotient has 8 or 16 bits, so that a run is short and empty quotients are cheap."""
    n, size = keys.shape
    q = 16 if size > 4096 else 8
    low = 64 - prefix_bits - q
    prefix = int(keys[0, 0] >> np.uint64(64 - prefix_bits)) if prefix_bits and size else 0
    quotient = ((keys[0] << np.uint64(prefix_bits)) >> np.uint64(64 - q)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True)[:size]
    rest = (keys[0] & ((np.uint64(1) << np.uint64(low)) - np.uint64(1))).astype("<u8").view(np.uint8).reshape(size, 8)[:, : -(-low // 8)]
    return b"".join((_HEAD.pack(n, prefix_bits, q, size, prefix), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), rest.tobytes(), keys[1:].astype("<u8").tobytes(), _packed_counts(counts)))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a filter, in order."""
    n, prefix_bits, q, size, prefix = _HEAD.unpack_from(data)
    b, at = np.frombuffer(data, np.uint8), _HEAD.size

    def take(count: int) -> np.ndarray:
        nonlocal at
        at += count
        return b[at - count : at]

    occupied = np.flatnonzero(np.unpackbits(take((1 << q) // 8)))
    run_end = np.flatnonzero(np.unpackbits(take(-(-size // 8)))[:size])
    low = 64 - prefix_bits - q
    rest = np.zeros((size, 8), np.uint8)
    rest[:, : -(-low // 8)] = take(size * -(-low // 8)).reshape(size, -(-low // 8))
    keys = np.empty((n, size), np.uint64)
    keys[0] = rest.reshape(-1).view("<u8") | (np.repeat(occupied, np.diff(run_end, prepend=-1)).astype(np.uint64) << np.uint64(low))
    if prefix_bits:
        keys[0] |= np.uint64(prefix) << np.uint64(64 - prefix_bits)
    keys[1:] = np.frombuffer(take(8 * (n - 1) * size).tobytes(), "<u8").reshape(n - 1, size)
    return keys, _unpacked_counts(b[at:])


def merged(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of several filters of n-grams of one n."""
    parts = [unpacked(f) for f in filters]
    return gathered(np.concatenate([k for k, _ in parts], 1), np.concatenate([c for _, c in parts]))
