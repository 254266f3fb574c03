"""SentencePiece encoding by sampling without replacement, and decoding.

A text is cut before each run of spaces, where no piece can lie across; every chunk has a lattice of vocabulary pieces,
and a text's segmentations are the paths through its chunks' lattices. Gumbel top-k draws k distinct segmentations: each path's log-probability is
perturbed by a Gumbel variable and the k greatest win. They are found by A* search over the tree of prefixes, whose
nodes carry the exact greatest perturbed value below them: the root's is drawn, a child's given its parent's (the
chosen child inherits it, the others' maximum is a truncated Gumbel), so the greatest node is expanded next and every
leaf that is reached is the next sample. Draws are hashes of seed, row key and place, and sums run within a state or a
text, so that all numbers are the same whatever the partitioning.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_ranges, mixed, release

#: Chunks whose lattices a worker remembers; they begin anew when it is full.
MOST_CHUNKS = 400_000
#: Bytes of a chunk above which it is cut further.
LONG = 256
_RUNS = re.compile(rb" +[^ ]*")
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def salted(*parts) -> np.ndarray:
    """The parts of a draw, added up; further parts may be added to it."""
    x = np.uint64(0)
    with np.errstate(over="ignore"):
        for p, c in zip(parts, _C):
            x = x + np.asarray(p).astype(np.uint64) * c
    return np.atleast_1d(x)


def uniform(salt: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) that are a hash of what is added up in ``salt``."""
    return ((mixed(salt) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces of a SentencePiece model as a byte trie, with log-weights of a unigram lattice.

    The model ranks its pieces: a piece of rank r gets the weight (r + 2) ** -sharpness. A character that is no piece is
    written as byte pieces. A space is written by the piece mark, and the mark itself as bytes, so that decoding is exact.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces: dict[bytes, int] = {}
        self.bytes_of = piece_bytes(path)
        self.pieces = pa.array(self.bytes_of, pa.large_binary())
        self.byte_id = np.zeros(256, np.int64)
        for i, b in enumerate(self.bytes_of):
            if model.is_byte(i):
                self.byte_id[b[0]] = i
            elif b:
                pieces[b] = i
        rank = np.argsort(np.argsort([-model.get_score(i) for i in range(n)], kind="stable"))
        self.weight = -sharpness * np.log(rank + 2.0)
        self.weight[self.byte_id] = -sharpness * np.log(n + 2.0)
        self.linear = np.exp(self.weight)
        # trie nodes that have children get a row of 256
        number: dict[bytes, int] = {b"": 0}
        inner: dict[bytes, int] = {b"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                number.setdefault(p[:k], len(number))
                inner.setdefault(p[: k - 1], len(inner))
        self.child = np.full((len(inner), 256), -1, np.int32)
        self.row = np.full(len(number), -1, np.int32)
        self.piece = np.full(len(number), -1, np.int32)
        for prefix, k in number.items():
            self.row[k] = inner.get(prefix, -1)
            self.piece[k] = pieces.get(prefix, -1)
            if prefix:
                self.child[inner[prefix[:-1]], prefix[-1]] = k

    def decode(self, ids: list[int]) -> bytes:
        joined = b"".join(map(self.bytes_of.__getitem__, ids))
        return joined[1:] if joined[:1] == b" " else joined

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of runs of ids: the bytes of pieces that are taken lie next to each other, so that a text is a slice of them."""
        if not len(ids):
            return pa.array([""] * (len(bounds) - 1), pa.string())
        taken = self.pieces.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][bounds]
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), taken.buffers()[2]])
        texts = pc.if_else(pc.starts_with(joined, b" "), pc.binary_replace_slice(joined, 0, 1, b""), joined)
        return texts.cast(pa.binary()).cast(pa.string())


class Lattices:
    """The lattices of the chunks seen so far: states are byte positions, edges are pieces.

    Edges of a state are contiguous, longest first. ``p`` is an edge's probability given its state, after the backward
    sums over everything that may follow it in the chunk; ``rest`` is that of the state's other edges together, summed
    without it.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.first = self.end = self.next = self.id = np.empty(0, np.int32)
        self.p = self.rest = np.empty(0)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n_states = 0
        self.n_edges = 0

    def states(self, chunks: list[bytes]) -> np.ndarray:
        """The first state of each of these distinct chunks; a chunk is named without the space that it begins with."""
        found = list(map(self.known.get, chunks))
        fresh = [c for c, s in zip(chunks, found) if s is None]
        if fresh:
            if len(self.known) + len(fresh) > MOST_CHUNKS:
                self.clear()
                fresh = chunks
            self._add(fresh)
            found = list(map(self.known.__getitem__, chunks))
        return np.array(found, np.int64)

    def _add(self, chunks: list[bytes]) -> None:
        data = np.frombuffer(b" " + b" ".join(chunks), np.uint8)
        bounds = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        bounds = np.append(0, bounds)
        n = len(data)
        matches = self._matches(data, bounds)
        depth = max(k for k, _, _ in matches)
        cut = np.zeros(n, bool)
        cut[bounds[:-1]] = True
        if int(np.diff(bounds).max()) > LONG:
            cut |= self._seams(bounds, matches)
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, n))
        # stretches by falling length: those of a distance to the end are the first ones, and states go by distance
        by_size = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[by_size] = np.arange(len(size))
        longest = int(size.max())
        held = np.searchsorted(-size[by_size], -np.arange(longest + 1), side="right")
        level = np.cumsum(np.append(0, held))
        stretch = np.cumsum(cut) - 1
        left = (starts + size)[stretch] - np.arange(n)  # distance of each byte to its stretch's end
        state_of = level[left] + rank[stretch]
        total = int(level[-1])
        # pieces by state, longest first, and their weights
        piece, weight = np.full((total, depth), -1, np.int32), np.zeros((depth, total))
        for k, at, which in matches:
            to = state_of[at]
            piece[to, depth - k] = which
            weight[depth - k, to] = self.vocabulary.linear[which]
        beta, sums = np.ones(total), np.empty_like(weight)
        for d in range(1, longest + 1):
            a, z = level[d], level[d + 1]
            here = weight[:, a:z]
            for k in range(1, min(depth, d) + 1):
                here[depth - k] *= beta[level[d - k] : level[d - k] + z - a]
            np.cumsum(here, 0, out=sums[:, a:z])
            beta[a:z] = sums[-1, a:z]
            faint = np.flatnonzero((beta[a:z] < 1e-150) & (beta[a:z] > 0))
            if len(faint):  # only ratios count, so that a stretch may be scaled as far back as pieces reach
                for k in range(min(depth, d + 1)):
                    beta[level[d - k] + faint] *= 1e150
                here[:, faint] *= 1e150
                sums[:, a + faint] *= 1e150
        flat = np.flatnonzero(piece.ravel() >= 0)
        state = flat // depth
        row = flat - state * depth
        many = np.bincount(state, minlength=total)
        last = np.cumsum(many)
        first = last - many
        # what the other edges of a state weigh: those before, and those behind, from the last one on
        w, whole = weight[row, state], sums[-1, state]
        others = np.zeros(len(flat))
        place = np.arange(len(flat))
        later = np.flatnonzero(place > first[state])
        others[later] = sums[row[later - 1], state[later]]
        behind, to_end = np.zeros(len(flat)), last[state] - 1 - place
        inner = np.flatnonzero(to_end > 0)
        for k in range(1, int(to_end.max()) + 1):
            e = inner[to_end[inner] == k]
            behind[e] = behind[e + 1] + w[e + 1]
        others += behind
        # the end of a stretch inside a chunk is the next one's start
        final = np.zeros(len(size), bool)
        final[stretch[bounds[1:] - 1]] = True
        follower = np.minimum(np.arange(1, len(size) + 1), len(size) - 1)
        ends = np.where(final, rank, level[size[follower]] + rank[follower])[by_size]
        distance = np.repeat(np.arange(longest + 1), held)[state]
        to = distance - depth + row
        column = state - level[distance]
        target = np.where(to > 0, level[to] + column, ends[column])
        self.first, self.end = (self._put(old, self.n_states, new) for old, new in ((self.first, first + self.n_edges), (self.end, last + self.n_edges)))
        self.next, self.id = (self._put(old, self.n_edges, new) for old, new in ((self.next, target + self.n_states), (self.id, piece.ravel()[flat])))
        self.p, self.rest = (self._put(old, self.n_edges, new) for old, new in ((self.p, w / whole), (self.rest, others / whole)))
        self.known.update(zip(chunks, (state_of[bounds[:-1]] + self.n_states).tolist()))
        self.n_states += total
        self.n_edges += len(flat)

    @staticmethod
    def _seams(bounds: np.ndarray, matches: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Places inside chunks of over LONG bytes that no piece lies across: long chunks are cut there, so that no stretch is long."""
        n = int(bounds[-1])
        across = np.zeros(n + 1, np.int64)
        for k, at, _ in matches:
            if k > 1:
                across += np.bincount(at + 1, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)
        return (np.cumsum(across)[:n] == 0) & np.repeat(np.diff(bounds) > LONG, np.diff(bounds))

    def _matches(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Piece lengths that occur, and for each where such pieces begin and which they are: the trie is walked from all bytes at once.

        Characters that are no piece have an edge for each byte.
        """
        v = self.vocabulary
        n = len(data)
        stop = np.repeat(bounds[1:], np.diff(bounds))
        node = v.child[0, data].astype(np.int64)
        at = np.flatnonzero(node >= 0)
        node, depth = node[at], 1
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(at):
            which = v.piece[node]
            hit = np.flatnonzero(which >= 0)
            if len(hit):
                found.append((depth, at[hit], which[hit]))
            row = v.row[node]
            go = np.flatnonzero((row >= 0) & (at + depth < stop[at]))
            at = at[go]
            node = v.child[row[go], data[at + depth]]
            go = np.flatnonzero(node >= 0)
            at, node, depth = at[go], node[go], depth + 1
        begins = (data & 0xC0) != 0x80
        char = np.maximum(np.cumsum(begins) - 1, 0)
        opening = np.flatnonzero(begins)
        size = np.diff(np.append(opening, n))
        whole = np.zeros(max(1, len(opening)), bool)
        for k, begun, _ in found:
            if k <= 4:
                of = char[begun[begins[begun]]]
                whole[of[size[of] == k]] = True
        loose = np.flatnonzero(~whole[char])
        if len(loose):
            found.append((1, loose, v.byte_id[data[loose]]))
        return found

    @staticmethod
    def _put(held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        """``new`` at position ``at`` of an array that grows by half when it is full, and stays when chunks are forgotten."""
        if at + len(new) > len(held):
            grown = np.empty((at + len(new)) * 3 // 2, held.dtype)
            grown[:at] = held[:at]
            held = grown
        held[at : at + len(new)] = new
        return held

    def walk(self, state: np.ndarray, key: np.ndarray, place: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
        """Random edges from each state to its chunk's end: all edges in order, and how many each state took."""
        count = np.zeros(len(state), np.int64)
        rounds = []
        active = np.flatnonzero(self.end[state] > self.first[state])
        at = state[active]
        salt = salted(key[active], place[active], 0, draw)
        while len(active):
            u = uniform(salt)
            e = self.first[at]
            last = self.end[at] - 1
            u -= self.p[e]
            behind = np.flatnonzero((u >= 0) & (e < last))
            while len(behind):
                e[behind] += 1
                u[behind] -= self.p[e[behind]]
                behind = behind[(u[behind] >= 0) & (e[behind] < last[behind])]
            rounds.append((active, e))
            count[active] += 1
            at = self.next[e]
            go = self.end[at] > self.first[at]
            active, at, salt = active[go], at[go], salt[go] + _C[2]
        offset = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int64)
        for t, (a, e) in enumerate(rounds):
            flat[offset[a] + t] = e
        return flat, count


def chunked(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct chunks, without their first space; which one each chunk of the texts is; where each text's begin."""
    odd = np.array([b"  " in t or t[:1] == b" " for t in texts], bool)
    # Arrow splits at single spaces; runs of spaces stay whole
    lists = pc.split_pattern(pa.array([None if o or not t else t for t, o in zip(texts, odd.tolist())], pa.large_binary()), b" ")
    count = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    runs = [[c[1:] for c in _RUNS.findall(b" " + t)] for t, o in zip(texts, odd) if o]
    plain = pc.list_flatten(lists)
    if runs:
        plain = pa.concat_arrays([plain, pa.array([c for r in runs for c in r], plain.type)])
    coded = plain.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    first = np.cumsum(count) - count
    if runs:
        count[odd] = [len(r) for r in runs]
        first[odd] = len(code) - count[odd].sum() + np.cumsum(count[odd]) - count[odd]
        code = code[flat_ranges(first, count)]
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), code, np.append(0, np.cumsum(count))


def _truncated(mu: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with location ``mu``, given that they are at most ``top``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(np.isneginf(mu), -np.inf, mu - np.log(-np.log(u) + np.exp(np.minimum(mu - top, 700))))


def sample(lattices: Lattices, keys: list[int], texts: list[bytes], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations: ids, log-probability, perturbed value, log inclusion probability.

    An empty text has one, the empty one.
    """
    chunks, code, offset = chunked(texts)
    state = lattices.states(chunks)[code] if len(code) else np.empty(0, np.int64)
    key = np.array(keys, np.int64).view(np.uint64)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(offset))
    number = np.arange(len(state)) - offset[doc] if len(state) else np.empty(0, np.int64)
    root = -np.log(-np.log(uniform(salted(key, 0, 0, 1 << 40))))
    # a path: its edges, the chunk of each, log-probability before each, whole log-probability, perturbed value
    paths: list[list[tuple]] = [[] for _ in range(n)]
    heaps: list[list[tuple]] = [[] for _ in range(n)]

    def grow(rows, base, chunk0, flat, count, lengths, top, draw):
        """Add for each of ``rows`` a path: ``base`` (edges, chunks, logs before, log so far) and then its new steps."""
        log_p = np.log(lattices.p[flat])
        where = np.repeat(chunk0, count)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(rows)), lengths)
        before, totals = np.empty(len(flat)), []
        for b, a, z in zip(base, (ends - lengths).tolist(), ends.tolist()):
            run = np.cumsum(np.concatenate(([b[3]], log_p[a:z])))
            before[a:z] = run[:-1]
            totals.append(float(run[-1]))
        place = np.arange(len(flat)) - (ends - lengths)[owner]
        with np.errstate(divide="ignore"):
            before_rest = before + np.log(lattices.rest[flat])
        bound = _truncated(before_rest, np.asarray(top)[owner], uniform(salted(key[np.asarray(rows)[owner]], place, draw, 1 << 41))) if len(flat) else log_p
        for i, (r, b, a, z) in enumerate(zip(rows, base, (ends - lengths).tolist(), ends.tolist())):
            skip = len(b[0])
            if draw == k - 1:  # of alternatives the greatest counts only, for what is not among the winners
                paths[r].append((np.concatenate((b[0], flat[a:z])), None, None, totals[i], float(top[i])))
                g = float(bound[a:z].max()) if z > a else -np.inf
                if g > -np.inf:
                    heapq.heappush(heaps[r], (-g, len(paths[r]) - 1, 0, ()))
                continue
            paths[r].append((np.concatenate((b[0], flat[a:z])), np.concatenate((b[1], where[a:z])), np.concatenate((b[2], before[a:z])), totals[i], float(top[i])))
            g = bound[a:z]
            best = np.argpartition(-g, k)[: k + 1] if len(g) > k + 1 else np.arange(len(g))
            for j in best.tolist():
                if g[j] > -np.inf:
                    heapq.heappush(heaps[r], (-float(g[j]), len(paths[r]) - 1, j + skip, (int(flat[a + j]),)))

    nothing = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0.0)
    flat, count = lattices.walk(state, key[doc], number, 0)
    upto = np.concatenate(([0], np.cumsum(count)))
    grow(list(range(n)), [nothing] * n, np.arange(len(state)), flat, count, np.diff(upto[offset]), root, 0)
    for draw in range(1, k):
        rows, base, tops, first_state, first_chunk, lefts = [], [], [], [], [], []
        popped = [(r, *heapq.heappop(heaps[r])) for r in range(n) if heaps[r]]
        at, step = np.array([x[0] for x in popped], np.int64), np.array([x[3] for x in popped], np.int64)
        draws = uniform(salted(key[at], step, draw, 1 << 42)).tolist()
        for (r, g, p, j, taken), v in zip(popped, draws):
            edges, where, logs, _, _ = paths[r][p]
            # the state of step j, without the edges that other paths have taken there
            chunk = int(where[j])
            s = int(lattices.next[edges[j - 1]]) if j and where[j - 1] == chunk else int(state[chunk])
            free = [e for e in range(int(lattices.first[s]), int(lattices.end[s])) if e not in taken]
            p_free = lattices.p[free]
            u = v * p_free.sum()
            pick = free[min(int(np.searchsorted(np.cumsum(p_free), u)), len(free) - 1)]
            left = float(p_free[np.array(free) != pick].sum())
            lefts.append((r, p, j, (*taken, pick), float(logs[j]) + (np.log(left) if left > 0 else -np.inf)))
            rows.append(r)
            base.append((np.append(edges[:j], pick), np.append(where[:j], chunk), logs[: j + 1], float(logs[j] + np.log(lattices.p[pick]))))
            tops.append(-g)
            first_state.append(int(lattices.next[pick]))
            first_chunk.append(chunk)
        if not rows:
            break
        again = _truncated(np.array([x[4] for x in lefts]), np.array(tops), uniform(salted(key[at], step, draw, 1 << 43))).tolist()
        for (r, p, j, taken, _), x in zip(lefts, again):
            if x > -np.inf:
                heapq.heappush(heaps[r], (-x, p, j, taken))
        # the rest of the chunk and the chunks after it are drawn anew
        r = np.array(rows)
        after = np.array(first_chunk) + 1
        more = offset[r + 1] - after
        lengths = more + 1
        place = np.cumsum(lengths) - lengths
        chunk = np.empty(int(lengths.sum()), np.int64)
        chunk[place] = after - 1
        inner = np.ones(len(chunk), bool)
        inner[place] = False
        chunk[inner] = flat_ranges(after, more)
        begin = state[chunk]
        begin[place] = first_state
        owner = np.repeat(r, lengths)
        flat, count = lattices.walk(begin, key[owner], chunk - offset[owner], draw)
        upto = np.concatenate(([0], np.cumsum(count)))
        grow(rows, base, chunk, flat, count, np.diff(upto[np.append(place, len(chunk))]), tops, draw)
    out = []
    for r in range(n):
        cut = -heaps[r][0][0] if heaps[r] else -np.inf
        mine = []
        for edges, _, _, total, g in paths[r]:
            d = total - cut
            log_in = 0.0 if d > 30 else d if d < -30 else float(np.log(-np.expm1(-np.exp(d))))
            mine.append((lattices.id[edges] if len(edges) else edges, total, g, log_in))
        out.append(mine)
    return out


_lattices: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, sharpness: float) -> Lattices:
    if (path, sharpness) not in _lattices:
        _lattices[path, sharpness] = Lattices(Vocabulary(path, sharpness))
    return _lattices[path, sharpness]


def encoded(docs: DataFrame, path: str, k: int = 2, sharpness: float = 1.0, seed: int = 1, part_bytes: int = 400_000, decoded: bool = False) -> DataFrame:
    """doc_id, sample (1 is the greatest perturbed value), ids, log_prob, perturbed, log_inclusion: up to ``k`` rows a document.

    log_inclusion is the log-probability that the segmentation is among the k winners, given the greatest perturbed
    value that is not. ``decoded`` adds the text that the ids decode to. Null and empty texts have one empty segmentation. Rows that repeat an id and a text repeat its
    samples; a null id is a key like others. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattices(path, sharpness)
        for batch in batches:
            ids, given = batch.column("doc_id"), batch.column("text").cast(pa.binary()).to_pylist()
            known = ids.to_pylist()
            a = 0
            while a < len(given):
                z, size, texts = a, 0, []
                while z < len(given) and (z == a or size < part_bytes):
                    texts.append(given[z] or b"")
                    size += len(texts[-1])
                    z += 1
                keys = [xxhash.xxh3_64_intdigest(f"{seed}|{'<NA>' if i is None else i}".encode()) for i in known[a:z]]
                found = sample(held, np.array(keys, np.uint64).view(np.int64).tolist(), texts, k)
                paths = [x for mine in found for x in mine]
                count = np.fromiter(map(len, found), np.int64, len(found))
                numbers = np.concatenate([x[0] for x in paths]).astype(np.int32)
                bounds = np.append(0, np.cumsum([len(x[0]) for x in paths]))
                columns = {"doc_id": ids.take(pa.array(np.repeat(np.arange(a, z), count))), "sample": pa.array((flat_ranges(np.ones(len(count), np.int64), count)).astype(np.int32)), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(numbers))}
                columns |= {name: pa.array([x[c] for x in paths], pa.float64()) for c, name in enumerate(("log_prob", "perturbed", "log_inclusion"), 1)}
                if decoded:
                    columns["text"] = held.vocabulary.decoded(numbers, bounds)
                yield pa.RecordBatch.from_pydict(columns)
                a = z
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double" + ", text string" * decoded)


def piece_bytes(path: str) -> list[bytes]:
    """The text of each id, with a space for the piece mark; of ids that are no text, nothing."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if skip(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]


_pieces: dict[str, list[bytes]] = {}


def decoder(path: str):
    """A scalar pandas UDF: the text of an array of ids."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _pieces:
            _pieces[path] = piece_bytes(path)
        get = _pieces[path].__getitem__
        for ids in batches:
            out = []
            for x in ids:
                joined = b"".join(map(get, x.tolist()))
                out.append((joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "surrogatepass"))
            yield pd.Series(out, dtype=object)

    return decode
