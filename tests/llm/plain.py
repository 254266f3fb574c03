"""Plain versions that the operators are held against."""

import hashlib
from collections import Counter, defaultdict


def near_components(rows):
    """{doc_id: (n_shingles, component_id)} by comparing every pair that shares a shingle."""
    sets, own = {}, defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            own[s].append(i)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    shared = Counter()
    for members in own.values():
        for x in range(len(members)):
            for y in range(x):
                shared[members[y], members[x]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeated_words(rows, width=35):
    """{doc_id: (n_words, n_removed, kept_sha256)}: words in windows whose word sequence begins at two places or more."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = {}
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def repeated_bytes(rows, width=50):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}: bytes in strings that begin in a smaller document too."""
    texts = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    first = {}
    for i, b in texts:
        for k in range(len(b) - width + 1):
            first.setdefault(b[k : k + width], i)
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
