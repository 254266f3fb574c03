import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from wavecohort.llm import packing as P
from wavecohort.llm.queries import vocabulary

PATH, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("joined", [True, False])
def test_cached_ids_are_the_tokenizers_ids(spark, sf, joined):
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    letters = "ab Zé漢🙂 \n\t\r\x1c\x85  1'sd.,|<>\0 "
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "  ", "a  b", " a", "a ", "<|endoftext|> x", "x <|endoftext|>", "don't can't 's 're", "a\0 b"]
    plain = Tokenizer.from_file(PATH)
    cached = P.CachedTokenizer(PATH, RANKS if joined else None, most=50)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in cached.encode(part)] == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]


def test_tree_is_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(5, 60))
        items = -np.sort(-rng.integers(1, size + 1, rng.integers(1, 90)))
        where, offset = P.first_fit_decreasing(items, size)
        room = []
        for x, w, o in zip(items, where, offset):
            k = next((k for k, r in enumerate(room) if r >= x), len(room))
            if k == len(room):
                room.append(size)
            assert (w, o) == (k, size - room[k])
            room[k] -= x


def check(rows, texts, size):
    plain = Tokenizer.from_file(PATH)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= size
    for doc, pieces in by_doc.items():
        ids = plain.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    return sum(n for p in bins.values() for _, n in p) / (size * len(bins))


def test_every_id_is_in_one_piece(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    filled = check(P.packed(docs, PATH, ranks=RANKS).collect(), texts, 2048)
    assert filled > 0.97


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 9000), (4, "a"), (5, "  \n ")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, offset int, ids string")
    check(P.packed(docs, PATH, size=64, group_docs=2).collect(), dict(rows), 64)
    again = docs.union(docs).union(spark.createDataFrame([(None, "a", 0, "x"), (None, None, 0, "x")], docs.schema))
    out = P.packed(again, PATH, keep_ids=True).collect()
    assert sum(r.length for r in out if r.start == 0 or r.doc_id == 3) > 0
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    assert len([r for r in out if r.doc_id is None]) == 2 and len([r for r in out if r.doc_id == 4]) == 2
    assert P.packed(docs.limit(0), PATH).count() == 0
