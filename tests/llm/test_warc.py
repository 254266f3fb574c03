import base64
import hashlib
import random

import pytest
import zstandard

from wavecohort.llm import warc as W


def plain(rows, min_bytes=0):
    best = {}
    for i, html in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= min_bytes:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, html in rows:
        b = (html or "").encode()
        top = best.get(b)
        again = top is not None and top != i and len(b) >= min_bytes
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def read(spark, rows, **options):
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", t, 1) for i, t in rows], "page_id long, url string, html string, payload int")
    out = W.read_archives(W.write_archives(pages, **options))
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str), out


def test_round_trip_and_revisits(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a" * 40, "héllo", "", None, "x" * rng.randrange(9), "<p>" + str(rng.random()) * 50])) for i in range(300)]
    rows += [(-5, "héllo"), (2**62, "a" * 40), (7, "dup"), (7, "dup"), (8, "lone" * 100_000), (None, "héllo")]
    found, out = read(spark, rows, archive_pages=40)
    assert found == plain(rows)
    bodies = {r.page_id: r.payload for r in out.where("record_type = 'response'").collect()}
    texts = dict(rows)
    assert all(bytes(b).decode() == (texts[i] or "") for i, b in bodies.items())
    assert read(spark, rows, min_bytes=10)[0] == plain(rows, 10)
    assert read(spark, [])[0] == []


def test_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = W.read_archives(W.write_archives(pages))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str) == plain([(r.page_id, r.html) for r in pages.collect()])


def test_archive_files_and_long_pages(spark, tmp_path):
    """Archives as files of a folder, read back by the binaryFile source; pages of several MB fill archives by bytes."""
    rows = [(i, f"<p>{i}</p>" * (400_000 if i % 10 == 0 else 3)) for i in range(40)] + [(99, None), (7, "<p>7</p>" * 3)]
    pages = spark.createDataFrame([(i, "http://h", t) for i, t in rows], "page_id long, url string, html string")
    archives = W.write_archives(pages, archive_bytes=4_000_000)
    for _ in range(2):  # a second run replaces files by equal ones
        saved = W.save(archives, f"file://{tmp_path}/warc").collect()
    assert len(saved) > 2 and sorted(p.name for p in (tmp_path / "warc").glob("*.zst")) == sorted(r.file for r in saved)
    out = W.read_archives(W.load(spark, f"file://{tmp_path}/warc"))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str) == sorted(plain(rows), key=str)


def test_format_and_damage():
    records = [W.make_record(i, f"http://h/{i}", b"<p>text %d</p>" % i * 20, None, False) for i in range(60)]
    a = W.make_archive(records)
    assert int.from_bytes(a[:4], "little") == W.DICTIONARY_MAGIC
    size = int.from_bytes(a[4:8], "little")
    assert zstandard.ZstdDecompressor().decompress(a[8 : 8 + size])[:4] == bytes.fromhex("37a430ec")
    assert [r["page_id"] for r in W.read_archive(a)] == list(range(60))
    assert list(W.read_archive(W.make_archive([]))) == []
    for broken in (a[:-3], a[4:], a[:6], a[: 8 + size] + b"junk" + a[8 + size :], a[:-20] + bytes([a[-20] ^ 255]) + a[-19:]):
        with pytest.raises(W.DamagedArchive):
            list(W.read_archive(broken))
    good = records[3]
    for wrong in (good.replace(b"text 3", b"text 4", 1), good[:-4], good.replace(b"WARC/1.1", b"WARD/1.1"), good.replace(b"WARC-Record-ID", b"WARC-Record-XX"), good.replace(b"WARC-Type: response", b"WARC-Type: metadata")):
        with pytest.raises(W.DamagedArchive):
            W.parse_record(wrong)
    assert W.page_of(W.record_id(-5)) == -5 and W.page_of(W.record_id(None)) is None
