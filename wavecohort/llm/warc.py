"""WARC archives compressed with Zstandard and a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed, and goes on
with one Zstandard frame for each record. Archives are bounded groups of pages, built and read by Spark tasks; a
DataFrame row (archive_id, content) is one archive file, as Spark's ``binaryFile`` source reads it and ``save`` writes it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"1970-01-01T00:00:00Z"


class DamagedArchive(ValueError):
    """An archive or record that breaks the format."""


def record_id(page_id: int | None) -> bytes:
    """A URN that holds the page id in the low 64 bits of a UUID; a null id sets bit 64."""
    digits = f"{(page_id & (2**64 - 1)) if page_id is not None else 2**64:032x}"
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}>".encode()


def page_of(urn: bytes) -> int | None:
    if not (urn.startswith(b"<urn:uuid:") and urn.endswith(b">")):
        raise DamagedArchive(f"record id {urn[:80]!r}")
    n = int(urn[10:-1].replace(b"-", b""), 16)
    if n >> 64:
        return None
    return n - 2**64 if n >= 2**63 else n


def digest(payload: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(payload).digest())


def _one_line(url: str | None) -> bytes:
    return " ".join((url or "").split()).encode("utf-8", "surrogatepass")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with the payload, or a revisit record that has the payload's length and digest only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + record_id(page_id),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + _one_line(url),
        b"WARC-Payload-Digest: sha1:" + digest(payload),
        b"Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + record_id(refers_to)]
    else:
        block += payload
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes, first: bytes) -> tuple[dict[bytes, bytes], int]:
    end = block.find(b"\r\n\r\n")
    lines = block[:end].split(b"\r\n")
    if end < 0 or not lines[0].startswith(first):
        raise DamagedArchive(f"header {block[:60]!r}")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise DamagedArchive(f"header line {line[:60]!r}")
        found[name.strip().lower()] = value.strip()
    return found, end + 4


def parse_record(raw: bytes) -> dict:
    """One record's fields; raises DamagedArchive where headers, lengths or digest do not agree with the content."""
    head, at = _headers(raw, VERSION)
    try:
        kind, length = head[b"warc-type"].decode(), int(head[b"content-length"])
        block = raw[at : at + length]
        if raw[at + length :] != b"\r\n\r\n" or len(block) != length:
            raise DamagedArchive(f"record of {len(raw)} bytes tells {length}")
        http, start = _headers(block, b"HTTP/1.1 ")
        n, payload = int(http[b"content-length"]), block[start:]
        algorithm, _, told = head[b"warc-payload-digest"].partition(b":")
        page, url = page_of(head[b"warc-record-id"]), head[b"warc-target-uri"].decode("utf-8", "surrogatepass")
        if algorithm != b"sha1" or kind not in ("response", "revisit"):
            raise DamagedArchive(f"{kind} record with a {algorithm!r} digest")
        if kind == "revisit":
            if payload or head[b"warc-profile"] != PROFILE:
                raise DamagedArchive("revisit record with a payload or without its profile")
            return {"page_id": page, "url": url, "payload": None, "payload_bytes": n, "payload_digest": told.decode(), "record_type": kind, "refers_to": page_of(head[b"warc-refers-to"])}
        if len(payload) != n or digest(payload) != told:
            raise DamagedArchive("payload differs from its length or digest")
    except (KeyError, ValueError) as error:
        raise error if isinstance(error, DamagedArchive) else DamagedArchive(f"missing or malformed header: {error}") from error
    return {"page_id": page, "url": url, "payload": payload, "payload_bytes": n, "payload_digest": told.decode(), "record_type": kind, "refers_to": None}


def make_archive(records: list[bytes], dictionary_bytes: int = 16_384, sample_bytes: int = 2_000_000, level: int = 3) -> bytes:
    """Dictionary frame, then a frame for each record. The dictionary is learned from records spread over the archive."""
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    trained, options = None, {}
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, [r[:65_536] for r in records[::step]], k=256, d=8)
        options["dict_data"] = trained
    except (zstandard.ZstdError, ValueError):  # too few records to learn from: an empty dictionary frame
        pass
    held = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes()) if trained else b""
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **options)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(held)), held, *map(pack.compress, records)])


def _frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, by its block headers."""
    head = data[at : at + 18]
    if len(head) < 5 or struct.unpack("<I", head[:4])[0] != FRAME_MAGIC:
        raise DamagedArchive(f"no frame at byte {at}")
    end = at + zstandard.frame_header_size(head)
    last = False
    while not last:
        if end + 3 > len(data):
            raise DamagedArchive("archive ends within a frame")
        block = int.from_bytes(data[end : end + 3], "little")
        last = bool(block & 1)
        end += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
    end += 4 * zstandard.get_frame_parameters(head).has_checksum
    if end > len(data):
        raise DamagedArchive("archive ends within a frame")
    return end


def read_archive(data: bytes) -> Iterator[dict]:
    """The parsed records of an archive, one frame each."""
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != DICTIONARY_MAGIC:
        raise DamagedArchive("no leading dictionary frame")
    size = struct.unpack("<I", data[4:8])[0]
    at = 8 + size
    if at > len(data):
        raise DamagedArchive("archive ends within its dictionary")
    held = data[8:at]
    if held[:4] == struct.pack("<I", FRAME_MAGIC):
        held = zstandard.ZstdDecompressor().decompress(held)
    unpack = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(held)} if held else {}))
    while at < len(data):
        end = _frame_end(data, at)
        try:
            raw = unpack.decompress(data[at:end])
        except zstandard.ZstdError as error:
            raise DamagedArchive(str(error)) from error
        yield parse_record(raw)
        at = end


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that repeat the payload of another one.

    Among pages of equal payloads of at least ``min_bytes`` (null html is empty) the largest page_id is the response, the
    others revisit it; repeated rows of that page are responses all. A null page_id is smaller than any other. Only ids
    and digests are shuffled, and a payload's largest id is aggregated before, so that a hot payload is a few rows.
    """
    held = pages.select("page_id", _payload().alias("payload")).select("page_id", F.octet_length("payload").alias("bytes"), F.sha1("payload").alias("sha")).where(F.col("bytes") >= min_bytes)
    newest = held.groupBy("sha", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("same")).where("same > 1").drop("same")
    return held.join(newest, ["sha", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def _payload() -> Column:
    return F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))


def write_archives(pages: DataFrame, archive_pages: int = 1000, archive_bytes: int = 32_000_000, min_bytes: int = 0) -> DataFrame:
    """(archive_id, content): a WARC record for each page, about ``archive_pages`` of them or ``archive_bytes`` of payload in an archive.

    An empty table gives no archive. Pages are dealt by id hash, so that no source or host can fill an archive; their
    payloads are shuffled once, to the archive, where they meet the list of revisits. A page's record is held whole, and
    an archive is a cell of a row: a single payload may have up to 2 GB.
    """
    size = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length(_payload())).alias("bytes")).first()
    archives = max(1, -(-size["n"] // archive_pages), -(-(size["bytes"] or 0) // archive_bytes))
    place = F.pmod(id_hash("page_id", F.when(F.col("page_id").isNull(), F.col("sha")), seed=4), F.lit(archives))
    dealt = pages.select("page_id", "url", _payload().alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("archive_id", place).select("page_id", "url", "payload", "archive_id")
    told = revisits(pages, min_bytes).select(F.col("page_id").alias("again"), "sha", "refers_to", place.alias("archive_id"))

    def number(x: object) -> int | None:
        return None if pd.isna(x) else int(x)

    def build(part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"archive_id": np.empty(0, np.int64), "content": []})
        of = {(number(p), s): number(r) for p, s, r in zip(told["again"].astype("Int64"), told["sha"], told["refers_to"].astype("Int64"))}
        part = part.sort_values("page_id", na_position="first", kind="stable")
        records = []
        for p, url, payload in zip(part["page_id"].astype("Int64"), part["url"], part["payload"]):
            key = (number(p), hashlib.sha1(payload).hexdigest())
            records.append(make_record(key[0], url, bytes(payload), of.get(key), key in of))
        return pd.DataFrame({"archive_id": [part["archive_id"].iloc[0]], "content": [make_archive(records)]})

    return dealt.groupBy("archive_id").cogroup(told.groupBy("archive_id")).applyInPandas(build, "archive_id long, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (a ``content`` column): page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""

    def told(records: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(records)
        out[["page_id", "refers_to"]] = out[["page_id", "refers_to"]].astype("Int64")
        return out

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                records, size = [], 0
                for record in read_archive(bytes(content)):
                    records.append(record)
                    size += len(record["payload"] or b"")
                    if len(records) == 1000 or size > 8_000_000:
                        yield told(records)
                        records, size = [], 0
                if records:
                    yield told(records)

    return archives.select("content").mapInPandas(parse, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of ``folder``, a shared path or URI that pyarrow knows; (archive_id, file, bytes) of each.

    A file is written under another name first and then moved, so that a task that runs again leaves whole files only.
    Lazy like any other DataFrame: the files are there when it has been evaluated.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for number, content in zip(batch["archive_id"].tolist(), batch["content"]):
                name = f"pages-{number:08d}.warc.zst"
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(bytes(content))
                store.move(part, f"{root}/{name}")
                yield pd.DataFrame({"archive_id": [number], "file": [name], "bytes": [len(content)]})

    return archives.select("archive_id", "content").mapInPandas(write, "archive_id long, file string, bytes long")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The archive files of a folder as rows, for ``read_archives``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
