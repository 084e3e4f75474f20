"""WARC archives compressed with Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: pages with equal payloads share one response record (that of the largest page id), the others are revisit
records that refer to it. Each task streams one archive into the shared folder and lists it in its output rows; only
listed archives are read, so a task that runs again does no harm. The dictionary is trained once on a bounded sample.

Reading: an archive is read as a stream. The dictionary is taken from the skippable frame (magic 0x184D2A5D; itself
compressed or not), then each frame is decoded on its own and must be one whole record: a version line, the required
headers, a block of exactly Content-Length bytes and the closing blank lines; payload digests are computed anew.
What doesn't hold raises ValueError.

Defined results: null pages have an empty payload, null URLs an empty URI. Line breaks in URLs are percent-encoded.
Rows with equal payloads and the largest page id twice are all responses; a null page id is written as ``null`` and
comes after all others (it is a response only if no equal payload has an id). Empty tables give no archive rows.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import fresh_path, open_fs, publish, slices, written

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP headers in the block, and the payload after them."""
        head, gap, body = self.block.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"HTTP/"):
            raise ValueError("the block has no HTTP headers")
        return header_lines(head.split(b"\r\n")[1:]), body


def header_lines(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:60]!r}")
        out[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    return out


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    if not uri.startswith("<urn:page:") or uri[-1] != ">":
        raise ValueError(f"not a page's record: {uri[:60]}")
    return None if uri == "<urn:page:null>" else int(uri[10:-1])


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit (without payload) where refers_to is given."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A").strip()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]),
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    headers = header_lines(lines[1:])
    if missing := [h for h in REQUIRED if h not in headers]:
        raise ValueError(f"headers are missing: {missing}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"the block isn't of its Content-Length, {headers['content-length']}: {len(rest) - 4}")
    return Record(headers, rest[:-4])


def archive_frames(records: Iterable[bytes], dictionary: bytes, level: int = 3) -> Iterator[bytes]:
    """The skippable frame with the dictionary (if there is one), then a frame for each record."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True)
    if dictionary:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        yield struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
    for r in records:
        yield packer.compress(r)


def read_archive(stream: io.RawIOBase, step: int = 1 << 14) -> Iterator[Record]:
    """The records of an archive, one frame after the other."""
    data = stream.read(8)
    shared = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary is cut off")
        shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
        data = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=shared)
    while data or (data := stream.read(step)):
        frame, out = unpacker.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(step)):
                raise ValueError("the last frame is cut off")
        yield parse_record(b"".join(out))


def train_dictionary(pages: DataFrame, html: str, max_samples: int, size: int, key: str) -> bytes:
    """A dictionary from about max_samples pages (a bound of the fit; chosen by a hash of the id); none from too few."""
    total = pages.count()
    rows = pages.select(F.substring(F.coalesce(F.col(html), F.lit("")), 1, 1 << 14).alias("t"), F.col(key).alias("k"))
    if total > max_samples:
        rows = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_samples / total)))
    samples = [r["t"].encode() for r in rows.sort("k", "t").toLocalIterator() if r["t"]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # the samples are too few or too alike
        return b""


def record_types(pages: DataFrame, key: str, html: str, min_revisit_bytes: int) -> DataFrame:
    """k, url, t, digest, refers_to of every page: the largest id of the equal payloads, where that is another page.

    Equal payloads are counted before the shuffle; the join back on the digest is an outer join whose large
    partitions Spark splits, so that a payload of a third of all pages is spread over tasks."""
    own = pages.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("t")).withColumn("digest", F.sha1(F.col("t").cast("binary")))
    shared = own.filter(F.octet_length("t") >= min_revisit_bytes).groupBy("digest").agg(F.max("k").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest"), "first")
    joined = own.join(shared, "digest", "left")
    return joined.select("k", "url", "t", "digest", F.when(F.coalesce(F.col("k") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, key: str = "page_id", html: str = "html", min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", max_samples: int = 400, dictionary_bytes: int = 32 << 10, folder: str | None = None) -> DataFrame:
    """Writes every page as a record; returns the list of archives: path, n_records, archive_bytes."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages, html, max_samples, dictionary_bytes, key))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", 0

        def records() -> Iterator[bytes]:
            nonlocal n
            for part in slices(batches, "t"):
                for r in part.to_pylist():
                    n += 1
                    yield record_bytes(r["k"], r["url"], r["t"].encode(), base64.b32encode(bytes.fromhex(r["digest"])).decode(), r["refers_to"], date)

        stream = records()
        first = next(stream, None)
        if first is None:
            return

        def all_records() -> Iterator[bytes]:
            yield first
            yield from stream

        size = publish(path, archive_frames(all_records(), dictionary.value))
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "archive_bytes": [size]})

    return written(record_types(pages, key, html, min_revisit_bytes).mapInArrow(write, "path string, n_records long, archive_bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record of the listed archives; one archive at a time in a task, as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch["path"].to_pylist(), batch["n_records"].to_pylist(), strict=True):
                files, at = open_fs(path)
                rows: list[tuple] = []
                seen = 0
                with files.open_input_stream(at, compression=None) as stream:
                    for r in read_archive(stream):
                        rows.append(row_of(r))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            seen, rows = seen + len(rows), []
                if seen + len(rows) != expected:
                    raise ValueError(f"{path} has {seen + len(rows)} records; its writer counted {expected}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    n = max(1, archives.count())
    return archives.repartition(n, "path").mapInArrow(read, SCHEMA)


def row_of(r: Record) -> dict:
    """The columns of a record; a response's payload must have the length and the digest that its headers give."""
    kind, digest = r.headers["warc-type"], r.headers.get("warc-payload-digest", "")
    http, payload = r.http()
    size = int(http["content-length"])
    if not digest.startswith("sha1:") or kind not in ("response", "revisit"):
        raise ValueError(f"a {kind} record with digest {digest[:50]}")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest[5:]):
        raise ValueError(f"the payload of {r.headers['warc-record-id']} isn't what its headers say")
    return {"page_id": page_of(r.headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest[5:], "record_type": kind, "refers_to": page_of(r.headers["warc-refers-to"]) if kind == "revisit" else None}
