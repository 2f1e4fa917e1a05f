"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is a row of frames and, last, a skippable frame with
the seek table (sizes of all frames), as in the seekable format's specification. An index maps each record's identifier to its
frame and the offset inside it, so one record costs one frame. Bundles are rows of a Parquet table in the shared folder:
Spark's commit keeps exactly one copy of each, whichever tasks or executors fail.

Of records with equal payloads of MIN_REVISIT bytes or more, the smallest page_id is stored whole; the others are `revisit`
records with the digest, the length and the identifier of the first.

Defined results: a null html counts as empty; payloads below MIN_REVISIT bytes are always stored; a null page_id is never
the smallest, and if nothing of a group has an id, all are responses; a row repeated whole is the same record twice, and
keeps its type; a record of any size is stored whole, if need be as a frame and a bundle of its own; line breaks in a url are
escaped; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, shared_table

MIN_REVISIT = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of WARC 1.1: the profile of a revisit record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "array<struct<record_id: string, frame: int, offset: long, length: long>>"


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}:{digest[:16]}"


def page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return int(page) if page else None


def record(page_id: int | None, url: str | None, digest: str, length: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP head alone, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = payload is None
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    block = http if revisit else http + payload
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    return fields, block


class BundleWriter:
    """Collects records into frames; close() gives the bundle and the index."""

    def __init__(self) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.total = 0
        self.index: list[dict] = []

    def add(self, identifier: str, data: bytes) -> None:
        if self.open and self.filled + len(data) > FRAME_BYTES:
            self._flush()
        self.index.append({"record_id": identifier, "frame": len(self.frames), "offset": self.filled, "length": len(data)})
        self.open.append(data)
        self.filled += len(data)
        self.total += len(data)

    def _flush(self) -> None:
        frame = self.compressor.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.filled))
        self.open, self.filled = [], 0

    def close(self) -> bytes:
        if self.open:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table)), table])


class BundleReader:
    """Random access by the seek table at the end; keeps the frame that was read last."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        self.data, self.decompressor = data, zstandard.ZstdDecompressor()
        count, descriptor, magic = struct.unpack("<IBI", data[-9:])
        entry = 12 if descriptor & 0x80 else 8
        start = len(data) - 9 - count * entry
        if magic != SEEKABLE or start < 8 or struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE, count * entry + 9):
            raise ValueError("no seek table")
        self.at, self.sizes = [0], []
        for i in range(count):
            packed, size = struct.unpack_from("<II", data, start + i * entry)
            self.at.append(self.at[-1] + packed)
            self.sizes.append(size)
        if self.at[-1] != start - 8:
            raise ValueError("seek table and frames disagree")
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            out = self.decompressor.decompress(self.data[self.at[i] : self.at[i + 1]])
            if len(out) != self.sizes[i]:
                raise ValueError(f"frame {i} has another size than the seek table says")
            self.last = (i, out)
        return self.last[1]

    def read(self, frame: int, offset: int, length: int) -> bytes:
        data = self.frame(frame)[offset : offset + length]
        if len(data) != length:
            raise ValueError("record lies outside its frame")
        return data


def described(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload_digest, payload_bytes, refers_to, and the html where it must be stored."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest"))
    # Groups of one need no join partner; the rest come down to one narrow row each before anything is moved.
    firsts = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    firsts = cut(firsts)  # so that the join is of two plain exchanges, which can split a hot payload
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "payload_digest", "left").select("page_id", "url", "payload_digest", "payload_bytes", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"))


def bundles(rows: DataFrame) -> DataFrame:
    """(data, records): one row for each bundle of described rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))

        def closed(writer: BundleWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.large_binary()).cast(pa.binary()), pa.array([writer.index], kind)], names=["data", "records"])

        writer = BundleWriter()
        for batch in batches:
            for page, url, digest, length, refers, html in zip(*(batch.column(c) for c in ("page_id", "url", "payload_digest", "payload_bytes", "refers_to", "html")), strict=True):
                page, digest = page.as_py(), digest.as_py()
                payload = html.as_buffer().to_pybytes() if html.is_valid else None
                writer.add(record_id(page, digest), record(page, url.as_py(), digest, length.as_py(), payload, refers.as_py()))
                if writer.total >= BUNDLE_BYTES:
                    yield closed(writer)
                    writer = BundleWriter()
        if writer.index:
            yield closed(writer)

    return rows.mapInArrow(run, f"data binary, records {INDEX}")


def write_archives(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all rows as bundles into the shared folder; the table of bundles, read back."""
    return shared_table(df.sparkSession, bundles(described(df, page_id, url, html)), "warc")


def read_archives(table: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, found by the index and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, records in zip(batch.column("data"), batch.column("records"), strict=True):
                bundle, out = BundleReader(data.as_buffer().to_pybytes()), []
                for entry in records.as_py():
                    fields, block = parse(bundle.read(entry["frame"], entry["offset"], entry["length"]))
                    identifier = fields["warc-record-id"].strip("<>")
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = int(head.decode().lower().partition("content-length:")[2].split("\r\n")[0])
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                    if identifier != entry["record_id"] or kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record {entry['record_id']} is damaged")
                    out.append((page_of(identifier), length, digest, kind, page_of(fields["warc-refers-to"].strip("<>")) if kind == "revisit" else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return table.select("data", "records").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back."""
    return read_archives(write_archives(read(spark, sf_dir, "pages")))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
