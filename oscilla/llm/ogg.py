"""Media columns as Ogg: writer, verified reader, and features of the read-back samples.

A value is stored as one physical Ogg stream that multiplexes two logical ones: `audio`, with the payload as unsigned
8-bit samples, and `notes`, with the payload's digest. Each page has a checksum, each packet is cut into lacing values,
and granule positions count samples, from which the reader derives timestamps.

Defined results: a null text counts as empty; an empty text is stored as 64 zero bytes; a text of any length is stored
whole, in as many pages as it needs; equal texts give equal bytes, since serial numbers follow from the payload; extra
columns and repeated rows pass through untouched, but for columns named like the added ones, which give way; an empty
table gives an empty table. A damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import large_binary, read, slices, without

#: Fixed values of the Ogg container (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1
MOST_SEGMENTS = 255

#: Bytes (samples) of a data packet; pages are filled with packets up to their 255 lacing values.
PACKET = 8192
RATE = 8000
BLOCK = 64
_HEAD = struct.Struct("<4sBBqIIIB")
_AUDIO = struct.Struct("<8sBBHIQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0, without final inversion.

    zlib has the same polynomial with the bits the other way round, so bytes and result are reversed."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class _Writer:
    """Collects packets of one logical stream and cuts them into pages."""

    serial: int
    sequence: int = 0
    lacing: list[int] = field(default_factory=list)
    body: list[bytes] = field(default_factory=list)
    granule: int = NO_PACKET_ENDS
    continued: bool = False
    pages: list[bytes] = field(default_factory=list)

    def packet(self, data: bytes, granule: int) -> None:
        sizes = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        while sizes:
            room = MOST_SEGMENTS - len(self.lacing)
            if not room:
                self.flush()
                self.continued = at > 0
                continue
            take, sizes = sizes[:room], sizes[room:]
            n = sum(take)
            self.lacing += take
            self.body.append(data[at : at + n])
            at += n
            if not sizes:
                self.granule = granule

    def flush(self, flags: int = 0) -> None:
        flags |= CONTINUED * self.continued | FIRST * (self.sequence == 0)
        head = _HEAD.pack(CAPTURE, 0, flags, self.granule, self.serial, self.sequence, 0, len(self.lacing)) + bytes(self.lacing)
        page = head + b"".join(self.body)
        self.pages.append(page[:22] + struct.pack("<I", page_checksum(page)) + page[26:])
        self.sequence += 1
        self.lacing, self.body, self.granule, self.continued = [], [], NO_PACKET_ENDS, False


def encode(payload: bytes) -> bytes:
    """The payload as an Ogg stream; its bytes depend on the payload alone."""
    digest = hashlib.sha256(payload).digest()
    serial = int.from_bytes(digest[:4], "little")
    audio, notes = _Writer(serial), _Writer(serial ^ 0xFFFFFFFF)
    audio.packet(_AUDIO.pack(b"OSCPCM8\0", 1, 1, 8, RATE, len(payload)), 0)
    audio.flush()
    notes.packet(b"OSCNOTE\0", 0)
    notes.flush()
    notes.packet(digest, len(payload))
    notes.flush(LAST)
    heads = len(audio.pages)
    for at in range(0, len(payload), PACKET):
        audio.packet(payload[at : at + PACKET], min(len(payload), at + PACKET))
    audio.flush(LAST)
    # Both first pages come before any other; then the streams take turns.
    return b"".join([audio.pages[0], notes.pages[0], *audio.pages[heads:-1], *notes.pages[1:], audio.pages[-1]])


@dataclass
class Stream:
    """One logical stream as read: its packets, the granule position of each page that ends a packet, its pages."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Reads every page, verifies its checksum and order, and joins packets from lacing values, for each serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError(f"page header cut off at byte {at}")
        capture, version, flags, granule, serial, sequence, checksum, segments = _HEAD.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise ValueError(f"no Ogg page at byte {at}")
        lacing = media[at + _HEAD.size : at + _HEAD.size + segments]
        end = at + _HEAD.size + segments + sum(lacing)
        if len(lacing) < segments or end > len(media):
            raise ValueError(f"page cut off at byte {at}")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != checksum:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = Stream()
        stream = streams.get(serial)
        if stream is None or stream.ended or sequence != stream.pages or bool(flags & CONTINUED) != bool(stream.open):
            raise ValueError(f"page at byte {at} is out of order")
        body, ended = at + _HEAD.size + segments, False
        first = body
        for size in lacing:
            body += size
            if size < 255:
                packet = media[first:body]
                stream.packets.append(b"".join([*stream.open, packet]) if stream.open else packet)
                stream.open, first, ended = [], body, True
        if first < body or (lacing and lacing[-1] == 255):
            stream.open.append(media[first:body])
        if ended != (granule != NO_PACKET_ENDS):
            raise ValueError(f"granule position of the page at byte {at}")
        if ended:
            if stream.granules and granule < stream.granules[-1]:
                raise ValueError(f"granule position runs back at byte {at}")
            stream.granules.append(granule)
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise ValueError("a stream does not end")
    return streams


@dataclass
class Decoded:
    payload: bytes
    pages: int
    packets: int
    seconds: list[float]


def decode(media: bytes) -> Decoded:
    """The samples, and the time in seconds at the end of each page, from granule positions."""
    streams = demultiplex(media)
    audio = [s for s in streams.values() if s.packets[0][:8] == b"OSCPCM8\0"]
    notes = [s for s in streams.values() if s.packets[0][:8] == b"OSCNOTE\0"]
    if len(audio) != 1 or len(notes) != 1:
        raise ValueError("one audio and one note stream are needed")
    _, _, _, _, rate, total = _AUDIO.unpack(audio[0].packets[0])
    payload = b"".join(audio[0].packets[1:])
    if len(payload) != total or audio[0].granules[-1] != total or hashlib.sha256(payload).digest() != notes[0].packets[1]:
        raise ValueError("samples and header disagree")
    return Decoded(payload, sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()), [g / rate for g in audio[0].granules])


def features(found: Decoded) -> str:
    """Container and signal features: pages, packets, duration, mean, power, crossings of the middle, peak."""
    x = np.frombuffer(found.payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"ogg;pages={found.pages};packets={found.packets};seconds={found.seconds[-1]:.6f};mean={x.mean():.6f};power={(x * x).mean():.6f};crossings={crossings};peak={int(np.abs(x).max())}"


def padded(text: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


FIELDS = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def _store(text: bytes) -> bytes:
    return encode(padded(text))


def store_media(df: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Adds the Ogg bytes of each text and the text's own length in bytes; no shuffle, one run of rows at a time."""
    df = without(df, media, n_bytes)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                values = [v.as_buffer().to_pybytes() for v in large_binary(part.column(text)).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_store(v) for v in values], pa.binary()), pa.array([len(v) for v in values], pa.int64())], names=[*part.schema.names, media, n_bytes])

    kinds = T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType()), T.StructField(n_bytes, T.LongType())])
    return df.mapInArrow(run, kinds)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the Ogg column back and adds what FIELDS names, but for n_bytes, as a struct `read`."""
    name, df = "read", without(df, "read")
    kinds = T.StructType([*df.schema.fields, T.StructField(name, T.StructType([f for f in FIELDS if f.name != "n_bytes"]))])

    def one(stored: bytes) -> dict:
        found = decode(stored)
        return {
            "payload_bytes": len(found.payload), "payload_sha256": hashlib.sha256(found.payload).hexdigest(), "tail_crc32": zlib.crc32(found.payload[-BLOCK:]),
            "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": features(found),
        }

    def run(batches):
        for batch in batches:
            for part in slices(batch, media, 4 << 20):
                made = [one(v.as_py()) for v in part.column(media)]
                kind = pa.struct([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in FIELDS if f.name != "n_bytes"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, kind)], names=[*part.schema.names, name])

    return df.mapInArrow(run, kinds)


def op4_media_ogg(spark, sf_dir: str) -> DataFrame:
    """Every document through Ogg and back."""
    stored = store_media(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "media", "n_bytes")
    return read_media(stored).select("doc_id", "n_bytes", *(F.col(f"read.{f.name}").alias(f.name) for f in FIELDS if f.name != "n_bytes"))
