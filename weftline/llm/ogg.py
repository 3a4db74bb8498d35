"""Ogg as a media column: payloads are stored as pages of logical streams, and read back page by page.

The writer gives each payload two logical streams: 8-bit samples in packets of a fixed size, and one packet of notes.
Their pages are multiplexed. The reader verifies each page's checksum, reassembles packets from the lacing values (also
across pages), separates the streams by serial number, and derives times from granule positions, which count samples.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare

# Fixed values of the format: capture pattern, header layout, flags.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MOST_SEGMENTS, FULL = 255, 255

SAMPLES, NOTES = 1, 2
RATE, PACKET = 8_000, 4_000
HEAD = struct.Struct("<8sII")
MAGIC = b"PCM8\0\0\0\1"
BLOCK = 64

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, not reflected, from 0, without a final inversion.

    That is the mirror image of zlib's CRC of the mirrored bytes, freed of its inversions.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    draft = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return draft[:22] + checksum(draft).to_bytes(4, "little") + draft[26:]


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream from its packets and the granule position at the end of each.

    The first packet has a page of its own, as the first of a stream must. A page on which no packet ends has the
    granule position -1.
    """
    out: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    def flush(last: bool = False):
        nonlocal lacing, body, granule, flags
        out.append(_page(flags | (FIRST if not out else 0) | (LAST if last else 0), granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    for k, (packet, position) in enumerate(packets):
        values = bytes([FULL]) * (len(packet) // FULL) + bytes([len(packet) % FULL])
        at = 0
        while values:
            if len(lacing) == MOST_SEGMENTS:
                flush()
                flags = CONTINUED if at else 0
            taken = values[: MOST_SEGMENTS - len(lacing)]
            values = values[len(taken) :]
            lacing += taken
            body += packet[at : at + sum(taken)]
            at += sum(taken)
        granule = position
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1)
    return out


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """Zero bytes up to a positive multiple of the block."""
    return data + bytes(max(block, -(-len(data) // block) * block) - len(data))


def write(data: bytes) -> bytes:
    """The Ogg file of the data: its samples, padded, and its true length among the notes."""
    payload = pad(data)
    packets = [(HEAD.pack(MAGIC, RATE, PACKET), 0)]
    packets += [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    samples = pages(SAMPLES, packets)
    notes = pages(NOTES, [(b"NOTES\0\0\1", 0), (json.dumps({"bytes": len(data)}).encode(), 0)])
    # All first pages come before any other; the notes follow the first samples.
    return b"".join([samples[0], notes[0], *samples[1:2], *notes[1:], *samples[2:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: Granule position by packet; only the last packet that ends on a page has one, the others None.
    granules: list[int | None] = field(default_factory=list)
    open: bytearray = field(default_factory=bytearray)
    next_page: int = 0
    ended: bool = False

    def seconds(self, rate: int = RATE) -> list[float | None]:
        return [None if g is None else g / rate for g in self.granules]


def read(media: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number; ValueError where a page is damaged, missing or cut short."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) < at + HEADER.size:
            raise ValueError(f"cut short at {at}")
        capture, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + count]
        start = at + HEADER.size + count
        end = start + sum(lacing)
        if capture != CAPTURE or version or len(lacing) < count or end > len(media):
            raise ValueError(f"no page at {at}")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum differs at {at}")
        if flags & FIRST:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = Stream()
        stream = streams.get(serial)
        if stream is None or stream.next_page != number or stream.ended:
            raise ValueError(f"a page of stream {serial} is missing before {at}")
        if bool(flags & CONTINUED) != bool(stream.open):
            raise ValueError(f"a packet of stream {serial} is broken at {at}")
        stream.next_page += 1
        done = len(stream.packets)
        for value in lacing:
            stream.open += media[start : start + value]
            start += value
            if value < FULL:
                stream.packets.append(bytes(stream.open))
                stream.granules.append(None)
                stream.open = bytearray()
        if len(stream.packets) > done:
            stream.granules[-1] = granule
        stream.ended = bool(flags & LAST)
        at = end
    return streams


def payload_of(streams: dict[int, Stream]) -> tuple[bytes, int, float]:
    """Samples, the data's true length, and the time at the last granule position."""
    magic, rate, _ = HEAD.unpack(streams[SAMPLES].packets[0])
    if magic != MAGIC:
        raise ValueError("no stream of samples")
    times = [t for t in streams[SAMPLES].seconds(rate) if t is not None]
    return b"".join(streams[SAMPLES].packets[1:]), json.loads(streams[NOTES].packets[1])["bytes"], times[-1]


def feature(payload: bytes, seconds: float) -> str:
    """Seconds, mean, root mean square about it, and crossings of 128 per thousand samples."""
    x = np.frombuffer(payload, np.uint8)
    mean = float(x.mean())
    rms = float(np.sqrt(max(0.0, float((x.astype(np.float32) ** 2).mean(dtype=np.float64)) - mean * mean)))
    crossings = int(np.count_nonzero((x[1:] > 127) != (x[:-1] > 127)))
    return f"s={seconds:.6f};mean={mean:.4f};rms={rms:.4f};zc={1000 * crossings / len(x):.3f}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (binary), the Ogg form of each text in UTF-8. Null counts as empty: one block of zeros.

    Every row gives a row, repeated ones too; other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        for batch in batches:
            media = pa.array([write(x) for x in batch.column("data").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), media], names=["doc_id", "media"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """What reading the stored bytes back gives, by doc_id. A damaged file is an error; a null one gives nulls."""
    prepare(media.sparkSession)
    rows = media.select("doc_id", "media")

    def one(stored):
        if stored is None:
            return (None,) * 7
        payload, n, seconds = payload_of(read(stored))
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, seconds)

    names = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def run(batches):
        for batch in batches:
            found = list(zip(*map(one, batch.column("media").to_pylist()), strict=True)) or [()] * len(names)
            values = [pa.array(v, pa.int64() if t == "long" else pa.string()) for v, t in zip(found, names.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{k} {t}" for k, t in names.items()))
