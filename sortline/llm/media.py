"""MPEG audio media columns.

Writes payload bytes into the data part of MPEG audio frames (layer III, with checksums, an ID3v2 tag and a variable-bitrate
table in front) and reads such streams back: it finds frame headers anew after junk, parses tags and tables, verifies the
checksum of every frame and gives the exact duration and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the MPEG audio format: bitrates in kbit/s by (version 1 or not, layer) and index, sampling rates by version bits and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: Payload bytes in a frame.
UNIT = 192
#: MPEG 1, layer III, checksum present, 80 kbit/s, 48 kHz, mono: 240 bytes and 1152 samples a frame.
HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))
SIDE = bytes(17)
SEEK_POINTS = 100


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        r = n << 8
        for _ in range(8):
            r = (r << 1) ^ (0x8005 if r & 0x8000 else 0)
        table.append(r & 0xFFFF)
    return table


CRC = _crc_table()


def crc16(data: bytes, r: int = 0xFFFF) -> int:
    for b in data:
        r = (r << 8 & 0xFFFF) ^ CRC[(r >> 8) ^ b]
    return r


@dataclass(frozen=True)
class Header:
    layer: int
    rate: int
    samples: int
    length: int
    side: int
    protected: bool

    @property
    def data_at(self) -> int:
        return 4 + 2 * self.protected + self.side


_HEADERS: dict[bytes, Header | None] = {}


def parse_header(h: bytes) -> Header | None:
    """A frame header, or None where four bytes aren't one. Free-format frames aren't read."""
    if h in _HEADERS:
        return _HEADERS[h]
    out = None
    if len(h) == 4 and h[0] == 0xFF and h[1] >= 0xE0:
        version, layer = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3)
        rate_at, bits = h[2] >> 2 & 3, h[2] >> 4
        if version != 1 and layer != 4 and rate_at != 3 and 0 < bits < 15 and h[3] & 3 != 2:
            one, rate, pad = version == 3, RATES[version][rate_at], h[2] >> 1 & 1
            kbit, mono = BITRATES[one, layer][bits], h[3] >> 6 == 3
            samples = 384 if layer == 1 else 1152 if one or layer == 2 else 576
            length = (12000 * kbit // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // rate + pad
            side = ((17 if mono else 32) if one else (9 if mono else 17)) if layer == 3 else 0
            out = Header(layer, rate, samples, length, side, not h[1] & 1)
    if len(_HEADERS) < 4096:
        _HEADERS[h] = out
    return out


@dataclass
class Audio:
    """What a stream holds. offsets: of every audio frame; the frame that holds the variable-bitrate table isn't one."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, int] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    seconds: Fraction = Fraction(0)
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    data: bytes = b""


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    if data[:3] != b"ID3" or len(data) < 10 or (end := 10 + _synchsafe(data[6:10])) > len(data):
        return {}, 0
    at, tags = 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        size = _synchsafe(data[at + 4 : at + 8]) if data[3] > 3 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : min(end, at + 10 + size)]
        if data[at : at + 1] == b"T" and body:
            tags[data[at : at + 4].decode()] = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
        at += 10 + size
    return tags, end


def _vbr(frame: bytes, h: Header) -> dict[str, int]:
    """A Xing, Info or VBRI table of frames, bytes and seek points."""
    for at in (4 + h.side, h.data_at):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8]), at + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(frame[at : at + 4]), at + 4
            return out | {"points": SEEK_POINTS * bool(flags & 4)}
    if frame[36:40] == b"VBRI" and len(frame) >= 58:
        return {"bytes": int.from_bytes(frame[46:50]), "frames": int.from_bytes(frame[50:54]), "points": int.from_bytes(frame[54:56])}
    return {}


def read(data: bytes, unit: int = UNIT) -> Audio:
    """Read a stream. A header counts if the next frame's header, or the end, follows at its length; else the next sync byte is
    tried and what lies between is skipped. data: the first `unit` bytes of each frame's data part, in order."""
    out, parts = Audio(), []
    out.tags, at = _tags(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    if end < len(data):
        out.tags["ID3v1"] = data[end + 3 : end + 33].decode("latin-1").rstrip(" \0")
    known = False  # whether the frame before ended here
    times: dict[int, int] = {}
    while at < end:
        h = parse_header(data[at : at + 4])
        to = at + h.length if h else 0
        if not h or to > end or not known and to < end and not parse_header(data[to : to + 4]):
            known, to = False, data.find(b"\xff", at + 1, end)
            out.skipped += (end if to < 0 else to) - at
            at = end if to < 0 else to
            continue
        frame, known = data[at:to], True
        if not out.offsets and not out.vbr and (table := _vbr(frame, h)):
            out.vbr, at = table, to
            continue
        if h.protected and h.layer == 3:
            out.checked += 1
            out.bad += crc16(frame[2:4] + frame[6 : 6 + h.side]) != int.from_bytes(frame[4:6])
        out.offsets.append(at)
        times[h.rate] = times.get(h.rate, 0) + h.samples
        parts.append(frame[h.data_at : h.data_at + unit])
        at = to
    out.seconds = sum((Fraction(n, rate) for rate, n in times.items()), Fraction(0))
    out.data = b"".join(parts)
    return out


def write(payload: bytes, title: str = "text") -> bytes:
    """An MPEG audio stream whose frames carry payload, 192 bytes each: ID3v2.4 tag, Info frame, audio frames."""
    h = parse_header(HEADER)
    start = HEADER + crc16(HEADER[2:] + SIDE).to_bytes(2) + SIDE
    rest = bytes(h.length - len(start) - UNIT)
    frames = len(payload) // UNIT
    text = b"\3" + title.encode()
    tag = b"TIT2" + struct.pack(">I", len(text)) + b"\0\0" + text
    head = b"ID3\4\0\0" + struct.pack(">I", len(tag)) + tag
    toc = bytes(256 * k // SEEK_POINTS for k in range(SEEK_POINTS))
    info = start + b"Info" + struct.pack(">III", 7, frames, h.length * (frames + 1)) + toc
    return b"".join([head, info.ljust(h.length, b"\0"), *(x for k in range(0, len(payload), UNIT) for x in (start, payload[k : k + UNIT], rest))])


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


MEDIA = (
    "doc_id {id}, n_bytes long, media binary, payload binary, frames long, duration_num long, duration_den long, "
    "offsets array<long>, checked long, bad long, skipped long, vbr_frames long, vbr_bytes long, title string"
)


def _stored(text: str | None) -> tuple[bytes, bytes, Audio]:
    """A text's bytes, its stream, and what is read from that."""
    data = (text or "").encode()
    media = write(pad(data))
    return data, media, read(media)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row's text (UTF-8, null as empty, padded with blanks to a positive multiple of 192) stored as MPEG audio and read back.

    Columns: doc_id, n_bytes (of the text), media (the stream), payload (as read back), frames, duration_num / duration_den
    (seconds as an exact fraction), offsets (of every audio frame), checked and bad (checksums), skipped (bytes between
    frames), vbr_frames and vbr_bytes (from the table), title (from the tag). Repeated rows and ids give a row each; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = MEDIA.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a row a batch: texts can be very long
                data, media, a = _stored(b.column(1)[k].as_py())
                row = (len(data), media, a.data, len(a.offsets), a.seconds.numerator, a.seconds.denominator, a.offsets, a.checked, a.bad, a.skipped, a.vbr.get("frames"), a.vbr.get("bytes"), a.tags.get("TIT2"))
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 5, pa.string())
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *(pa.array([x], t) for x, t in zip(row, types))], names)

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What to_media() gives, as digests made where the stream is, so that streams needn't leave their task: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature (frames, duration, checks, table and a digest of the seek offsets)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                data, media, a = _stored(t.as_py())
                seek = hashlib.sha256(struct.pack(f">{len(a.offsets)}q", *a.offsets)).hexdigest()[:16]
                feature = f"frames={len(a.offsets)};seconds={a.seconds.numerator}/{a.seconds.denominator};crc={a.checked - a.bad}/{a.checked};skipped={a.skipped};table={a.vbr.get('frames')},{a.vbr.get('bytes')};first={a.offsets[0]};last={a.offsets[-1]};seek={seek}"
                rows.append((len(data), len(a.data), hashlib.sha256(a.data).hexdigest(), zlib.crc32(a.data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types))], names)

    kinds = "long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes {kinds}")
