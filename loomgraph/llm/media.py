"""Media columns: MPEG audio streams stored in a binary column and parsed back.

The writer puts a payload into the ancillary bytes of silent Layer III frames
(MPEG-2, 16 kHz, mono, 144 kbit/s: 648 bytes a frame, 576 of them payload, each
header and side information under a checksum) after an ID3v2 tag and a seek
table frame.  The parser reads any MPEG-1/2/2.5 Layer I-III stream: tags, Xing,
Info and VBRI tables, resynchronisation after damage, checksums of all three layers, the exact
duration as samples over sample rate, and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import written

UNIT = 576
# Fixed values of the MPEG audio header (ISO/IEC 11172-3, 13818-3): kbit/s by index from 1, hertz by index.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_HEAD, _TABLE_HEAD, _SIDE, _FRAME = bytes([0xFF, 0xF2, 0xD8, 0xC0]), bytes([0xFF, 0xF3, 0xD8, 0xC0]), 9, 648


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """Checksum of the protected bytes: polynomial 0x8005 from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, n: int) -> int:
    """The same checksum of the first ``n`` bits."""
    crc = crc16(data[: n // 8])
    for k in range(n - n % 8, n):
        bit = data[k // 8] >> (7 - k % 8) & 1
        crc = (crc << 1 ^ 0x8005 if crc >> 15 ^ bit else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    samples: int
    length: int
    side: int
    bound: int  # the first subband whose allocation both channels share

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.hertz) == (other.version, other.layer, other.hertz)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None; free format and reserved values are not headers."""
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version, layer, rate, hz = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    first, mono, pad = version == 3, four[3] >> 6 == 3, four[2] >> 1 & 1
    kbps, hertz = KBPS[1 if first else 2, layer if first or layer == 1 else 2][rate - 1], HERTZ[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12 * kbps * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbps, hertz, mono, samples, length, side, bound)


def allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation (Layer I: 4 in all 32; Layer II by the standard's tables)."""
    if h.layer == 1:
        return [4] * 32
    if h.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    rate = h.kbps if h.mono else h.kbps // 2
    if rate < 56:
        return [4] * 2 + [3] * (10 if h.hertz == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if rate >= 96 and h.hertz != 48000 else 4)


def checksum(raw: bytes, at: int, h: Header) -> int:
    """The checksum of a protected frame: over the last header bytes and side information, or allocation and selection.

    In Layer II two selection bits follow for each channel of a subband that has an allocation.
    """
    if h.layer == 3:
        return crc16(raw[at + 2 : at + 4] + raw[at + 6 : at + 6 + h.side])
    body, bit, selected = raw[at + 6 : at + h.length], 0, 0
    number = int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    for band, width in enumerate(allocation(h)):
        own = 1 if h.mono or band >= h.bound else 2
        for _ in range(own):
            value = number >> (512 - bit - width) & ((1 << width) - 1)
            bit += width
            selected += (value > 0) * (1 if own == 2 or h.mono else 2)
    bits = 16 + bit + (2 * selected if h.layer == 2 else 0)
    return crc16_bits(raw[at + 2 : at + 4] + body, min(bits, 16 + 8 * len(body)))


@dataclass
class Media:
    """What a stream holds. ``offsets`` are byte positions of audio frames (the table frame is not one)."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    hertz: int = 0
    kbps: set[int] = field(default_factory=set)
    checked: int = 0
    bad_checks: int = 0
    resyncs: int = 0

    def table_agrees(self) -> bool:
        """Whether a table, if there is one, names as many frames as were found."""
        return self.table.get("frames", len(self.offsets)) == len(self.offsets)

    def seek(self, sample: int) -> int:
        """Byte offset of the frame that holds a sample."""
        each = self.samples // len(self.offsets)
        return self.offsets[min(sample // each, len(self.offsets) - 1)]


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(raw: bytes) -> str:
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 9, "latin-1")
    return raw[1:].decode(coding, "replace").rstrip("\0")


def _tags(raw: bytes, out: Media, last: bool) -> tuple[int, int]:
    """Read ID3v2 at the start and, if ``last``, ID3v1 at the end; returns where audio begins and ends."""
    begin, end = 0, len(raw)
    if raw[:3] == b"ID3" and len(raw) >= 10:
        version, flags, size = raw[3], raw[5], _syncsafe(raw[6:10])
        begin = min(end, 10 + size + (10 if version == 4 and flags & 0x10 else 0))  # a footer repeats the header
        body, at, short = raw[10 : 10 + size], 0, version == 2
        if flags & 0x80 and version < 4:  # unsynchronised as a whole: a zero was put after each byte 255
            body = body.replace(b"\xff\x00", b"\xff")
        if flags & 0x40 and not short:  # an extended header comes first
            at = _syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
        while at + (6 if short else 10) <= len(body) and body[at] != 0:
            name = body[at : at + (3 if short else 4)].decode("latin-1")
            size = int.from_bytes(body[at + 3 : at + 6], "big") if short else _syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
            own = 0 if short else body[at + 9]
            at += 6 if short else 10
            value = body[at : at + size]
            if version == 4 and own & 1:  # a length before the data
                value = value[4:]
            if version == 4 and (own & 2 or flags & 0x80):
                value = value.replace(b"\xff\x00", b"\xff")
            if name[:1] == "T":
                key, _, text = _text(value).partition("\0") if name in ("TXXX", "TXX") else (name, "", _text(value))
                out.tags[key] = text
            at += size
    if last and end - begin >= 128 and raw[-128:-125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := raw[end + a : end + b].rstrip(b"\0 ").decode("latin-1"):
                out.tags.setdefault(name, value)
    return begin, end


def _table(raw: bytes, at: int, h: Header) -> dict[str, object]:
    """The Xing, Info or VBRI table of a frame, or nothing."""
    x = at + 4 + 2 * h.protected + h.side
    if raw[x : x + 4] in (b"Xing", b"Info"):
        flags, x, out = int.from_bytes(raw[x + 4 : x + 8], "big"), x + 8, {"kind": raw[x : x + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], x = int.from_bytes(raw[x : x + 4], "big"), x + 4
        return out | ({"toc": list(raw[x : x + 100])} if flags & 4 else {})
    x = at + 36
    if raw[x : x + 4] == b"VBRI" and at + h.length >= x + 26:
        n_bytes, frames, entries, scale, size, _ = struct.unpack_from(">IIHHHH", raw, x + 10)
        steps = [int.from_bytes(raw[x + 26 + k * size : x + 26 + (k + 1) * size], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "steps": steps}
    return {}


def parse(raw: bytes) -> Media:
    """Read a stream; the last 128 bytes are an ID3v1 tag if they look like one and no frame covers their beginning."""
    if raw[-128:-125] == b"TAG":
        out = _parse(raw, False)
        p = out.offsets[-1] if out.offsets else 0
        if out.offsets and p < len(raw) - 128 < p + header(raw[p : p + 4]).length:
            return out
    return _parse(raw, True)


def _parse(raw: bytes, last: bool) -> Media:
    """Read a stream. Bytes that are no frame are skipped to the next header whose checksum and successor agree."""
    out = Media()
    at, end = _tags(raw, out, last)
    kind: Header | None = None

    def frame(p: int) -> tuple[Header, bool] | None:
        h = header(raw[p : p + 4])
        if h is None or p + h.length > end or kind is not None and not h.like(kind):
            return None
        return h, not h.protected or checksum(raw, p, h) == int.from_bytes(raw[p + 4 : p + 6], "big")

    lost = False
    while at < end:
        got = frame(at)
        if got is not None and (lost or kind is None):  # after a gap: the checksum and the next header must agree
            then = header(raw[at + got[0].length : at + got[0].length + 4])
            if not got[1] or at + got[0].length != end and (then is None or not then.like(got[0])):
                got = None
        if got is None:
            if not lost:
                out.resyncs, lost = out.resyncs + 1, True
            at = raw.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        h, good = got
        lost = False
        if kind is None:
            kind, out.hertz = h, h.hertz
            if table := _table(raw, at, h):
                out.table = table
                at += h.length
                continue
        if h.protected:
            out.checked += 1
            out.bad_checks += not good
        out.offsets.append(at)
        out.samples += h.samples
        out.kbps.add(h.kbps)
        at += h.length
    return out


def padded(data: bytes) -> bytes:
    """``data`` and as many bytes 255 as make a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def encode(data: bytes) -> bytes:
    """A stream that carries ``padded(data)``."""
    body = np.frombuffer(padded(data), np.uint8).reshape(-1, UNIT)
    n = len(body)
    frames = np.zeros((n, _FRAME), np.uint8)
    side = bytes(_SIDE)
    frames[:, : 6 + _SIDE] = np.frombuffer(_HEAD + crc16(_HEAD[2:] + side).to_bytes(2, "big") + side, np.uint8)
    frames[:, 6 + _SIDE : 6 + _SIDE + UNIT] = body
    total = (n + 1) * _FRAME
    toc = bytes(min(255, 256 * (k * n // 100 + 1) * _FRAME // total) for k in range(100))
    table = _TABLE_HEAD + side + b"Info" + struct.pack(">III", 7, n, total) + toc
    note = b"\x00\x00\x00" + b"n_bytes\x00" + str(len(data)).encode()
    note = b"TXXX" + len(note[2:]).to_bytes(4, "big") + b"\0\0" + note[2:]
    size = len(note)
    tag = b"ID3\x03\x00\x00" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + note
    return tag + table.ljust(_FRAME, b"\0") + frames.tobytes()


def payload(raw: bytes, media: Media) -> bytes:
    """The payload that ``encode`` put into a stream."""
    first = 6 + _SIDE
    return b"".join(raw[p + first : p + first + UNIT] for p in media.offsets)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            media = [encode((t or "").encode()) for t in part.column(1).to_pylist()]
            n = [int.from_bytes(m[10 + _syncsafe(m[6:10]) + 4 + _SIDE + 8 :][:4], "big") for m in media]
            first = [10 + _syncsafe(m[6:10]) + _FRAME for m in media]
            offsets = [[a + _FRAME * i for i in range(c)] for a, c in zip(first, n)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(media, pa.binary()), pa.array([c * 576 * 1_000_000_000 // 16000 for c in n], pa.int64()), pa.array(offsets, pa.list_(pa.int64()))],
                names=["doc_id", "media", "duration_ns", "seek_offsets"],
            )


_FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, samples long, hertz int, duration_ns long, crc_checked long, crc_bad long, resyncs long, seek_offsets array<long>, stored_agrees boolean, tags map<string,string>, feature string"


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            rows: list[tuple] = []
            for raw, told_ns, told in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                m = parse(raw)
                data = payload(raw, m)
                ns = m.samples * 1_000_000_000 // m.hertz if m.hertz else 0
                feature = f"{m.table.get('kind', '-')}:{m.table.get('frames', 0)}{'' if m.table_agrees() else '!'};frames={len(m.offsets)};samples={m.samples}/{m.hertz};kbps={'+'.join(map(str, sorted(m.kbps)))};crc={m.checked - m.bad_checks}/{m.checked};resyncs={m.resyncs};seek={zlib.crc32(np.array(m.offsets, '<i8').tobytes())}"
                rows.append((len(data.rstrip(b"\xff")), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), len(m.offsets), m.samples, m.hertz, ns, m.checked, m.bad_checks, m.resyncs, m.offsets, told_ns == ns and told == m.offsets, list(m.tags.items()), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.string()]
            names = [f.split()[0] for f in _FIELDS.replace("map<string,string>", "map").split(", ")]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write (doc_id, media, duration_ns, seek_offsets) for every row to the shared folder; equal texts, equal bytes.

    A null text is an empty payload, repeated rows repeat, an empty table stores no rows, a text of any length is one
    stream (a row at a time is held), and other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_store, "doc_id long, media binary, duration_ns long, seek_offsets array<long>"))


def features(media: DataFrame) -> DataFrame:
    """Parse each stored stream: sizes, digests, exact duration, checks, seek offsets, tags and a feature line.

    ``stored_agrees`` tells whether the stored duration and offsets are those found. An empty table gives no rows.
    """
    ship(media.sparkSession)
    return media.select("doc_id", "media", "duration_ns", "seek_offsets").mapInArrow(_load, _FIELDS)
