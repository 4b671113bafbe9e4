"""Media columns: MPEG audio streams in binary columns.

``store_payload`` keeps bytes losslessly in the ancillary area of silent Layer III frames behind an
ID3v2 tag and an ``Info`` table; ``probe_media`` reads any MPEG audio stream back: it skips tags,
resynchronises on frame headers, parses Xing/Info/VBRI tables, verifies the frame checksums of all
layers and gives the exact duration (samples over rate) and the byte offset of every frame for seeking.

Nulls and empty texts store 192 blanks; texts of any length are stored whole. A stream without any
frame has zero frames, an empty payload, duration 0 and no offsets; a null stream counts as empty.
Frames whose checksum fails are counted, and their bytes still returned. One row out per row in:
rows that repeat an id, or have none, are stored and read like any other; an empty table gives no
rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
BATCH_BYTES = 8 << 20

# Fixed values of the MPEG audio frame format: kbit/s by bitrate index, Hz by rate index,
# samples a frame, side-information bytes.
_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_KBPS[2, 3] = _KBPS[2, 2]
_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
_SIDE = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}

#: Width in bits of the allocation of each subband in Layer II, as (subbands, bits) runs.
_ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2)),
}

#: The stored form: MPEG-1 Layer III, 48 kbit/s, 32 kHz, mono: 216 bytes a frame, of which 193 follow the side information.
_HEADER = bytes((0xFF, 0xFA, 0x38, 0xC0))
_TABLE_HEADER = bytes((0xFF, 0xFB, 0x38, 0xC0))
_FRAME, _BODY = 216, 4 + 2 + 17


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()


def frame_checksums(covered: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of protected bytes (header bytes 3 and 4, then side information)."""
    crc = np.full(len(covered), 0xFFFF, dtype=np.uint32)
    for column in covered.T:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ column]
    return crc


def _bit_checksum(bits: np.ndarray) -> int:
    """CRC-16 of a run of bits that needn't fill whole bytes."""
    crc = 0xFFFF
    for bit in bits.tolist():
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


def _layer2_widths(head: Header, channels: int) -> list[int]:
    """Bits of each subband's allocation: by rate and by bitrate a channel."""
    if head.version != 3:
        table = "low"
    elif head.kbps // channels <= 48:
        table = "d" if head.rate == 32000 else "c"
    else:
        table = "a" if head.rate == 48000 or head.kbps // channels <= 80 else "b"
    return [bits for count, bits in _ALLOCATIONS[table] for _ in range(count)]


def allocation_checksum(frame: np.ndarray, head: Header) -> int:
    """CRC-16 that a Layer I or II frame should carry: header bytes 3 and 4, allocations, and scale factor selections (II)."""
    mode, extension = int(frame[3]) >> 6, int(frame[3]) >> 4 & 3
    channels = 1 if mode == 3 else 2
    widths = [4] * 32 if head.layer == 1 else _layer2_widths(head, channels)
    bound = min(len(widths), 4 * (extension + 1)) if mode == 1 else len(widths)
    bits = np.unpackbits(frame[6 : 6 + 4 * 32])
    at, selections = 0, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            used = bits[at : at + width].any()
            selections += int(used) * (1 if band < bound else channels)
            at += width
    at += 2 * selections if head.layer == 2 else 0
    return _bit_checksum(np.concatenate([np.unpackbits(frame[2:4]), bits[:at]]))


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    rate: int
    length: int
    samples: int
    side: int
    protected: bool
    kbps: int

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.rate


_HEADERS: dict[bytes, Header | None] = {}


def read_header(four: bytes) -> Header | None:
    """The frame that four bytes announce; None if reserved, free-format or no sync word."""
    if four not in _HEADERS:
        if len(_HEADERS) > 65536:
            _HEADERS.clear()
        _HEADERS[four] = _decode_header(four)
    return _HEADERS[four]


def _decode_header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    lsf = 1 if version == 3 else 2
    hz, bps, samples = _HZ[version][rate], _KBPS[lsf, layer][bitrate] * 1000, _SAMPLES[lsf, layer]
    length = (12 * bps // hz + padding) * 4 if layer == 1 else samples // 8 * bps // hz + padding
    side = _SIDE[lsf, four[3] >> 6 == 3] if layer == 3 else 0
    return Header(version, layer, hz, length, samples, side, not four[1] & 1, bps // 1000)


@dataclass
class Probe:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    samples: int = 0
    rate: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    bodies: list[np.ndarray] = field(default_factory=list)


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads the tag at ``at`` and returns where it ends."""
    end = at + 10 + _syncsafe(data[at + 6 : at + 10]) + 10 * bool(data[at + 5] & 0x10)
    pos = at + 10
    while pos + 10 <= min(end, len(data)) and data[pos : pos + 4].isalnum():
        size = _syncsafe(data[pos + 4 : pos + 8]) if data[at + 3] >= 4 else int.from_bytes(data[pos + 4 : pos + 8], "big")
        value = data[pos + 10 : pos + 10 + size]
        if data[pos : pos + 1] == b"T" and value:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            tags[data[pos : pos + 4].decode("latin-1")] = value[1:].decode(code, "replace").rstrip("\0")
        pos += 10 + size
    return min(end, len(data))


def _vbr_table(frame: bytes, head: Header) -> dict[str, int] | None:
    for at in (4 + head.side, 4 + 2 + head.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags = int.from_bytes(frame[at + 4 : at + 8], "big")
            out, pos = {"flags": flags}, at + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[pos : pos + 4], "big")
                    pos += 4
            if flags & 4:
                out["toc_crc"] = zlib.crc32(frame[pos : pos + 100])
            return out
    if frame[36:40] == b"VBRI":
        number = lambda at, n=2: int.from_bytes(frame[at : at + n], "big")
        entries, size = number(54), number(58)
        return {"bytes": number(46, 4), "frames": number(50, 4), "frames_an_entry": number(60), "toc_crc": zlib.crc32(frame[62 : 62 + entries * size])}
    return None


def probe(data: bytes) -> Probe:
    """Reads a whole MPEG audio stream; runs of frames with one header are read together."""
    out, view, pos, offsets = Probe(), np.frombuffer(data, dtype=np.uint8), 0, []
    end = len(data)
    kind, table_open = None, True
    while pos < end:
        if data[pos : pos + 3] == b"ID3" and pos + 10 <= end:
            pos = _id3v2(data, pos, out.tags)
            continue
        if end - pos == 128 and data[pos : pos + 3] == b"TAG":  # looked for behind the frames alone: a frame may hold these bytes
            out.tags["TIT1"] = data[pos + 3 : pos + 33].rstrip(b"\0 ").decode("latin-1")
            break
        head = read_header(data[pos : pos + 4])
        if head and pos + head.length <= end:
            after = data[pos + head.length : pos + head.length + 4]
            follows = pos + head.length == end or after[:3] in (b"ID3", b"TAG") or ((n := read_header(after)) and n.kind == head.kind)
            if kind is not None and head.kind == kind or follows:
                kind = kind or head.kind
                if table_open and (table := _vbr_table(data[pos : pos + head.length], head)) is not None:
                    out.table, table_open = table, False
                    pos += head.length
                    continue
                table_open = False
                whole = view[pos : pos + (end - pos) // head.length * head.length].reshape(-1, head.length)
                same = (whole[:, :4] == whole[0, :4]).all(axis=1)
                run = whole if same.all() else whole[: int(np.argmin(same))]
                offsets.append(pos + head.length * np.arange(len(run), dtype=np.int64))
                out.samples += head.samples * len(run)
                out.rate = out.rate or head.rate
                body = 4 + 2 * head.protected + head.side
                if head.protected and head.layer == 3:
                    covered = np.concatenate([run[:, 2:4], run[:, 6:body]], axis=1)
                    told = run[:, 4].astype(np.uint32) << 8 | run[:, 5]
                    out.checked += len(run)
                    out.failed += int((frame_checksums(covered) != told).sum())
                elif head.protected:
                    out.checked += len(run)
                    out.failed += sum(allocation_checksum(f, head) != (int(f[4]) << 8 | int(f[5])) for f in run)
                out.bodies.append(run[:, body:])
                pos += head.length * len(run)
                continue
        nxt = data.find(b"\xff", pos + 1, end)
        nxt = end if nxt < 0 else nxt
        out.skipped += nxt - pos
        pos = nxt
    if offsets:
        out.offsets = np.concatenate(offsets)
    return out


def pad_payload(text: bytes) -> bytes:
    """Blanks up to a positive multiple of ``UNIT``."""
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def encode(payload: bytes) -> bytes:
    """A stream whose silent frames carry ``payload`` (a positive multiple of ``UNIT``)."""
    n = len(payload) // UNIT
    frames = np.zeros((n, _FRAME), dtype=np.uint8)
    frames[:, :4] = np.frombuffer(_HEADER, dtype=np.uint8)
    crc = int(frame_checksums(np.concatenate([frames[:1, 2:4], frames[:1, 6:_BODY]], axis=1))[0])
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    frames[:, _BODY : _BODY + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    toc = bytes(256 * i // 100 for i in range(100))
    table = _TABLE_HEADER + bytes(17) + b"Info" + struct.pack(">III", 7, n, (n + 1) * _FRAME) + toc
    length = b"\x03" + str(n * 1152 * 1000 // 32000).encode()
    tag = b"TLEN" + struct.pack(">I", len(length)) + b"\0\0" + length
    return b"ID3\x04\0\0" + struct.pack(">I", len(tag)) + tag + table.ljust(_FRAME, b"\0") + frames.tobytes()


def stored_bytes(found: Probe) -> bytes:
    """What ``encode`` stored."""
    return b"".join(np.ascontiguousarray(b[:, :UNIT]).tobytes() for b in found.bodies)


def _rebatch(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``BATCH_BYTES``, so that long rows don't pile up."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def store_payload(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes in an MPEG stream. Other columns are left behind."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                    media = encode(pad_payload(raw))
                    yield (i, len(raw), media), len(media)

        yield from _rebatch(rows(), schema)

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


_PROBE_DDL = (
    "id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, frames long, samples long, rate int, "
    "duration_us long, crc_checked long, crc_failed long, skipped_bytes long, table_frames long, seek_offsets array<long>"
)


def probe_media(df: DataFrame, id_col: str, media_col: str, n_bytes_col: str) -> DataFrame:
    """The payload, exact duration, checksum counts and frame seek offsets of every stream."""
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64())]
    schema = pa.schema(list(zip([c.split()[0] for c in _PROBE_DDL.split(", ")], types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    data = media.as_buffer().to_pybytes() if media.is_valid else b""
                    p = probe(data)
                    payload = stored_bytes(p)
                    us = p.samples * 1_000_000 // p.rate if p.rate else 0
                    row = (i, n, payload, len(data), hashlib.sha256(data).hexdigest(), len(p.offsets), p.samples, p.rate, us,
                           p.checked, p.failed, p.skipped, p.table.get("frames"), p.offsets)
                    yield row, len(data) + 8 * len(p.offsets)

        yield from _rebatch(rows(), schema)

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(n_bytes_col).cast("long").alias("n"), F.col(media_col).alias("media"))
    return out.mapInArrow(run, _PROBE_DDL).withColumnRenamed("id", id_col)


def op4_mpeg_audio(documents: DataFrame) -> DataFrame:
    """Every text of ``documents`` stored as MPEG audio, read back and digested, with its frames' seek offsets.

    One row per row of ``documents``, repeated ids included. Null texts count as empty; equal texts
    give equal values. ``tail_crc32`` is over the last 16 bytes of the payload read back.
    """
    back = probe_media(store_payload(documents, "doc_id", "text"), "doc_id", "media", "n_bytes")
    feature = F.concat_ws(
        ";", F.lit("mpeg1-layer3"), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("frames", "samples", "rate", "duration_us", "crc_failed", "skipped_bytes", "table_frames")],
        F.concat(F.lit("seek="), F.hex(F.xxhash64("seek_offsets"))),
    )
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
        "frames", "duration_us", "crc_failed", "seek_offsets",
    )
