"""Matroska media columns: writing audio tracks, and parsing files into packet tables.

The parser reads variable-length EBML elements (known and unknown sizes), track
entries, clusters, simple blocks and block groups with all four kinds of lacing, and
cues.  A packet is one laced frame: its track, timestamp and byte range in the file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: element ids.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE = 0x4282, 0x4287, 0x4285, 0x4286, 0x42F7, 0x42F2, 0x42F3
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, FLAG_LACING, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
LACINGS = ("none", "xiph", "fixed", "ebml")
#: Elements that end a cluster of unknown size.
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}


class MatroskaError(ValueError):
    """The bytes break the format."""


# ---------------------------------------------------------------- writing


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


@functools.cache
def _id_bytes(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def element(id_: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return _id_bytes(id_) + vint(len(body)) + body


def _uint(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def laced_block(id_: int, track: int, relative: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    """A simple block (or the block of a group) holding the frames."""
    head = vint(track) + struct.pack(">hB", relative, (0x80 if key and id_ == SIMPLE_BLOCK else 0) | lacing << 1)
    if lacing == NO_LACING:
        return element(id_, head, *frames)
    sizes = [len(f) for f in frames]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return element(id_, head, *frames)


RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 16


@functools.cache
def _preamble() -> tuple[bytes, bytes]:
    head = element(
        EBML, element(EBML_VERSION, b"\x01"), element(EBML_READ_VERSION, b"\x01"), element(MAX_ID, b"\x04"), element(MAX_SIZE, b"\x08"),
        element(DOC_TYPE, b"matroska"), element(DOC_TYPE_VERSION, b"\x04"), element(DOC_TYPE_READ_VERSION, b"\x02"),
    )
    track = element(
        TRACK_ENTRY, element(TRACK_NUMBER, b"\x01"), element(TRACK_UID, b"\x01"), element(TRACK_TYPE, b"\x02"), element(FLAG_LACING, b"\x01"),
        element(CODEC_ID, b"A_PCM/INT/LIT"), element(DEFAULT_DURATION, _uint(FRAME * 10**9 // RATE)),
        element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)), element(CHANNELS, b"\x01"), element(BIT_DEPTH, b"\x08")),
    )
    return head, element(TRACKS, track)


def write_pcm8(samples: bytes) -> bytes:
    """A file with one track of 8-bit samples at 8 kHz: frames of 512 samples, eight
    to a block (fixed lacing while all are whole, else EBML lacing), sixteen blocks to a
    cluster, a cue for each cluster."""
    head, tracks = _preamble()
    info = element(INFO, element(TIMESTAMP_SCALE, _uint(1_000_000)), element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)), element(MUXING_APP, b"quorumlake"), element(WRITING_APP, b"quorumlake"))
    body, cues, at, per_block = [info, tracks], [], len(info) + len(tracks), FRAME * LACED
    for start in range(0, len(samples), per_block * BLOCKS):
        time, blocks = start * 1000 // RATE, []
        for b in range(start, min(start + per_block * BLOCKS, len(samples)), per_block):
            frames = [samples[i : min(i + FRAME, b + per_block)] for i in range(b, min(b + per_block, len(samples)), FRAME)]
            lacing = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else EBML_LACING
            blocks.append(laced_block(SIMPLE_BLOCK, 1, b * 1000 // RATE - time, frames, lacing))
        cluster = element(CLUSTER, element(TIMESTAMP, _uint(time)), *blocks)
        cues.append(element(CUE_POINT, element(CUE_TIME, _uint(time)), element(CUE_TRACK_POSITIONS, element(CUE_TRACK, b"\x01"), element(CUE_CLUSTER_POSITION, _uint(at)))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, *body, *([element(CUES, *cues)] if cues else []))


# ---------------------------------------------------------------- parsing


@dataclass
class Track:
    number: int = 0
    type: int = 0
    codec: str = ""
    default_duration: int | None = None
    rate: float = 8000.0
    channels: int = 1
    bit_depth: int | None = None


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, Track] = field(default_factory=dict)
    #: (track, timestamp in ns, duration in ns or None, key frame, offset, length, lacing, block number, cluster offset)
    packets: list[tuple] = field(default_factory=list)
    #: (time in ns, track, absolute cluster offset)
    cues: list[tuple] = field(default_factory=list)
    clusters: int = 0
    blocks: int = 0
    error: str | None = None


def _vint_at(data: bytes, at: int, end: int) -> tuple[int, int, bool]:
    """(value, next position, all ones) of the size at a position."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no size at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MatroskaError(f"size cut off at {at}")
    mask = (1 << 7 * width) - 1
    value = int.from_bytes(data[at : at + width], "big") & mask
    return value, at + width, value == mask


def _id_at(data: bytes, at: int, end: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise MatroskaError(f"no element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start, end, size known) of the elements in a range; an unknown size reaches to the range's end."""
    while at < end:
        id_, at = _id_at(data, at, end)
        size, at, unknown = _vint_at(data, at, end)
        if not unknown and at + size > end:
            raise MatroskaError(f"element {id_:X} reaches past its parent at {at}")
        stop = end if unknown else at + size
        yield id_, at, stop, not unknown
        at = stop


def _unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block's content and where the first frame starts."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise MatroskaError(f"lacing cut off at {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise MatroskaError(f"fixed lacing doesn't divide at {at}")
        return [(end - at) // count] * count, at
    if lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError(f"lacing cut off at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for i in range(count - 1):
            start = at
            value, at, _ = _vint_at(data, at, end)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError(f"lacing sizes don't fit at {at}")
    return sizes, at


def parse(data: bytes) -> Media:
    """Reads a file; at the first broken element, keeps what came before and says why."""
    media = Media()
    try:
        _parse(data, media)
    except MatroskaError as e:
        media.error = str(e)
    except (IndexError, UnicodeDecodeError, struct.error) as e:
        media.error = f"cut off: {e}"
    return media


def _parse(data: bytes, media: Media) -> None:
    if not data.startswith(b"\x1a\x45\xdf\xa3"):
        raise MatroskaError("no EBML header")
    for id_, a, b, _ in _children(data, 0, len(data)):
        if id_ == EBML:
            media.doc_type = next((data[x:y].rstrip(b"\0").decode() for i, x, y, _ in _children(data, a, b) if i == DOC_TYPE), "")
        elif id_ == SEGMENT:
            _segment(data, a, b, media)


def _segment(data: bytes, start: int, end: int, media: Media) -> None:
    at = start
    while at < end:
        begin = at
        id_, at = _id_at(data, at, end)
        size, at, unknown = _vint_at(data, at, end)
        stop = end if unknown else at + size
        if stop > end:
            raise MatroskaError(f"element {id_:X} reaches past its parent at {at}")
        if id_ == INFO:
            for i, a, b, _ in _children(data, at, stop):
                if i == TIMESTAMP_SCALE:
                    media.scale = _unsigned(data, a, b)
                elif i == DURATION:
                    media.duration = _float(data, a, b)
        elif id_ == TRACKS:
            for i, a, b, _ in _children(data, at, stop):
                if i == TRACK_ENTRY:
                    track = _track(data, a, b)
                    media.tracks[track.number] = track
        elif id_ == CUES:
            for i, a, b, _ in _children(data, at, stop):
                if i == CUE_POINT:
                    _cue(data, a, b, start, media)
        elif id_ == CLUSTER:
            stop = _cluster(data, at, stop, unknown, begin, media)
        at = stop


def _track(data: bytes, start: int, end: int) -> Track:
    t = Track()
    for i, a, b, _ in _children(data, start, end):
        if i == TRACK_NUMBER:
            t.number = _unsigned(data, a, b)
        elif i == TRACK_TYPE:
            t.type = _unsigned(data, a, b)
        elif i == CODEC_ID:
            t.codec = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            t.default_duration = _unsigned(data, a, b)
        elif i == AUDIO:
            for j, c, d, _ in _children(data, a, b):
                if j == SAMPLING_FREQUENCY:
                    t.rate = _float(data, c, d)
                elif j == CHANNELS:
                    t.channels = _unsigned(data, c, d)
                elif j == BIT_DEPTH:
                    t.bit_depth = _unsigned(data, c, d)
    return t


def _cue(data: bytes, start: int, end: int, segment: int, media: Media) -> None:
    time = 0
    for i, a, b, _ in _children(data, start, end):
        if i == CUE_TIME:
            time = _unsigned(data, a, b) * media.scale
        elif i == CUE_TRACK_POSITIONS:
            at = {j: _unsigned(data, c, d) for j, c, d, _ in _children(data, a, b) if j in (CUE_TRACK, CUE_CLUSTER_POSITION)}
            media.cues.append((time, at.get(CUE_TRACK, 0), segment + at.get(CUE_CLUSTER_POSITION, 0)))


def _cluster(data: bytes, at: int, end: int, unknown: bool, begin: int, media: Media) -> int:
    """Reads a cluster's blocks; returns where it ends."""
    media.clusters += 1
    time = 0
    while at < end:
        here = at
        id_, at = _id_at(data, at, end)
        if unknown and id_ in TOP_LEVEL:
            return here
        size, at, _ = _vint_at(data, at, end)
        stop = at + size
        if stop > end:
            raise MatroskaError(f"element {id_:X} reaches past its cluster at {at}")
        if id_ == TIMESTAMP:
            time = _unsigned(data, at, stop)
        elif id_ == SIMPLE_BLOCK:
            _block(data, at, stop, time, begin, media, None, None)
        elif id_ == BLOCK_GROUP:
            inner = {i: (a, b) for i, a, b, _ in _children(data, at, stop)}
            if BLOCK in inner:
                lasts = _unsigned(data, *inner[BLOCK_DURATION]) * media.scale if BLOCK_DURATION in inner else None
                _block(data, *inner[BLOCK], time, begin, media, REFERENCE_BLOCK not in inner, lasts)
        at = stop
    return end


def _block(data: bytes, at: int, end: int, time: int, cluster: int, media: Media, key: bool | None, lasts: int | None) -> None:
    number, at, _ = _vint_at(data, at, end)
    if at + 3 > end:
        raise MatroskaError(f"block cut off at {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, lacing)
    track = media.tracks.get(number)
    each = track.default_duration if track else None
    each = each if each is not None else lasts // len(sizes) if lasts is not None else None
    start, block = (time + relative) * media.scale, media.blocks
    media.blocks += 1
    for i, size in enumerate(sizes):
        media.packets.append((number, start + i * (each or 0), each, bool(flags & 0x80) if key is None else key, at, size, LACINGS[lacing], block, cluster))
        at += size


# ---------------------------------------------------------------- DataFrame operators


PACKETS = "id long, packet int, track int, timestamp_ns long, duration_ns long, key boolean, offset long, length long, lacing string, block int, cluster long, codec string, error string"


def packet_table(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet of each file, byte ranges included.

    A null or empty file, one without packets and one broken from the start give
    one row with null packet columns; a file that breaks off gives the packets before the
    break, all with its ``error``.  Files of any length are read whole, one at a time; repeated ids
    give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = parse(blob.as_py() or b"")
                rows = [(id_, n, *p, m.tracks[p[0]].codec if p[0] in m.tracks else None, m.error) for n, p in enumerate(m.packets)] or [(id_, *[None] * 11, m.error)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKET_TYPES, strict=True)], _PACKET_NAMES)

    return media.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary")).mapInArrow(run, PACKETS)


_PACKET_NAMES = [x.split()[0] for x in PACKETS.split(", ")]
_PACKET_TYPES = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in PACKETS.split(", ")]


def cue_table(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id, timestamp_ns, track, cluster``: the cues of each file; none for null or broken files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for c in parse(blob.as_py() or b"").cues]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["id", "timestamp_ns", "track", "cluster"])

    return media.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary")).mapInArrow(run, "id long, timestamp_ns long, track int, cluster long")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded length, payload): UTF-8, zero bytes appended up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as a Matroska file of 8-bit samples; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write_pcm8(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """From ``doc_id, n_bytes, media``: what the stored files hold, read back packet by packet.

    The payload is the bytes of the packets in order of timestamp.  ``feature`` is a JSON
    object: counts of packets, blocks and clusters, kinds of lacing, cues that name a cluster's
    start, duration, and mean, deviation and zero crossings of the samples.
    A null or broken file gives an empty payload and its error in ``feature``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column(2):
                data = blob.as_py() or b""
                m = parse(data)
                packets = sorted(m.packets, key=lambda p: (p[1], p[4]))
                payload = b"".join(data[p[4] : p[4] + p[5]] for p in packets)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), _feature(m, payload)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def _feature(m: Media, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.einsum("i,i->", x.astype(np.float64), x.astype(np.float64)))
    starts = {p[8] for p in m.packets}
    above = x >= 128
    found = {
        "packets": len(m.packets), "blocks": m.blocks, "clusters": m.clusters,
        "lacing": {k: n for k in LACINGS if (n := sum(p[6] == k for p in m.packets))},
        "cues": len(m.cues), "cues_on_clusters": sum(c[2] in starts for c in m.cues),
        "duration_ms": sum(p[5] for p in m.packets) * 1000 // RATE,
        "mean": round(total / len(x), 4) if len(x) else None,
        "deviation": round(max(0.0, squares / len(x) - (total / len(x)) ** 2) ** 0.5, 4) if len(x) else None,
        "crossings": int((above[1:] != above[:-1]).sum()),
    }
    return json.dumps(found | ({"error": m.error} if m.error else {}))
