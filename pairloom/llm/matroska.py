"""Media columns in Matroska: a writer of 8-bit sound and a reader of any file.

The reader parses EBML elements of variable length into a packet table: for each
frame its track, timestamp, key flag and byte range, with all kinds of lacing, and
the cue points. The writer stores bytes losslessly as the samples of an uncompressed
track, in clusters of laced blocks, with cues. Nothing in its output depends on
anything but the samples.
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

from pairloom.llm.common import ship, whole_text

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: What may follow a segment or cluster of unknown size and so ends it.
_TOP = (SEGMENT, EBML)
_LEVEL1 = (CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367)
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 8


def size_of(n: int) -> bytes:
    """n as a variable-length size."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_of(len(data)) + data


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames of a block behind their lacing header."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_of(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            length = 1
            while abs(b - a) >= (1 << 7 * length - 1) - 1:
                length += 1
            head += (b - a + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


_HEADER = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(MAX_ID_LENGTH, 4) + uint(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def mux(samples: bytes) -> bytes:
    """A file whose one track has the samples: blocks of up to 8 frames, all of one
    length (fixed lacing) but for the last ones (EBML lacing), 8 blocks a cluster."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)) + element(MUXING_APP, b"pairloom") + element(WRITING_APP, b"pairloom"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    step = FRAME * LACED * BLOCKS
    for c in range(0, len(samples), step):
        time = c * 1000 // RATE
        blocks = [uint(TIMESTAMP, time)]
        for b in range(c, min(c + step, len(samples)), FRAME * LACED):
            frames = [samples[f : f + FRAME] for f in range(b, min(b + FRAME * LACED, len(samples)), FRAME)]
            kind = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - time, 0x80 | kind << 1) + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, key, byte offset, bytes);
    cues: (timestamp in ns, track, byte offset of the cluster); clusters: byte offsets."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length number and the place after it; -1 is the unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"the file ends within the number at byte {at}")
    n = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return n, at + length
    n &= (1 << 7 * length) - 1
    return (-1 if n == (1 << 7 * length) - 1 else n), at + length


def _children(data: bytes, at: int, end: int, stop: tuple[int, ...] = ()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, data start, data end) of the elements from at to end; an element of
    unknown size reaches to the end, and `stop` ids end the parent."""
    while at < end:
        start = at
        ident, at = number(data, at, True)
        if ident in stop:
            return
        n, at = number(data, at, False)
        if n >= 0 and at + n > end:
            raise ValueError(f"the element at byte {start} is longer than its parent")
        yield ident, start, at, end if n < 0 else at + n
        at = end if n < 0 else at + n


def _unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return struct.unpack({0: ">0s", 4: ">f", 8: ">d"}[b - a], data[a:b])[0] if b > a else 0.0


def unlace(data: bytes, a: int, b: int, kind: int) -> list[tuple[int, int]]:
    """(offset, bytes) of the frames of a block's data."""
    if kind == NO_LACING:
        return [(a, b - a)]
    if a >= b:
        raise ValueError("a laced block without frames")
    n, a = data[a] + 1, a + 1
    if kind == FIXED:
        if (b - a) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(b - a) // n] * (n - 1)
    elif kind == XIPH:
        sizes = []
        for _ in range(n - 1):
            total = 0
            while a < b and data[a] == 255:
                total, a = total + 255, a + 1
            if a >= b:
                raise ValueError("lacing sizes beyond the block")
            sizes.append(total + data[a])
            a += 1
    else:
        sizes = []
        for k in range(n - 1):
            start = a
            x, a = number(data, a, False)
            length = a - start
            if x < 0:
                x = (1 << 7 * length) - 1
            sizes.append(x if k == 0 else sizes[-1] + x - ((1 << 7 * length - 1) - 1))
    sizes.append(b - a - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing sizes beyond the block")
    out = []
    for s in sizes:
        out.append((a, s))
        a += s
    return out


def _block(media: Media, data: bytes, a: int, b: int, time: int, key: bool | None) -> None:
    track, a = number(data, a, False)
    if a + 3 > b:
        raise ValueError("a block without its header")
    offset, flags = struct.unpack_from(">hB", data, a)
    frames = unlace(data, a + 3, b, flags >> 1 & 3)
    step = media.tracks.get(track, {}).get("sample_ns", 0)
    at = (time + offset) * media.scale
    for o, n in frames:
        media.packets.append((track, at, bool(flags & 0x80) if key is None else key, o, n))
        at += n * step


def _track(media: Media, data: bytes, a: int, b: int) -> None:
    t = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0}
    for ident, _, c, d in _children(data, a, b):
        if ident == TRACK_NUMBER:
            t["number"] = _unsigned(data, c, d)
        elif ident == TRACK_TYPE:
            t["type"] = _unsigned(data, c, d)
        elif ident == CODEC_ID:
            t["codec"] = data[c:d].rstrip(b"\0").decode("ascii", "replace")
        elif ident == AUDIO:
            for i, _, e, f in _children(data, c, d):
                if i == SAMPLING_FREQUENCY:
                    t["rate"] = _real(data, e, f)
                elif i == CHANNELS:
                    t["channels"] = _unsigned(data, e, f)
                elif i == BIT_DEPTH:
                    t["bits"] = _unsigned(data, e, f)
    if t["codec"].startswith("A_PCM") and t["bits"] and t["rate"]:
        t["sample_ns"] = int(1_000_000_000 / (t["rate"] * t["channels"] * t["bits"] / 8))
    media.tracks[t["number"]] = t


def demux(data: bytes) -> Media:
    """Parses a file; ValueError if it is damaged."""
    try:
        return _demux(data)
    except (KeyError, IndexError, OverflowError, ZeroDivisionError, struct.error) as e:
        raise ValueError(f"damaged file: {e}") from e


def _demux(data: bytes) -> Media:
    media, kind = Media(), b""
    for top, _, a, b in _children(data, 0, len(data)):
        if top == EBML:
            kind = next((data[c:d] for i, _, c, d in _children(data, a, b) if i == DOC_TYPE), b"")
        elif top == SEGMENT:
            at = a
            while at < b:
                ident, start, c, d = next(_children(data, at, b))
                at = d
                if ident == INFO:
                    for i, _, e, f in _children(data, c, d):
                        if i == TIMESTAMP_SCALE:
                            media.scale = _unsigned(data, e, f)
                        elif i == DURATION:
                            media.duration = _real(data, e, f)
                elif ident == TRACKS:
                    for i, _, e, f in _children(data, c, d):
                        if i == TRACK_ENTRY:
                            _track(media, data, e, f)
                elif ident == CLUSTER:
                    media.clusters.append(start)
                    time, end = 0, c
                    for i, _, e, f in _children(data, c, d, _LEVEL1 + _TOP):
                        end = f
                        if i == TIMESTAMP:
                            time = _unsigned(data, e, f)
                        elif i == SIMPLE_BLOCK:
                            _block(media, data, e, f, time, None)
                        elif i == BLOCK_GROUP:
                            inner = list(_children(data, e, f))
                            key = not any(x[0] == REFERENCE_BLOCK for x in inner)
                            for x, _, g, h in inner:
                                if x == BLOCK:
                                    _block(media, data, g, h, time, key)
                    at = end if d == b else d
                elif ident == CUES:
                    for i, _, e, f in _children(data, c, d):
                        if i == CUE_POINT:
                            found = {x: (g, h) for x, _, g, h in _children(data, e, f)}
                            time = _unsigned(data, *found[CUE_TIME]) if CUE_TIME in found else 0
                            where = {x: _unsigned(data, g, h) for x, _, g, h in _children(data, *found[CUE_TRACK_POSITIONS])} if CUE_TRACK_POSITIONS in found else {}
                            media.cues.append((time * media.scale, where.get(CUE_TRACK, 0), a + where.get(CUE_CLUSTER_POSITION, 0)))
    if kind not in (b"matroska", b"webm"):
        raise ValueError("not a Matroska file")
    return media


def samples_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[o : o + n] for t, _, _, o, n in media.packets if t == track)


def features(samples: bytes, media: Media) -> str:
    """Sound features of 8-bit samples around 128, in fixed notation."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    power = float((x * x).sum()) / n
    p = np.bincount(np.frombuffer(samples, np.uint8), minlength=1) / n
    p = p[p > 0]
    entropy = float(-(p * np.log2(p)).sum())
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={len(x) * 1000 // RATE};mean={x.sum() / n:.4f};rms={power**0.5:.4f};peak={int(np.abs(x).max(initial=0))};crossings={crossings};entropy={entropy + 0.0:.4f}"


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 if data else 64)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, media binary: each whole text's bytes (null: empty), padded, as sound."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mux(padded(t)) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text")).mapInArrow(run, "doc_id long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> doc_id, packet, track, timestamp_ns, key, start, bytes, error: a row
    for each frame in file order. A damaged file gives one row with only the error, a
    null one none. Files are read one at a time."""
    ship(media.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("packet", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("key", pa.bool_()), ("start", pa.int64()), ("bytes", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                if data is None:
                    continue
                try:
                    rows = [(doc_id, k, *p, None) for k, p in enumerate(demux(data).packets)]
                except ValueError as e:
                    rows = [(doc_id, None, None, None, None, None, None, str(e))]
                cols = list(zip(*rows)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, packet long, track long, timestamp_ns long, key boolean, start long, bytes long, error string")


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature of every row: the text is stored as sound, the stored bytes are parsed, and
    all but n_bytes comes from what the packet table points at. Null and empty texts
    hold 64 zero bytes; equal texts have equal values. One pass, no shuffle."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                stored = mux(padded(text))
                media = demux(stored)
                back = samples_of(stored, media)
                rows.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, media)))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
