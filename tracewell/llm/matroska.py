"""Matroska media columns: writing 8-bit audio, and parsing EBML elements into packet tables."""

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

from tracewell.llm.runtime import ship
from tracewell.shared import written

# Element identifiers of the format, with their length markers.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
REFERENCE_BLOCK, DEFAULT_DURATION = 0xFB, 0x23E383
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: How deep each element stands: one that stands no deeper than an open element of unknown size ends it.
LEVEL = {EBML: 0, SEGMENT: 0, INFO: 1, TRACKS: 1, CLUSTER: 1, CUES: 1}
NUMBERS = {BLOCK_DURATION: "duration", CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster", TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "frame_ns"}

SAMPLE_RATE, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8000, 1024, 8, 8
UNIT = 64


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def vint(value: int, length: int = 0) -> bytes:
    """A variable-length integer: a leading 1 bit after length - 1 zeros, then the value."""
    length = length or max(1, -(-(value + 2).bit_length() // 7))
    while value >= (1 << (7 * length)) - 1:
        length += 1
    return (value | 1 << (7 * length)).to_bytes(length, "big")


def _element(element: int, body: bytes) -> bytes:
    return _id(element) + vint(len(body)) + body


def _uint(element: int, value: int) -> bytes:
    return _element(element, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEAD = _element(EBML, _element(DOC_TYPE, b"matroska"))
DESCRIBED = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000)) + _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT")
        + _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag bits and body of a block: none, fixed-size, or EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1]) + b"".join(frames)
    steps = vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        length = next(n for n in range(1, 9) if abs(b - a) <= (1 << (7 * n - 1)) - 1)
        steps += vint(b - a + (1 << (7 * length - 1)) - 1, length)
    return 0x06, bytes([len(frames) - 1]) + steps + b"".join(frames)


def mux(samples: bytes) -> bytes:
    """8-bit mono samples as a file of one audio track: clusters of laced blocks, and cues."""
    clusters, cues, at = [], [], len(DESCRIBED)
    span = FRAME * FRAMES_A_BLOCK
    for begin in range(0, len(samples), span * BLOCKS_A_CLUSTER):
        start = begin * 1000 // SAMPLE_RATE
        body = _uint(CLUSTER_TIME, start)
        for b in range(begin, min(len(samples), begin + span * BLOCKS_A_CLUSTER), span):
            part = samples[b : b + span]
            lacing, data = _laced([part[i : i + FRAME] for i in range(0, len(part), FRAME)])
            body += _element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", b * 1000 // SAMPLE_RATE - start, 0x80 | lacing) + data)
        cluster = _element(CLUSTER, body)
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(cluster)
        clusters.append(cluster)
    return HEAD + _element(SEGMENT, DESCRIBED + b"".join(clusters) + (_element(CUES, b"".join(cues)) if cues else b""))


@dataclass
class Parsed:
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    #: (cluster, track, timestamp in ns, duration in ticks or None, keyframe, place in its lace, offset, size)
    packets: list[tuple[int, int, int, int | None, bool, int, int, int]] = field(default_factory=list)
    #: (time in ns, track, offset of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value (None: all ones, unknown) and the position behind it."""
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"no variable-length integer at {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << (7 * length)) - 1
    return (None if value == (1 << (7 * length)) - 1 else value), at + length


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose data start at ``at``."""
    if not lacing:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if lacing == 2:  # fixed size
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal parts")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for i in range(count - 1):
            if lacing == 1:  # Xiph: bytes of 255 go on
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:  # EBML: the first size, then signed differences
                value, then = _vint(data, at)
                size = value if not i else sizes[-1] + value - ((1 << (7 * (then - at) - 1)) - 1)
                at = then
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed their block")
    offsets = at
    out = []
    for size in sizes:
        out.append((offsets, size))
        offsets += size
    return out


class _Reader:
    """State of a file that is read from its first element to its last."""

    def __init__(self, data: bytes) -> None:
        self.data, self.out = data, Parsed()
        self.group: dict[str, object] = {}
        self.time = self.segment = 0
        #: (element, end, whether its size is unknown) of the elements around the place that is read.
        self.around: list[tuple[int, int, bool]] = [(0, len(data), False)]

    def number(self, at: int, end: int) -> int:
        return int.from_bytes(self.data[at:end], "big")

    def block(self, at: int, end: int, key: bool | None) -> None:
        """Packets of a block; frames behind the first of a lace follow at the track's default duration, if it has one."""
        track, at = _vint(self.data, at)
        rel, flags = struct.unpack_from(">hB", self.data, at)
        frames = _frames(self.data, at + 3, end, flags >> 1 & 3)
        duration = self.group.get("duration") if key is not None else None
        apart = self.out.tracks.get(track, {}).get("frame_ns", 0)
        start = (self.time + rel) * self.out.scale
        for i, (offset, size) in enumerate(frames):
            self.out.packets.append((len(self.out.clusters) - 1, track, start + i * apart, duration, bool(flags & 0x80) if key is None else key, i, offset, size))

    def open(self, element: int, begin: int, at: int, end: int, unknown: bool) -> None:
        self.around.append((element, end, unknown))
        if element == SEGMENT:
            self.segment = at
        elif element == CLUSTER:
            self.time = 0
            self.out.clusters.append(begin)
        elif element in (BLOCK_GROUP, CUE_POINT, TRACK_ENTRY):
            self.group = {}
        elif element == CUE_POSITIONS:
            # a point has a position for each of its tracks, all at its time
            self.group = {k: v for k, v in self.group.items() if k == "time"}

    def close(self) -> None:
        element, _, _ = self.around.pop()
        if element == BLOCK_GROUP and "block" in self.group:
            self.block(*self.group["block"], "reference" not in self.group)
        elif element == CUE_POSITIONS:
            self.out.cues.append((self.group.get("time", 0) * self.out.scale, self.group.get("track", 0), self.segment + self.group.get("cluster", 0)))
        elif element == TRACK_ENTRY:
            self.out.tracks[self.group.pop("number", 0)] = self.group
            self.group = {}

    def leaf(self, element: int, at: int, end: int) -> None:
        if element == SIMPLE_BLOCK:
            self.block(at, end, None)
        elif element == BLOCK:
            self.group["block"] = (at, end)
        elif element == REFERENCE_BLOCK:
            self.group["reference"] = True
        elif element == CLUSTER_TIME:
            self.time = self.number(at, end)
        elif element == TIMESTAMP_SCALE:
            self.out.scale = self.number(at, end)
        elif element == CODEC:
            self.group["codec"] = self.data[at:end].decode()
        elif element == RATE:
            self.group["rate"] = struct.unpack(">d" if end - at == 8 else ">f", self.data[at:end])[0]
        elif element in NUMBERS:
            self.group[NUMBERS[element]] = self.number(at, end)


def parse(data: bytes) -> Parsed:
    """Read all elements of a file, one after the other; unknown ones are skipped, and sizes may be unknown."""
    reader, at = _Reader(data), 0
    while at < len(data):
        while at >= reader.around[-1][1]:
            reader.close()
        begin = at
        element, at = _vint(data, at, keep_marker=True)
        size, at = _vint(data, at)
        while reader.around[-1][2] and LEVEL.get(element, 9) <= LEVEL.get(reader.around[-1][0], 9):
            reader.close()
        limit = reader.around[-1][1]
        end = limit if size is None else at + size
        if end > limit:
            raise ValueError(f"element at {begin} ends behind its parent")
        if element in MASTERS:
            reader.open(element, begin, at, end, size is None)
        else:
            reader.leaf(element, at, end)
            at = end
    while len(reader.around) > 1:
        reader.close()
    return reader.out


PACKETS = "media_id long, cluster int, track int, timestamp_ns long, keyframe boolean, lace int, offset long, size long, is_cue boolean"
PACKET_FIELDS = pa.schema([("media_id", pa.int64()), ("cluster", pa.int32()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("keyframe", pa.bool_()), ("lace", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("is_cue", pa.bool_())])


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for media_id, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not media.is_valid or not len(media.as_buffer()):
                continue
            found = parse(media.as_buffer().to_pybytes())
            cued = {offset for _, _, offset in found.cues}
            rows = [(media_id, c, track, time, key, lace, offset, size, found.clusters[c] in cued if c >= 0 else False) for c, track, time, _, key, lace, offset, size in found.packets]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKET_FIELDS.types, strict=True)], schema=PACKET_FIELDS)


def packet_table(media: DataFrame, id_column: str = "media_id", media_column: str = "media") -> DataFrame:
    """One row per frame of each file: cluster, track, time, place in its lace, byte range, and whether cues name its cluster.

    Null and empty files have no rows; a malformed file is an error.
    """
    ship(media.sparkSession)
    return media.select(F.col(id_column).cast("long"), F.col(media_column)).mapInArrow(_packets, PACKETS)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for text in batch.column(1):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            sizes.append(len(raw))
            media.append(mux(raw + bytes(UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text as a media column: its UTF-8 bytes, with bytes 0 up to a positive multiple of 64."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


DESCRIPTION = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
DESCRIPTION_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(samples: bytes, parsed: Parsed) -> str:
    """Counts of the container, and level, loudness, zero crossings and byte entropy of the samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256) - 128.0
    mean = float(counts @ values) / len(x)
    power = float(counts @ (values * values)) / len(x)
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    p = counts[counts > 0] / len(x)
    return f"clusters={len(parsed.clusters)};packets={len(parsed.packets)};cues={len(parsed.cues)};mean={mean:.4f};rms={power**0.5:.4f};crossings={crossings};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = media.as_buffer().to_pybytes()
            parsed = parse(data)
            samples = b"".join([data[offset : offset + size] for _, track, _, _, _, _, offset, size in parsed.packets if track == 1])
            rows.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples, parsed)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DESCRIPTION.types, strict=True)], schema=DESCRIPTION)


def described(media: DataFrame) -> DataFrame:
    """Read media columns back through their packet tables: digests of samples and file, and a feature string."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_describe, DESCRIPTION_DDL)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text in a table of media and read that back, one row per row of ``docs``.

    Null texts count as empty; a null doc_id is kept; repeated rows each return, and equal texts have equal values. An empty
    table gives an empty result. Other columns are ignored.
    """
    return described(written(stored(docs), "media"))
