"""Matroska columns: write samples into clusters of laced blocks, and parse the elements back into packet tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element ids of the format, fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, CHANNELS, DEPTH, DEFAULT_DURATION = 0xE1, 0x9F, 0x6264, 0x23E383
TIMECODE, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

UNIT = 192
FRAMES, BLOCKS = 16, 10
#: 192 samples at 8000 a second.
MILLISECONDS = 24


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    cluster: int
    block: int
    lacing: int
    keyframe: bool


def _number(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def write_size(value: int) -> bytes:
    """The shortest variable-length size; all ones are kept for an unknown size."""
    width = 1
    while value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return _number(key) + write_size(len(body)) + body


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """(size, next byte); the size is None if it is unknown."""
    width = 9 - data[at].bit_length()
    if width > 8:
        raise ValueError(f"no size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def _lace(frames: list[bytes], kind: int) -> bytes:
    """Count and sizes of a block's frames; the last one's size follows from the block's."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == EBML_LACING:
        head += write_size(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            head += _signed(n - before)
    return head


def _signed(value: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < value < (1 << 7 * width - 1):
        width += 1
    return ((value + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width, "big")


def write(frames: list[bytes], frames_per_block: int = FRAMES, blocks_per_cluster: int = BLOCKS, lacings: tuple[int, ...] = (FIXED, EBML_LACING, XIPH), milliseconds: int = MILLISECONDS) -> bytes:
    """A Matroska file with one track of 8-bit samples. Lacing kinds take turns; fixed lacing needs frames of one size, and others replace it where sizes differ."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, element(SCALE, _number(1_000_000)))
    audio = element(AUDIO, element(CHANNELS, b"\x01") + element(DEPTH, b"\x08"))
    track = element(TRACK, element(TRACK_NUMBER, b"\x01") + element(TRACK_UID, b"\x01") + element(TRACK_TYPE, b"\x02") + element(CODEC, b"A_PCM/INT/LIT") + element(DEFAULT_DURATION, _number(milliseconds * 1_000_000)) + audio)
    parts = [info, element(TRACKS, track)]
    at, cues = sum(map(len, parts)), []
    per_cluster = frames_per_block * blocks_per_cluster
    for c in range(0, len(frames), per_cluster):
        start = c * milliseconds
        body = [element(TIMECODE, _number(start))]
        for b in range(c, min(c + per_cluster, len(frames)), frames_per_block):
            own = frames[b : min(b + frames_per_block, c + per_cluster)]
            kind = lacings[b // frames_per_block % len(lacings)] if len(own) > 1 else NO_LACING
            if kind == FIXED and len({len(f) for f in own}) > 1:
                kind = EBML_LACING
            flags = 0x80 | kind << 1
            block = b"\x81" + (b * milliseconds - start).to_bytes(2, "big", signed=True) + bytes([flags]) + (_lace(own, kind) if kind else b"")
            body.append(element(SIMPLE_BLOCK, block + b"".join(own)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, element(CUE_TIME, _number(start)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER, _number(at)))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def _frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    if kind == NO_LACING:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing does not divide the block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            size += data[at]
            at += 1
        elif k == 0:
            size, at = read_size(data, at)
        else:
            width = 9 - data[at].bit_length()
            raw, at = read_size(data, at)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            size = sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced frames are larger than their block")
    return [*sizes, last], at


class Parsed(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int]]
    clusters: list[int]
    tracks: dict[int, str]


def parse(data: bytes) -> Parsed:
    """Packets, cues (time, byte of the cluster), bytes at which clusters start, and codecs of tracks. Elements of no interest are skipped by their size; clusters and segments of unknown size are read up to the next element of their level."""
    packets: list[Packet] = []
    cues: list[tuple[int, int]] = []
    clusters: list[int] = []
    tracks: dict[int, str] = {}
    durations: dict[int, int] = {}
    state = {"scale": 1_000_000, "time": 0, "segment": 0, "block": 0, "group": 0}
    track: dict[int, bytes] = {}
    cue = {}
    # A flat walk: the body of a master element is just the next thing to read, so depth costs no recursion.
    at = 0
    while at < len(data):
        start = at
        key, at = read_id(data, at)
        size, at = read_size(data, at)
        if key in MASTERS:
            if key == SEGMENT:
                state["segment"] = at
            elif key == CLUSTER:
                clusters.append(start - state["segment"])
                state["block"] = 0
            elif key == TRACK:
                track = {}
            elif key == BLOCK_GROUP:
                state["group"] = len(packets)
            continue
        if size is None or at + size > len(data):
            raise ValueError(f"element {key:x} at byte {start} is cut off")
        end = at + size
        if key in (SIMPLE_BLOCK, BLOCK):
            number, p = read_size(data, at)
            ahead = int.from_bytes(data[p : p + 2], "big", signed=True)
            flags = data[p + 2]
            kind = flags >> 1 & 3
            sizes, p = _frame_sizes(data, p + 3, end, kind)
            when, step = (state["time"] + ahead) * state["scale"], durations.get(number, 0)
            for n in sizes:
                packets.append(Packet(number, when, p, n, len(clusters) - 1, state["block"], kind, key == BLOCK or bool(flags & 0x80)))
                p += n
                when += step
            state["block"] += 1
        elif key == REFERENCE:
            # A grouped block that refers to another one is no key frame; it has no flag of its own.
            packets[state["group"] :] = [p._replace(keyframe=False) for p in packets[state["group"] :]]
        elif key == TIMECODE:
            state["time"] = int.from_bytes(data[at:end], "big")
        elif key == SCALE:
            state["scale"] = int.from_bytes(data[at:end], "big")
        elif key in (TRACK_NUMBER, CODEC, DEFAULT_DURATION):
            track[key] = data[at:end]
            if TRACK_NUMBER in track:
                number = int.from_bytes(track[TRACK_NUMBER], "big")
                tracks[number] = track.get(CODEC, b"").decode("ascii", "replace")
                durations[number] = int.from_bytes(track.get(DEFAULT_DURATION, b""), "big")
        elif key == CUE_TIME:
            cue["time"] = int.from_bytes(data[at:end], "big")
        elif key == CUE_CLUSTER:
            cues.append((cue.get("time", 0), int.from_bytes(data[at:end], "big")))
        at = end
    return Parsed(packets, cues, clusters, tracks)


def payload_of(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """(bytes of the text, those bytes filled up with spaces to a positive multiple of ``unit``)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * ((-len(data)) % unit or (0 if data else unit))


def store(payload: bytes) -> bytes:
    return write([payload[k : k + UNIT] for k in range(0, len(payload), UNIT)])


def features(parsed: Parsed, samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    above = x >= 128
    turns = int(np.count_nonzero(above[1:] != above[:-1]))
    last = max((p.timestamp_ns for p in parsed.packets), default=0) // 1_000_000
    good = sum(c in set(parsed.clusters) for _, c in parsed.cues)
    return f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={good};last_ms={last};sum={int(x.sum())};energy={int((x * x).sum())};crossings={turns}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each whole text stored as a Matroska file. Null and empty texts give a file of one frame of spaces."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([store(payload_of(t)[1]) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, media binary")


def _table(media: DataFrame, id_col: str, media_col: str, schema: str, types: list[pa.DataType], rows_of) -> DataFrame:
    """The rows that ``rows_of`` finds in each parsed file, behind the file's id. A null file has none; a broken one fails the job with the byte at fault."""
    own = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                found = rows_of(parse(data.as_py())) if data.is_valid else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), batch.column(0).type), *(pa.array(x, t) for x, t in zip(zip(*found), types, strict=True))], names)

    return own.mapInArrow(work, f"doc_id {kind}, {schema}")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet: track, timestamp, byte range, cluster, block and lacing."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    return _table(media, id_col, media_col, "track int, timestamp_ns long, offset long, size long, cluster int, block int, lacing int, keyframe boolean", types, lambda p: p.packets)


def cue_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each cue: its time in the segment's scale, the byte within the segment where its cluster is said to start, and that cluster's number, null if none starts there."""

    def rows_of(found: Parsed) -> list[tuple]:
        at = {c: k for k, c in enumerate(found.clusters)}
        return [(time, byte, at.get(byte)) for time, byte in found.cues]

    return _table(media, id_col, media_col, "time long, position long, cluster int", [pa.int64(), pa.int64(), pa.int32()], rows_of)


def track_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each track: its number, codec and number of packets."""

    def rows_of(found: Parsed) -> list[tuple]:
        return [(number, codec, sum(p.track == number for p in found.packets)) for number, codec in sorted(found.tracks.items())]

    return _table(media, id_col, media_col, "track int, codec string, n_packets long", [pa.int32(), pa.string(), pa.int64()], rows_of)


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the stored form and of the payload read back through the packet table. Rows are handled one by one: equal texts have equal values, repeated rows are repeated, an empty table gives an empty result, other columns are ignored."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(text: str | None) -> tuple:
        n, payload = payload_of(text)
        media = store(payload)
        del payload
        found = parse(media)
        back = b"".join(media[p.offset : p.offset + p.size] for p in found.packets)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(found, back)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
