"""Media columns in Matroska: writing payloads as PCM tracks, parsing files into packet tables, reading packets back.

A file is a tree of EBML elements: an id and a size, both of variable length, then data. The writer lays down header, segment
information, one PCM track, cues, and clusters of laced simple blocks. The parser walks any such tree (known or unknown
sizes, void and unknown elements skipped, simple blocks and block groups, all four lacings) and yields one packet per frame
with track, timestamp and byte range; cues become (time, track, cluster position). Bytes are read back by those ranges alone.

A null text or medium is empty: the writer pads it to 64 bytes of silence, the parser finds no packets in it. A truncated or
broken file raises ValueError with the offset. Rows are independent: equal texts give equal files, repeated rows each their own; very
long texts are stored whole; an empty table gives no rows; only the columns named are read, so other names can't clash.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dqengine.llm.common import sha256, table, text_slices

RATE = 8000
FRAME = 1024
"""Samples (bytes) of a frame."""
LACED = 8
"""Frames of a block."""
CLUSTER = 32
"""Frames of a cluster; a block's time is 16 bits relative to its cluster's, so a cluster has to be short."""
PAD = 64

# Element ids of the Matroska specification.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CLUSTER_ID, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
HEADER = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8), (DOC_TYPE, b"matroska"), (0x4287, 4), (0x4285, 2))
PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CUES, CUE_POINT, CUE_TRACK_POSITIONS, CLUSTER_ID, BLOCK_GROUP}
LEVEL_ONE = {CLUSTER_ID, CUES, TRACKS, INFO}
XIPH, FIXED, EBML_LACING = 1, 2, 3


def vint(value: int, width: int = 0) -> bytes:
    """A size as variable-length integer; all ones are kept for 'unknown'."""
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(code: int, data: bytes | int | float) -> bytes:
    if isinstance(data, int):
        data = data.to_bytes(max(1, (data.bit_length() + 7) // 8), "big")
    elif isinstance(data, float):
        data = struct.pack(">d", data)
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def block(track: int, relative: int, frames: list[bytes]) -> bytes:
    """A simple block: fixed lacing for frames of one size, EBML lacing for others, none for a single frame."""
    head = vint(track) + struct.pack(">h", relative)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    sizes = [len(f) for f in frames]
    count = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return element(SIMPLE_BLOCK, head + bytes([0x80 | FIXED << 1]) + count + b"".join(frames))
    laced = vint(sizes[0])
    for before, size in zip(sizes, sizes[1:-1]):
        step = size - before
        n = next(n for n in range(1, 9) if abs(step) < 1 << 7 * n - 1)
        laced += vint(step + (1 << 7 * n - 1) - 1, n)
    return element(SIMPLE_BLOCK, head + bytes([0x80 | EBML_LACING << 1]) + count + laced + b"".join(frames))


def milliseconds(samples: int, rate: int = RATE) -> int:
    return samples * 1000 // rate


_HEAD = element(EBML, b"".join(element(*x) for x in HEADER))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        b"".join(element(*x) for x in ((TRACK_NUMBER, 1), (TRACK_UID, 1), (TRACK_TYPE, 2), (FLAG_LACING, 1), (CODEC_ID, b"A_PCM/INT/LIT")))
        + element(AUDIO, element(SAMPLING_FREQUENCY, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose only track holds the payload as 8-bit samples."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    clusters, times = [], []
    for c in range(0, len(frames), CLUSTER):
        start = milliseconds(c * FRAME)
        blocks = [block(1, milliseconds(b * FRAME) - start, frames[b : min(b + LACED, c + CLUSTER)]) for b in range(c, min(c + CLUSTER, len(frames)), LACED)]
        clusters.append(element(CLUSTER_ID, element(TIMESTAMP, start) + b"".join(blocks)))
        times.append(start)
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, len(payload) * 1000 / RATE) + element(MUXING_APP, b"dqengine") + element(WRITING_APP, b"dqengine"))
    cue = lambda at, place: element(CUE_POINT, element(CUE_TIME, at) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, place.to_bytes(8, "big"))))
    cues_size = len(element(CUES, b"".join(cue(t, 0) for t in times)))
    place, points = len(info) + len(_TRACKS) + cues_size, []
    for at, cluster in zip(times, clusters):
        points.append(cue(at, place))
        place += len(cluster)
    return _HEAD + element(SEGMENT, info + _TRACKS + element(CUES, b"".join(points)) + b"".join(clusters))


@dataclass
class Parsed:
    """tracks: by number, what the file says of each; packets: (track, time in ns, offset, size, cluster, key frame);
    cues: (time in ns, track, cluster's offset in the file)."""

    scale: int
    duration: float
    tracks: dict[int, dict]
    packets: list[tuple[int, int, int, int, int, bool]]
    cues: list[tuple[int, int, int]]
    clusters: list[int]


def _read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block whose lace data starts at ``at``."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"no lace count at {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"uneven fixed lacing at {at}")
        sizes = [(end - at) // count] * count
    elif lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(count - 1):
            before = at
            value, at = _read_vint(data, at, False)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing beyond the block at {at}")
    edges = at + np.cumsum([0, *sizes[:-1]])
    return list(zip(edges.tolist(), sizes))


def parse(data: bytes) -> Parsed:
    """Tables of a file's tracks, packets and cues."""
    out = Parsed(1_000_000, 0.0, {}, [], [], [])
    segment = cluster_time = 0
    entry: dict = {}
    cue_time, cue_track = 0, 0
    stack: list[tuple[int, int | None]] = []
    blocks: list[tuple[int, int, int, int]] = []
    at, n = 0, len(data)
    while at < n:
        while stack and stack[-1][1] is not None and at >= stack[-1][1]:
            stack.pop()
        start = at
        code, at = _read_vint(data, at, True)
        size, at = _read_vint(data, at, False)
        if code in LEVEL_ONE:  # ends a cluster of unknown size
            while stack and stack[-1][1] is None and stack[-1][0] != SEGMENT:
                stack.pop()
        end = None if size is None else at + size
        if end is not None and end > n:
            raise ValueError(f"element at {start} ends beyond the file")
        if code in PARENTS:
            if code == SEGMENT:
                segment = at
            elif code == CLUSTER_ID:
                out.clusters.append(start)
            elif code == TRACK_ENTRY:
                entry = {}
            stack.append((code, end))
            continue
        if end is None:
            raise ValueError(f"unknown size at {start}")
        if code in (SIMPLE_BLOCK, BLOCK):
            blocks.append((at, end, len(out.clusters) - 1, cluster_time if code == SIMPLE_BLOCK else -cluster_time - 1))
        else:
            value = data[at:end]
            if code == TIMESTAMP:
                cluster_time = int.from_bytes(value, "big")
            elif code == TIMESTAMP_SCALE:
                out.scale = int.from_bytes(value, "big")
            elif code == DURATION:
                out.duration = struct.unpack(">d" if size == 8 else ">f", value)[0]
            elif code == TRACK_NUMBER:
                out.tracks[int.from_bytes(value, "big")] = entry
            elif code == TRACK_TYPE:
                entry["type"] = int.from_bytes(value, "big")
            elif code == CODEC_ID:
                entry["codec"] = value.rstrip(b"\0").decode("ascii", "replace")
            elif code == SAMPLING_FREQUENCY:
                entry["rate"] = struct.unpack(">d" if size == 8 else ">f", value)[0]
            elif code in (CHANNELS, BIT_DEPTH):
                entry["channels" if code == CHANNELS else "bits"] = int.from_bytes(value, "big")
            elif code == CUE_TIME:
                cue_time = int.from_bytes(value, "big")
            elif code == CUE_TRACK:
                cue_track = int.from_bytes(value, "big")
            elif code == CUE_CLUSTER_POSITION:
                out.cues.append((cue_time, cue_track, segment + int.from_bytes(value, "big")))
        at = end
    for at, end, cluster, time in blocks:
        simple, time = time >= 0, time if time >= 0 else -time - 1
        track, at = _read_vint(data, at, False)
        if at + 3 > end:
            raise ValueError(f"block at {at} is cut off")
        relative, flags = struct.unpack(">hB", data[at : at + 3])
        base = (time + relative) * out.scale
        entry = out.tracks.get(track, {})
        step = 1e9 / entry["rate"] / max(1, entry.get("channels", 1) * entry.get("bits", 8) // 8) if entry.get("rate") and entry.get("codec", "").startswith("A_PCM") else 0
        done = 0
        for offset, size in _frames(data, at + 3, end, flags >> 1 & 3):
            out.packets.append((track, base + round(done * step), offset, size, cluster, simple and bool(flags & 0x80)))
            done += size
    out.cues = [(t * out.scale, track, place) for t, track, place in out.cues]
    return out


def read(data: bytes, packets: list[tuple], track: int = 1) -> bytes:
    """The bytes of a track's packets, in order of time."""
    return b"".join(data[p[2] : p[2] + p[3]] for p in sorted(packets, key=lambda p: (p[1], p[2])) if p[0] == track)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text's padded UTF-8 as a Matroska file in a binary column."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, 4 << 20):
            texts = part.column(text_col).to_pylist()
            sizes = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(sizes, pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


PACKETS = "packet int, track int, time_ns long, byte_start long, byte_size long, cluster int, key boolean"


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of every file: the packet table."""
    schema = T.StructType([T.StructField(id_col, media.schema[id_col].dataType), *T._parse_datatype_string(PACKETS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        for part in text_slices(batches, media_col, 4 << 20):
            found = [parse(m or b"").packets for m in part.column(media_col).to_pylist()]
            who = part.column(id_col).take(pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found])))
            rows = [(i, *p) for f in found for i, p in enumerate(f)]
            yield pa.RecordBatch.from_arrays([who, *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds))], schema.names)

    return media.select(id_col, media_col).mapInArrow(run, schema)


def features(parsed: Parsed, payload: bytes) -> str:
    """What the packet table and the samples read back say of a medium, as JSON."""
    samples = np.frombuffer(payload, np.uint8)
    track = parsed.tracks.get(1, {})
    return json.dumps(
        {
            "codec": track.get("codec"),
            "packets": len(parsed.packets),
            "clusters": len(parsed.clusters),
            "cues": len(parsed.cues),
            "duration_ms": parsed.duration * parsed.scale / 1e6,
            "last_ns": parsed.packets[-1][1] if parsed.packets else None,
            "mean": round(float(samples.mean()), 6) if len(samples) else None,
            "deviation": round(float(samples.std()), 6) if len(samples) else None,
            "crossings": int(np.count_nonzero(np.diff(samples >= 128))),
        }
    )


def probe(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Parses every file, reads the track back through the packet table and keeps digests and features."""
    own = T._parse_datatype_string("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    schema = T.StructType([media.schema[id_col], *(media.schema[c] for c in keep), *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, media_col, 4 << 20):
            rows = []
            for m in part.column(media_col).to_pylist():
                parsed = parse(m := m or b"")
                payload = read(m, parsed.packets)
                rows.append((len(payload), sha256(payload), zlib.crc32(payload[-PAD:]), len(m), sha256(m), features(parsed, payload)))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in (id_col, *keep)] + [pa.array(c) for c in zip(*rows)], schema.names)

    return media.select(id_col, *keep, media_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every text stored as Matroska, read back and described."""
    return probe(store(table(spark, sf_dir, "documents")))
