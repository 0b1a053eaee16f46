"""Matroska: a writer for 8-bit samples and a parser into packet tables.

The parser walks variable-length EBML elements (unknown sizes included), reads tracks, clusters, SimpleBlocks and
BlockGroups, undoes Xiph, EBML and fixed lacing, and gives one packet a frame with track, timestamp and byte range, and
the cues. A damaged or cut file gives the packets up to the damage and an error text, never an exception.

Edge cases: null text counts as empty, and the payload of an empty text is 64 zero bytes; equal texts give equal values;
null content parses to no packets with error ``empty``; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: element ids.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, LACING = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, RATE, CHANNELS, DEPTH, CLUSTER, TIME, SIMPLE, GROUP, BLOCK, DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

FRAME, FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER, HZ = 1024, 8, 16, 8000


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _element(x: int, body: bytes) -> bytes:
    return _id(x) + _size(len(body)) + body


def _uint(x: int, value: int) -> bytes:
    return _element(x, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _ebml_lace(sizes: list[int]) -> bytes:
    out = _size(sizes[0])
    for last, now in zip(sizes, sizes[1:-1]):
        diff, length = now - last, 1
        while not -(1 << 7 * length - 1) < diff < (1 << 7 * length - 1):
            length += 1
        out += (diff + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return out


def write_matroska(samples: bytes, hz: int = HZ) -> bytes:
    """One mono track of unsigned 8-bit samples; frames of 1,024 samples, laced eight to a block, a cue for each cluster."""
    np_rate = np.array([hz], ">f8").tobytes()
    head = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(0x4D80, b"linkloom") + _element(0x5741, b"linkloom"))
    entry = _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, np_rate) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    body = [info, _element(TRACKS, _element(ENTRY, entry))]
    at, cues = sum(map(len, body)), []
    per_block = FRAME * FRAMES_IN_BLOCK
    for c in range(0, len(samples), per_block * BLOCKS_IN_CLUSTER):
        start_ms = c * 1000 // hz
        parts = [_uint(TIME, start_ms)]
        for b in range(c, min(len(samples), c + per_block * BLOCKS_IN_CLUSTER), per_block):
            chunk = samples[b : b + per_block]
            frames = [chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)]
            lead = b"\x81" + (b * 1000 // hz - start_ms).to_bytes(2, "big", signed=True)
            if len(frames) == 1:
                body_block = lead + b"\x80" + chunk
            elif len(frames[-1]) == FRAME:
                body_block = lead + b"\x84" + bytes([len(frames) - 1]) + chunk
            else:
                body_block = lead + b"\x86" + bytes([len(frames) - 1]) + _ebml_lace([len(f) for f in frames]) + chunk
            parts.append(_element(SIMPLE, body_block))
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(POINT, _uint(CUE_TIME, start_ms) + _element(POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(body))


@dataclass
class Parsed:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, str]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    error: str = ""


def read_vint(buf, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, position after it, and whether all value bits are ones (the unknown size)."""
    if at >= end or not buf[at]:
        raise ValueError(f"bad variable-length integer at byte {at}")
    length = 9 - buf[at].bit_length()
    if at + length > end:
        raise ValueError(f"cut variable-length integer at byte {at}")
    raw = int.from_bytes(buf[at : at + length], "big")
    value = raw & (1 << 7 * length) - 1
    return (raw if keep_marker else value), at + length, value == (1 << 7 * length) - 1


def _children(buf, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    while at < end:
        key, pos, _ = read_vint(buf, at, end, True)
        size, pos, unknown = read_vint(buf, pos, end)
        if unknown:
            stop = end
        elif pos + size > end:
            yield key, pos, end, True
            raise ValueError(f"element {key:X} at byte {at} runs over its parent's end")
        else:
            stop = pos + size
        cut = yield key, pos, stop, unknown
        at = stop if cut is None else cut


def _number(buf, at: int, end: int) -> int:
    return int.from_bytes(buf[at:end], "big")


def _block(buf, at: int, end: int, cluster_time: int, keyframe: bool | None, out: Parsed) -> None:
    track, at, _ = read_vint(buf, at, end)
    if at + 3 > end:
        raise ValueError(f"cut block at byte {at}")
    relative, flags = int.from_bytes(buf[at : at + 2], "big", signed=True), buf[at + 2]
    at += 3
    key = bool(flags & 0x80) if keyframe is None else keyframe
    kind = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    sizes: list[int] = []
    if kind == "none":
        sizes = [end - at]
    else:
        if at >= end:
            raise ValueError(f"cut lacing at byte {at}")
        count = buf[at] + 1
        at += 1
        if kind == "xiph":
            for _ in range(count - 1):
                n = 0
                while True:
                    if at >= end:
                        raise ValueError(f"cut lacing at byte {at}")
                    n += buf[at]
                    at += 1
                    if buf[at - 1] != 255:
                        break
                sizes.append(n)
        elif kind == "ebml":
            for i in range(count - 1):
                began = at
                n, at, _ = read_vint(buf, at, end)
                sizes.append(n if not i else sizes[-1] + n - ((1 << 7 * (at - began) - 1) - 1))
        else:
            sizes = [(end - at) // count] * (count - 1)
            if (end - at) % count:
                raise ValueError(f"fixed lacing at byte {at} doesn't divide the block")
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError(f"lacing at byte {at} runs over the block")
    lead = next((t["frame_ns"] for t in out.tracks if t["number"] == track), 0)
    base, done = (cluster_time + relative) * out.scale, 0
    entry = next((t for t in out.tracks if t["number"] == track), None)
    for size in sizes:
        step = done * 1_000_000_000 // int(entry["rate"]) if entry and entry["rate"] and entry["depth"] == 8 and entry["channels"] == 1 else lead
        out.packets.append((track, base + step, at, size, key, kind))
        at += size
        done += size


def parse_matroska(buf: bytes | None) -> Parsed:
    """Tracks, packets (track, timestamp ns, first byte, bytes, keyframe, lacing) and cues (time, track, byte of the cluster)."""
    out = Parsed()
    if not buf:
        out.error = "empty"
        return out
    try:
        for key, at, end, _ in _children(buf, 0, len(buf)):
            if key == EBML:
                for k, a, e, _ in _children(buf, at, end):
                    if k == DOC_TYPE:
                        out.doc_type = bytes(buf[a:e]).decode("latin1").rstrip("\0")
            elif key == SEGMENT:
                _segment(buf, at, end, out)
    except (ValueError, OverflowError) as x:
        out.error = str(x)
    return out


def _segment(buf, start: int, end: int, out: Parsed) -> None:
    walk = _children(buf, start, end)
    cut = None
    while True:
        try:
            key, a, e, unknown = walk.send(cut)
        except StopIteration:
            return
        cut = None
        if key == INFO:
            for k, x, y, _ in _children(buf, a, e):
                if k == SCALE:
                    out.scale = _number(buf, x, y)
        elif key == TRACKS:
            for k, x, y, _ in _children(buf, a, e):
                if k == ENTRY:
                    out.tracks.append(_track(buf, x, y))
        elif key == CLUSTER:
            cut = _cluster(buf, a, e, unknown, out)
        elif key == CUES:
            for k, x, y, _ in _children(buf, a, e):
                if k == POINT:
                    time = 0
                    for k2, x2, y2, _ in _children(buf, x, y):
                        if k2 == CUE_TIME:
                            time = _number(buf, x2, y2)
                        elif k2 == POSITIONS:
                            got = {k3: _number(buf, x3, y3) for k3, x3, y3, _ in _children(buf, x2, y2)}
                            out.cues.append((time * out.scale, got.get(CUE_TRACK, 0), start + got.get(CUE_CLUSTER, 0)))


def _cluster(buf, at: int, end: int, unknown: bool, out: Parsed) -> int | None:
    """Of an unknown-sized cluster, where it ended: at the next element that can't be inside one."""
    time = 0
    while at < end:
        key, pos, _ = read_vint(buf, at, end, True)
        if unknown and key in TOP:
            return at
        size, pos, _ = read_vint(buf, pos, end)
        stop = pos + size
        if stop > end:
            raise ValueError(f"element {key:X} at byte {at} runs over its cluster's end")
        if key == TIME:
            time = _number(buf, pos, stop)
        elif key == SIMPLE:
            _block(buf, pos, stop, time, None, out)
        elif key == GROUP:
            inner = list(_children(buf, pos, stop))
            keyframe = not any(k == 0xFB for k, *_ in inner)
            for k, x, y, _ in inner:
                if k == BLOCK:
                    _block(buf, x, y, time, keyframe, out)
        at = stop
    return at if unknown else None


def _track(buf, at: int, end: int) -> dict:
    out = {"number": 0, "kind": 0, "codec": "", "rate": 0.0, "channels": 1, "depth": 0, "frame_ns": 0}
    for k, a, e, _ in _children(buf, at, end):
        if k == NUMBER:
            out["number"] = _number(buf, a, e)
        elif k == KIND:
            out["kind"] = _number(buf, a, e)
        elif k == CODEC:
            out["codec"] = bytes(buf[a:e]).decode("latin1")
        elif k == AUDIO:
            for k2, x, y, _ in _children(buf, a, e):
                if k2 == RATE:
                    out["rate"] = float(np.frombuffer(buf[x:y], ">f8" if y - x == 8 else ">f4")[0]) if y - x in (4, 8) else 0.0
                elif k2 == CHANNELS:
                    out["channels"] = _number(buf, x, y)
                elif k2 == DEPTH:
                    out["depth"] = _number(buf, x, y)
    return out


def packet_table(media: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, packet, track, timestamp_ns, first_byte, n_bytes, keyframe, lacing; a file without packets has no row."""
    schema = pa.schema([("doc_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("first_byte", pa.int64()), ("n_bytes", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                packets = parse_matroska(content.as_py()).packets
                for i in range(0, len(packets), 50_000):
                    rows = [(doc, i + j, *p) for j, p in enumerate(packets[i : i + 50_000])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).alias("content")).mapInArrow(run, "doc_id long, packet int, track int, timestamp_ns long, first_byte long, n_bytes long, keyframe boolean, lacing string")


def cue_table(media: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, cue, timestamp_ns, track, cluster_byte."""
    schema = pa.schema([("doc_id", pa.int64()), ("cue", pa.int32()), ("timestamp_ns", pa.int64()), ("track", pa.int32()), ("cluster_byte", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(doc, i, *c) for i, c in enumerate(parse_matroska(content.as_py()).cues)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).alias("content")).mapInArrow(run, "doc_id long, cue int, timestamp_ns long, track int, cluster_byte long")


def media_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def media_features(samples: np.ndarray, parsed: Parsed, hz: int = HZ) -> str:
    """Whole numbers only, so that they agree everywhere: packets, duration, level, power, zero crossings."""
    centred = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    return f"packets={len(parsed.packets)};cues={len(parsed.cues)};ms={len(samples) * 1000 // hz};sum={int(centred.sum())};power={int((centred * centred).sum())};peak={int(np.abs(centred).max())};crossings={crossings}"


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as samples in a Matroska file, parses the file and digests what was read back. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, payload = media_payload(text.as_py())
                stored = write_matroska(payload)
                parsed = parse_matroska(stored)
                if parsed.error:
                    raise ValueError(parsed.error)
                back = b"".join([stored[at : at + size] for _, _, at, size, _, _ in parsed.packets])
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media_features(np.frombuffer(back, np.uint8), parsed)))
            columns = list(zip(*rows)) if rows else [[] for _ in range(len(_MEDIA) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(_MEDIA)[1:])]], schema=_MEDIA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
