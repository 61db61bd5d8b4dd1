"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

``mux`` puts bytes losslessly into an 8-bit PCM track; ``demux`` parses any Matroska bytes with EBML
variable-length numbers, known and unknown element sizes, all four kinds of lacing and cues.
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

from rowmill.llm.shared import map_batches, utf8

#: Element ids of the Matroska specification (fixed values).
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, TRACKS, TRACK = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, KIND, CODEC, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMECODE, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_AT = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: What may stand beside a cluster: seek head, chapters, attachments and tags have no other use here.
LEVEL_1 = frozenset({INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367})
TOP = frozenset({EBML, SEGMENT})
INSIDE = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_PLACE, EBML}

RATE_HZ, FRAME, LACED, BLOCKS = 8000, 512, 8, 32


@dataclass
class Media:
    """packets: track, timestamp (in scale units), first byte, length, place in its lace; cues: time, track, place of the cluster."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    lacings: set[int] = field(default_factory=set)


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length number and where it ends; all ones (unknown) gives None."""
    first = data[at]
    if not first:
        raise ValueError("a number longer than eight bytes")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError("the data end inside a number")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def as_vint(value: int, width: int = 0) -> bytes:
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + as_vint(len(body)) + body


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and body: none for one frame, fixed for equal frames, else EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 2, head + b"".join(frames)
    head += as_vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        n = next(n for n in range(1, 9) if abs(b - a) <= (1 << 7 * n - 1) - 1)
        head += as_vint(b - a + (1 << 7 * n - 1) - 1, n)
    return 3, head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """Frames of ``FRAME`` samples, ``LACED`` to a block, ``BLOCKS`` blocks to a cluster; no clock and no random ids, so equal payloads give equal bytes."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    track = element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE_HZ) + audio)
    body = element(INFO, uint(SCALE, 1_000_000)) + element(TRACKS, track)
    cues, per = [], FRAME * LACED * BLOCKS
    parts, length = [body], len(body)
    for at in range(0, len(payload), per):
        start = at * 1000 // RATE_HZ
        inner = [uint(TIMECODE, start)]
        for lo in range(at, min(at + per, len(payload)), FRAME * LACED):
            flag, block = laced([payload[i : min(i + FRAME, len(payload))] for i in range(lo, min(lo + FRAME * LACED, len(payload)), FRAME)])
            inner.append(element(SIMPLE, b"\x81" + struct.pack(">hB", lo * 1000 // RATE_HZ - start, 0x80 | flag << 1) + block))
        cues.append(element(CUE, uint(CUE_TIME, start) + element(CUE_PLACE, uint(CUE_TRACK, 1) + uint(CUE_AT, length))))
        parts.append(element(CLUSTER, b"".join(inner)))
        length += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, first byte, end, whether the size is known) of the elements in a range; an unknown size reaches to the range's end."""
    while at < end:
        kind, at = vint(data, at, True)
        size, at = vint(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError("an element is longer than its parent")
        yield kind, at, stop, size is not None
        at = stop


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, lacing and byte ranges of a block."""
    track, at = vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at, lacing = at + 3, flags >> 1 & 3
    if not lacing:
        return track, time, 0, [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3:
        size, at = vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            raw = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
            at += width
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
        sizes = sizes[: n - 1]
    else:
        sizes = [(end - at) // n] * (n - 1)
    spans = []
    for size in sizes:
        spans.append((at, at + size))
        at += size
    if at > end or any(s < 0 for s in sizes):
        raise ValueError("frames are longer than their block")
    return track, time, lacing, [*spans, (at, end)]


def demux(data: bytes) -> Media:
    """Everything in the data; ValueError, IndexError or struct.error where they are damaged."""
    media, now, base = Media(), 0, 0

    def number(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def walk(a: int, b: int, into: dict, until: frozenset[int] = frozenset()) -> int:
        """Reads a range and returns where it ends: at ``b``, or before the first element whose id is in ``until``."""
        nonlocal now, base
        while a < b:
            kind, lo, hi, sized = next(elements(data, a, b))
            if kind in until:
                return a
            if kind == SEGMENT:
                base = lo
            if kind == CLUSTER:
                media.clusters.append(lo)
            if kind in (SIMPLE, BLOCK):
                track, time, lacing, spans = frames(data, lo, hi)
                media.lacings.add(lacing)
                step = media.tracks.get(track, {}).get(DEFAULT_DURATION, 0) / media.scale
                media.packets += [(track, int(now + time + i * step), x, y - x, i) for i, (x, y) in enumerate(spans)]
            elif kind == TRACK:
                own: dict = {}
                walk(lo, hi, own)
                media.tracks[own.get(NUMBER, 0)] = own
            elif kind == CUE:
                own = {}
                walk(lo, hi, own)
                media.cues.append((own.get(CUE_TIME, 0), own.get(CUE_TRACK, 0), base + own.get(CUE_AT, 0)))
            elif kind in INSIDE:
                # a cluster of unknown size ends where its next sibling begins, a segment where the next stream does
                hi = walk(lo, hi, into, frozenset() if sized else (TOP if kind == SEGMENT else TOP | LEVEL_1))
            elif kind == TIMECODE:
                now = number(lo, hi)
            elif kind == SCALE:
                media.scale = number(lo, hi)
            elif kind == CODEC:
                into[kind] = data[lo:hi].decode("ascii", "replace")
            elif kind == RATE:
                into[kind] = struct.unpack(">d" if hi - lo == 8 else ">f", data[lo:hi])[0]
            elif kind in (NUMBER, UID, KIND, DEFAULT_DURATION, CHANNELS, DEPTH, CUE_TIME, CUE_TRACK, CUE_AT):
                into[kind] = number(lo, hi)
            a = hi
        return b

    walk(0, len(data), {})
    return media


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[at : at + n] for t, _, at, n, _ in media.packets if t == track])


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a Matroska file.

    One row per row of ``docs``, repeated rows included; a null or empty text is stored as 64 zeros. An
    empty table gives an empty one. Other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, track, timestamp_ms, first_byte, length, in_lace, error: the packet table of a media column.

    Null or empty media have no packets. Damaged media give one row that holds only the key and what
    is wrong with them; ``error`` is null in all other rows. Repeated rows give their packets each.
    Other columns of ``media`` are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, at = [], []
        for i, data in enumerate(batch.column("media").to_pylist()):
            try:
                parsed = demux(data) if data else Media()
                found = [(t, time * parsed.scale // 1_000_000, first, n, k, None) for t, time, first, n, k in parsed.packets]
            except (ValueError, IndexError, struct.error) as e:
                found = [(None, None, None, None, None, str(e))]
            rows += found
            at += [i] * len(found)
        cols = [pa.array([r[j] for r in rows], pa.int64()) for j in range(5)]
        errors = pa.array([r[5] for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()).take(pa.array(at, pa.int64())), *cols, errors], names=[key, "track", "timestamp_ms", "first_byte", "length", "in_lace", "error"])

    return map_batches(media.select(key, "media"), run, f"{key} long, track long, timestamp_ms long, first_byte long, length long, in_lace long, error string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: one row per row of ``docs``.

    Everything but n_bytes comes from the packets that ``demux`` finds in the stored bytes. A null or
    empty text is stored as 64 zeros. feature: codec, packets, clusters, cues that point at a cluster,
    kinds of lacing, last timestamp, peak and mean distance of the samples from 128. Equal texts give
    equal values; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in batch.column("media").to_pylist():
            media = demux(data)
            payload = samples(data, media)
            x = np.abs(np.frombuffer(payload, np.uint8).astype(np.int16) - 128)
            at_cluster = sum(data[p : p + 4] == CLUSTER.to_bytes(4, "big") for _, _, p in media.cues)
            feature = f"{media.tracks[1][CODEC]};packets={len(media.packets)};clusters={len(media.clusters)};cues={at_cluster};lacing={''.join(map(str, sorted(media.lacings)))};last_ms={media.packets[-1][1]};peak={int(x.max())};level={int(x.sum()) * 1000 // len(x)}"
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    return map_batches(with_media(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
