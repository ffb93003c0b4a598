"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, timestamps.

``store`` writes each text's bytes, padded to a positive multiple of 64, as 8-bit samples of two channels:
even bytes go to one logical stream, odd bytes to the other, and the streams' pages alternate in one
physical stream.  ``read_back`` takes stored bytes apart again: it checks every page's checksum and number,
puts packets together from lacing values over page borders, separates the streams by serial number, and
dates each packet from the granule positions; then it joins the channels and computes features.

A damaged page is left out and named in ``problems``; what the other pages hold is still read: granule positions say
where each packet's samples stand, so the payload has its length, zeros where nothing was read, and ``gaps`` names those
ranges. Nothing is decoded row by row outside its own bytes, so a task's memory is bounded by a batch of texts.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal bytes; null media, and media without any
channel's header, have no payload and a problem that says so; of a channel without its header everything is a gap; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import slices

BLOCK = 64
RATE = 8000
CHANNELS = 2
#: Samples of one packet; with 255 bytes a lacing value, packets run over page borders.
PACKET = 6000
MAGIC = b"SMP8"
#: Header of a page: capture pattern, version, flags, granule position, serial, page number, checksum, segments.
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, no inversion.

    zlib's CRC is the same polynomial with bits mirrored and inverted at both ends.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: list[int], body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + bytes(lacing)
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """A logical stream's pages; packets are (bytes, granule position at their end). The first has its own page."""
    out: list[bytes] = []
    lacing: list[int] = []
    body: list[bytes] = []
    granule, continued = -1, False

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = CONTINUED * continued | FIRST * (not out) | LAST * last
        out.append(_page(serial, len(out), flags, granule, lacing, b"".join(body)))
        lacing, body, granule, continued = [], [], -1, goes_on

    for k, (data, end) in enumerate(packets):
        final = k == len(packets) - 1
        at = 0
        while True:
            if len(lacing) == 255:
                flush(False, at > 0)
            n = min(255, len(data) - at)
            lacing.append(n)
            body.append(data[at : at + n])
            at += n
            if n < 255:
                break
        granule = end
        if k == 0 or final:
            flush(final, False)
    return out


def write_media(payload: bytes) -> bytes:
    """An Ogg physical stream with the payload's samples, one logical stream a channel, pages alternating."""
    serial = zlib.crc32(payload) & 0x7FFFFFFE
    streams = []
    for c in range(CHANNELS):
        samples = payload[c::CHANNELS]
        head = MAGIC + struct.pack("<BBIQ", c, CHANNELS, RATE, len(samples))
        packets = [(head, 0), *((samples[i : i + PACKET], min(i + PACKET, len(samples))) for i in range(0, len(samples), PACKET))]
        streams.append(pages_of(serial + c, packets))
    longest = max(map(len, streams))
    return b"".join(s[i] for i in range(longest) for s in streams if i < len(s))


@dataclass
class Stream:
    """One logical stream as read: packets with the granule position at their end, None where unknown."""

    packets: list[tuple[bytes, int | None]] = field(default_factory=list)
    number: int = -1
    open: bytes | None = None
    ended: bool = False


def read_pages(media: bytes) -> tuple[dict[int, Stream], int, list[str]]:
    """Logical streams by serial number, the count of good pages, and problems."""
    streams: dict[int, Stream] = {}
    problems: list[str] = []
    good, at = 0, 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + PAGE.size > len(media):
            found = media.find(b"OggS", at + 1)
            problems.append(f"no page at {at}")
            if found < 0:
                break
            at = found
            continue
        _, _, flags, granule, serial, number, crc, segments = PAGE.unpack_from(media, at)
        lacing = media[at + PAGE.size : at + PAGE.size + segments]
        size = PAGE.size + segments + sum(lacing)
        page = media[at : at + size]
        if len(page) < size or len(lacing) < segments or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            problems.append(f"bad checksum at {at}")
            at += 4
            continue
        good += 1
        stream = streams.setdefault(serial, Stream())
        if number != stream.number + 1:
            problems.append(f"stream {serial}: page {stream.number + 1} is missing")
            stream.open = None
        stream.number, stream.ended = number, bool(flags & LAST)
        pending = stream.open if flags & CONTINUED else None
        skip = bool(flags & CONTINUED) and pending is None
        data = pending or b""
        done: list[bytes] = []
        pos, parts = PAGE.size + segments, [data]
        for n in lacing:
            parts.append(page[pos : pos + n])
            pos += n
            if n < 255:
                if not skip:
                    done.append(b"".join(parts))
                skip, parts = False, []
        stream.open = b"".join(parts) if lacing and lacing[-1] == 255 and not skip else None
        end: int | None = granule if granule >= 0 else None
        dated: list[tuple[bytes, int | None]] = []
        for packet in reversed(done):
            dated.append((packet, end))
            end = None if end is None else end - len(packet)
        stream.packets += reversed(dated)
        at += size
    problems += [f"stream {s}: no last page" for s, x in streams.items() if not x.ended]
    return streams, good, problems


def placed(packets: list[tuple[bytes, int | None]], samples: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A channel's samples with each packet where its granule position says, and the (start, length) of what no packet gives.

    A packet without a position follows the one before it.
    """
    out, known, at = np.zeros(samples, np.uint8), np.zeros(samples, bool), 0
    for packet, end in packets:
        start = at if end is None else end - len(packet)
        at = start + len(packet)
        own = slice(max(0, start), min(samples, at))
        out[own] = np.frombuffer(packet, np.uint8)[own.start - start : own.stop - start]
        known[own] = True
    edges = np.flatnonzero(np.diff(np.r_[True, known, True].astype(np.int8)))
    return out, [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def read_media(media: bytes | None) -> tuple[bytes | None, str, list[tuple[int, float, int]], list[str], list[tuple[int, int, int]]]:
    """Payload, feature, (channel, seconds at the end, bytes) of each packet, problems, and (channel, start, length) of gaps."""
    if media is None:
        return None, "", [], ["no data"], []
    streams, pages, problems = read_pages(media)
    channels: dict[int, np.ndarray] = {}
    gaps: list[tuple[int, int, int]] = []
    times: list[tuple[int, float, int]] = []
    for serial in sorted(streams):
        packets = streams[serial].packets
        if not packets or packets[0][0][:4] != MAGIC:
            problems.append(f"stream {serial}: no header")
            continue
        c, _, rate, samples = struct.unpack_from("<BBIQ", packets[0][0], 4)
        if c >= CHANNELS or samples > CHANNELS * BLOCK * len(media):  # no writer says so; a header is not trusted beyond its media
            problems.append(f"stream {serial}: a header of {samples} samples for channel {c}")
            continue
        channels[c], missing = placed(packets[1:], samples)
        gaps += [(c, start, length) for start, length in missing]
        times += [(c, -1.0 if end is None else end / rate, len(p)) for p, end in packets[1:]]
        if missing:
            problems.append(f"stream {serial}: {samples - sum(n for _, n in missing)} of {samples} samples")
    if not channels:
        return None, "", times, problems or ["no channel"], []
    longest = max(map(len, channels.values()))
    for c in set(range(CHANNELS)) - set(channels):
        problems.append(f"channel {c} is missing")
        gaps.append((c, 0, longest))
    both = np.zeros(CHANNELS * longest, dtype=np.uint8)
    for c, samples in channels.items():
        both[c::CHANNELS][: len(samples)] = samples
    centred = both.astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(centred))))
    feature = (
        f"seconds={max((t for _, t, _ in times), default=0.0):.6f};pages={pages};packets={len(times)};"
        f"rms={float(np.sqrt(np.mean(centred * centred))):.4f};peak={int(np.abs(centred).max())};crossings={crossings}"
    )
    return both.tobytes(), feature, times, problems, sorted(gaps)


def store(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_bytes (of the text) and media (Ogg bytes) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [(t or "").encode() for t in batch.column("_text").to_pylist()]
            media = [write_media(b + bytes(-len(b) % BLOCK or (BLOCK if not b else 0))) for b in raw]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=[*batch.schema.names[:-1], "n_bytes", "media"]
            )

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{fields}, n_bytes bigint, media binary")


def read_back(stored: DataFrame, media: str = "media") -> DataFrame:
    """stored with payload, feature, packet times, problems and gaps, all from the stored bytes."""
    names = [c for c in stored.columns if c in ("payload", "feature", "packets", "problems", "gaps")]
    if names:
        raise ValueError(f"columns exist already: {names}")
    gap_type = pa.list_(pa.struct([("channel", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
    time_type = pa.list_(pa.struct([("channel", pa.int32()), ("seconds", pa.float64()), ("bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            read = [read_media(m) for m in batch.column(media).to_pylist()]
            times = [[{"channel": c, "seconds": s, "bytes": n} for c, s, n in r[2]] for r in read]
            made = [pa.array([r[0] for r in read], pa.binary()), pa.array([r[1] for r in read], pa.string()), pa.array(times, time_type), pa.array([r[3] for r in read], pa.list_(pa.string()))]
            made.append(pa.array([[{"channel": c, "start": s, "length": n} for c, s, n in r[4]] for r in read], gap_type))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "payload", "feature", "packets", "problems", "gaps"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    more = "payload binary, feature string, packets array<struct<channel:int,seconds:double,bytes:bigint>>, problems array<string>, gaps array<struct<channel:int,start:bigint,length:bigint>>"
    return stored.mapInArrow(run, f"{fields}, {more}")
