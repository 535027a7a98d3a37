"""ISO base media columns: texts stored as samples of a one-track container, and containers described by walking boxes.

``pack`` writes a payload losslessly into ``ftyp moov mdat`` with 64-byte samples; ``describe`` walks the nested boxes
of any container, decodes the sample tables (stsd, stts, stsc, stsz, stco/co64, stss) and returns codec, duration and
the byte range of every sample and of every key frame, without decoding a payload. ``store_texts`` packs every text of
a table, reads the stored bytes back through ``describe`` and computes features.

Edge cases: null text is empty; an empty text is one sample of zero bytes' padding; equal texts give equal values; a
box that runs past its parent, or a table shorter than its count, raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from assetlens.llm.runtime import id_and_text

SAMPLE = 64
KEY_EVERY = 16
CHUNK_SAMPLES = 256
TIMESCALE = 8000
# Boxes of the format that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, codec string, duration double, keyframes int, key_ranges_sha256 string"
)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return head + b"".join(parts)


def full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pack(payload: bytes) -> bytes:
    """A container with one raw 8-bit audio track; the payload is a positive multiple of SAMPLE bytes."""
    n = len(payload) // SAMPLE
    if not n or len(payload) % SAMPLE:
        raise ValueError("a payload is a positive multiple of the sample size")
    chunks = -(-n // CHUNK_SAMPLES)
    ticks = n * SAMPLE
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(base: int) -> bytes:
        offsets = [base + i * CHUNK_SAMPLES * SAMPLE for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
        runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 else []
        if n % CHUNK_SAMPLES or chunks == 1:
            runs.append((chunks, n - (chunks - 1) * CHUNK_SAMPLES, 1))
        keys = range(1, n + 1, KEY_EVERY)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", bytes(8) + struct.pack(">II", TIMESCALE, min(ticks, 0xFFFFFFFF)) + struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"text bytes\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, min(ticks, 0xFFFFFFFF)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), IDENTITY, bytes(8), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, min(ticks, 0xFFFFFFFF), 0x10000, 0x100), bytes(10), IDENTITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))  # the size doesn't depend on the offsets' values below 4 GiB
    return b"".join((ftyp, moov(len(ftyp) + size + head), box(b"mdat", payload)))


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start of content, end) of every box, containers before what they hold."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            raise ValueError("a box runs past its parent")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def describe(data: bytes) -> dict:
    """codec, duration, sample and key-frame byte ranges (offset, length) of the first track."""
    found: dict[bytes, tuple[int, int]] = {}
    for path, a, b in walk(data):
        found.setdefault(path[-1], (a, b))

    def longs(kind: bytes, per: int, skip: int = 4, code: str = "I", count_at: int | None = None) -> list[tuple]:
        a, b = found[kind]
        n = struct.unpack_from(">I", data, a + (count_at or skip))[0]
        first = a + (count_at or skip) + 4
        if first + n * per * struct.calcsize(f">{code}") > b:
            raise ValueError("a sample table is shorter than its count")
        flat = struct.unpack_from(f">{n * per}{code}", data, first)
        return [flat[i:i + per] for i in range(0, n * per, per)]

    a = found[b"stsd"][0]
    codec = bytes(data[a + 12:a + 16]).decode("latin-1").strip()
    a = found[b"mdhd"][0]
    version = data[a]
    timescale = struct.unpack_from(">I", data, a + (20 if version else 12))[0]
    times = longs(b"stts", 2)
    duration = sum(n * d for n, d in times) / timescale if timescale else 0.0
    fixed, count = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
    sizes = [fixed] * count if fixed else [s for s, in longs(b"stsz", 1, count_at=8)]
    offsets = [o for o, in (longs(b"co64", 1, code="Q") if b"co64" in found else longs(b"stco", 1))]
    runs = longs(b"stsc", 3)
    ranges, k = [], 0
    for i, (first, per, _) in enumerate(runs):
        for chunk in range(first - 1, runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)):
            at = offsets[chunk]
            for _ in range(min(per, len(sizes) - k)):
                ranges.append((at, sizes[k]))
                at += sizes[k]
                k += 1
    if k != len(sizes):
        raise ValueError("the chunk table holds fewer samples than the size table")
    keys = [ranges[i - 1] for i, in longs(b"stss", 1)] if b"stss" in found else list(ranges)
    return {"codec": codec, "duration": duration, "ranges": ranges, "keys": keys, "timescale": timescale}


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Adjacent byte ranges made one, so that a read needs few slices."""
    out: list[tuple[int, int]] = []
    for at, n in ranges:
        if out and out[-1][0] + out[-1][1] == at:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((at, n))
    return out


def store(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    payload = raw + bytes(-len(raw) % SAMPLE or (0 if raw else SAMPLE))
    media = pack(payload)
    seen = describe(media)
    back = b"".join(media[a:a + n] for a, n in joined(seen["ranges"]))
    keys = seen["keys"]
    ranges = ",".join(f"{a}+{n}" for a, n in keys)
    feature = f"codec={seen['codec']};duration={seen['duration']:.6f};samples={len(seen['ranges'])};keyframes={len(keys)};first_key={keys[0][0]}+{keys[0][1]};last_key={keys[-1][0]}+{keys[-1][1]};mean={sum(back) / len(back):.6f}"
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, seen["codec"], seen["duration"], len(keys), hashlib.sha256(ranges.encode()).hexdigest(),
    )


def store_texts(docs: DataFrame) -> DataFrame:
    names = SCHEMA.replace(",", "").split()[0::2]

    def batches(frames):
        for frame in frames:
            yield pd.DataFrame([(i, *store(t)) for i, t in zip(frame["doc_id"].array, frame["text"])], columns=names).astype({"doc_id": "Int64"})

    return id_and_text(docs).mapInPandas(batches, SCHEMA)
