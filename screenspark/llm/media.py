"""Media columns: ISO base media containers, written and walked box by box.

``mux`` stores a payload losslessly as the samples of one uncompressed video track: a
sample is an 8x8 frame of 8-bit RGB, 192 bytes, and every ``KEY_EVERY``-th frame is listed as
a sync sample.  ``probe`` reads any such file: it walks nested boxes, decodes the sample
tables (stts, stsc, stsz, stco/co64, stss) and returns codec, duration and the byte ranges
of key frames without touching the payload.

Payloads are the UTF-8 text followed by bytes 32 up to a positive multiple of 192; null text
is empty, so it and the empty text give one blank frame.  Equal texts give equal files.

Defined results: rows with null or repeated ids are rows of their own; long texts are stored whole, with
64-bit sizes and offsets where needed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, slices, utf8

SIDE = 8
FRAME = SIDE * SIDE * 3
KEY_EVERY = 16
TIMESCALE = 1000
FRAME_TICKS = 40
#: Frames of one chunk in the file.
CHUNK_FRAMES = 64
#: Boxes that only hold other boxes (ISO/IEC 14496-12); fixed values.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """An ISO media file whose samples are ``payload`` (a positive multiple of 192 bytes)."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    ticks = frames * FRAME_TICKS
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    header = 16 if 8 + len(payload) >= 1 << 32 else 8
    wide = len(payload) >= 1 << 31
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    runs = [struct.pack(">3I", 1, min(frames, CHUNK_FRAMES), 1)]
    if chunks > 1 and frames % CHUNK_FRAMES:
        runs.append(struct.pack(">3I", chunks, frames % CHUNK_FRAMES, 1))
    entry = _box(
        b"raw ",
        bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1),
        bytes(32) + struct.pack(">Hh", 24, -1),
    )
    fixed = [
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">3I", 1, frames, FRAME_TICKS)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *runs),
        _full(b"stsz", struct.pack(">2I", FRAME, frames)),
    ]

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK_FRAMES * FRAME)
        table = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), _box(b"stbl", *fixed, table))
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(16), _MATRIX, struct.pack(">2I", SIDE << 16, SIDE << 16), version=1, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    moov = movie(0)
    moov = movie(len(ftyp) + len(moov) + header)
    return b"".join((ftyp, moov, _box(b"mdat", payload)))


def walk(data: memoryview, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """``(path, body start, body end)`` of every box, depth first."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {at} runs out of its parent")
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, here)
        at = stop


def _table(data: memoryview, at: int, columns: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + skip)
    return np.frombuffer(data, dtype=kind, count=n * columns, offset=at + skip + 4).astype(np.int64).reshape(n, columns)


def tracks(data: memoryview) -> list[dict[str, tuple[int, int]]]:
    """The boxes of each track by path, the first of a path."""
    out: list[dict[str, tuple[int, int]]] = []
    for path, a, b in walk(data):
        if path == "/moov/trak":
            out.append({})
        elif path.startswith("/moov/trak/"):
            out[-1].setdefault(path, (a, b))
    return out


def probe(media: bytes) -> dict:
    """Codec, duration, sample and key-frame byte ranges of the first track whose handler is ``vide``.

    A file without such a track raises; samples of movie fragments are not part of the tables and not listed.
    """
    data = memoryview(media)
    video = [t for t in tracks(data) if "/moov/trak/mdia/hdlr" in t and bytes(data[t["/moov/trak/mdia/hdlr"][0] + 8 :][:4]) == b"vide"]
    if not video:
        raise ValueError("the file has no video track")
    boxes = video[0]
    stbl = "/moov/trak/mdia/minf/stbl/"
    a, _ = boxes[stbl + "stsd"]
    codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
    a, _ = boxes["/moov/trak/mdia/mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = boxes[stbl + "stsz"]
    size, count = struct.unpack_from(">2I", data, a + 4)
    sizes = np.full(count, size, dtype=np.int64) if size else _table(data, a, 1, skip=8)[:, 0]
    a, _ = boxes.get(stbl + "co64") or boxes[stbl + "stco"]
    offsets = _table(data, a, 1, ">u8" if stbl + "co64" in boxes else ">u4")[:, 0]
    runs = _table(data, boxes[stbl + "stsc"][0], 3)
    last = np.append(runs[1:, 0], len(offsets) + 1)
    per_chunk = np.repeat(runs[:, 1], last - runs[:, 0])
    chunk_of = np.repeat(np.arange(len(offsets)), per_chunk)[: len(sizes)]
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    first = np.concatenate(([0], np.cumsum(per_chunk)))[:-1]
    starts = offsets[chunk_of] + before - before[np.minimum(first, max(len(sizes) - 1, 0))][chunk_of]
    keys = _table(data, boxes[stbl + "stss"][0], 1)[:, 0] - 1 if stbl + "stss" in boxes else np.arange(len(sizes))
    spans = _table(data, boxes[stbl + "stts"][0], 2)
    return {
        "codec": codec,
        "timescale": int(timescale),
        "duration": int(duration),
        "ticks": int((spans[:, 0] * spans[:, 1]).sum()),
        "starts": starts,
        "sizes": sizes,
        "key_starts": starts[keys],
        "key_ends": starts[keys] + sizes[keys],
    }


def read_samples(media: bytes, info: dict) -> bytes:
    """The samples in order, from the byte ranges that ``probe`` found."""
    starts, ends = info["starts"], info["starts"] + info["sizes"]
    if len(starts) and (starts[1:] == ends[:-1]).all():
        return media[int(starts[0]) : int(ends[-1])]
    return b"".join(media[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def feature(info: dict) -> str:
    ranges = ",".join(f"{a}-{b}" for a, b in zip(info["key_starts"].tolist(), info["key_ends"].tolist(), strict=True))
    return f"codec={info['codec'].strip()};timescale={info['timescale']};duration={info['duration']};samples={len(info['sizes'])};keyframes={len(info['key_starts'])};ranges={ranges}"


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_COLUMNS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("codec", pa.string()),
        ("duration_s", pa.float64()),
        ("n_keyframes", pa.int64()),
    ]
)


def _store(batches):
    for batch in slices(batches):
        texts = utf8(batch)
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array((mux(pad(t)) for t in texts), pa.binary())], schema=_STORED)


def _describe(batches):
    for batch in slices(batches, "media"):
        rows = []
        for doc_id, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            info = probe(media)
            payload = read_samples(media, info)
            rows.append(
                (
                    doc_id,
                    n,
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    feature(info),
                    info["codec"].strip(),
                    info["duration"] / info["timescale"],
                    len(info["key_starts"]),
                )
            )
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], schema=_COLUMNS)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as the samples of an ISO media file."""
    return documents(docs, id_col, text_col).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_columns(stored: DataFrame) -> DataFrame:
    """Columns read back from the ``media`` bytes of ``store_media``."""
    return stored.mapInArrow(
        _describe,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_keyframes long",
    )
