"""Media columns: payloads in ISO media containers, and what a box walk tells of them.

A payload becomes a file of one raw 8-bit video track: 24 x 24 samples a frame (576 bytes), a key frame at the start
of each chunk. Reading walks nested boxes and decodes the sample tables, those of fragments too; frames are never
decoded. A track lasts as long as its samples do, whatever its header says.

Defined results: null text is empty; an empty text has one frame of padding; equal texts give equal bytes; columns
other than doc_id and text are ignored; repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.base import slices, staged, table

SIDE = 24
FRAME_BYTES = SIDE * SIDE
PADDING = b"\xff"
FRAMES_A_SECOND = 25
FRAMES_A_CHUNK = 12
#: Boxes that hold boxes, and how many bytes of fields stand before those.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"dref": 8, b"stsd": 8}
UNIT_MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def padded(data: bytes, unit: int = FRAME_BYTES) -> bytes:
    """data filled up to a positive multiple of unit."""
    return data + PADDING * (-len(data) % unit if data else unit)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, frame_bytes: int = FRAME_BYTES, side: int = SIDE, chunk: int = FRAMES_A_CHUNK, rate: int = FRAMES_A_SECOND) -> bytes:
    """An ISO media file whose only track has the payload's bytes as its frames."""
    n = len(payload) // frame_bytes
    if n < 1 or n * frame_bytes != len(payload):
        raise ValueError("the payload must be whole frames")
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    wide = len(payload) + 16 > 0xFFFFFFFF
    data_at = len(kind) + (16 if wide else 8)
    data = (struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")) + payload
    chunks = -(-n // chunk)
    starts = data_at + np.arange(chunks, dtype=np.int64) * (chunk * frame_bytes)
    runs = [(1, min(chunk, n), 1)] + ([(chunks, n % chunk, 1)] if chunks > 1 and n % chunk else [])
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", side, side), struct.pack(">III", 72 << 16, 72 << 16, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", frame_bytes, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.astype(">i8" if wide else ">u4").tobytes()),
        _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * chunk + 1).astype(">u4").tobytes()),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)),
        _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables),
    )
    header = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n, 1 << 16, 1 << 8), bytes(10), UNIT_MATRIX, bytes(24), struct.pack(">I", 2))
    track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), UNIT_MATRIX, struct.pack(">II", side << 16, side << 16), flags=7)
    return kind + data + _box(b"moov", header, _box(b"trak", track, media))


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of each box's body, outer before inner. A size of 1 means 64 bits follow, 0 the rest."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in NESTED:
            yield from boxes(data, start + head + NESTED[kind], start + size, here)
        start += size


def _numbers(data: memoryview, at: int, kind: str) -> np.ndarray:
    """The table that a count of entries precedes."""
    per = kind.count("u4") + 2 * kind.count("u8")
    n = struct.unpack_from(">I", data, at)[0]
    return np.frombuffer(data, ">u8" if "u8" in kind else ">u4", n * (1 if "u8" in kind else per), at + 4).astype(np.int64).reshape(n, -1)


def _table_samples(data: memoryview, at: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(offset, size, duration, key frame) of each sample of the track's own tables, and how many each chunk has."""
    size, n = struct.unpack_from(">II", data, at[b"stsz"] + 4)
    sizes = np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, at[b"stsz"] + 12).astype(np.int64)
    times = _numbers(data, at[b"stts"] + 4, "u4u4")
    lasts = np.repeat(times[:, 1], times[:, 0])
    starts = (_numbers(data, at[b"co64"] + 4, "u8") if b"co64" in at else _numbers(data, at[b"stco"] + 4, "u4"))[:, 0]
    runs = _numbers(data, at[b"stsc"] + 4, "u4u4u4")
    spans = np.diff(np.append(runs[:, 0], len(starts) + 1))
    per_chunk = np.repeat(runs[:, 1], spans)
    if not len(sizes) == len(lasts) == per_chunk.sum():
        raise ValueError("the sample tables don't agree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = np.repeat(starts, per_chunk) + before - before[np.repeat(first, per_chunk)]
    keys = np.zeros(n, np.int64) if b"stss" in at else np.ones(n, np.int64)
    if b"stss" in at:
        keys[_numbers(data, at[b"stss"] + 4, "u4")[:, 0] - 1] = 1
    return np.stack([offsets, sizes, lasts, keys], 1), per_chunk


#: Fields of a fragment's header that may stand before its defaults, and of a run's entries: flag and bytes.
HEADER_FIELDS, DEFAULTS, ENTRY_FIELDS = ((0x1, 8), (0x2, 4)), (0x8, 0x10, 0x20), (0x100, 0x200, 0x400, 0x800)
#: Set in a sample's flags where it is no key frame.
NOT_KEY = 0x10000


def _fragment_samples(data: memoryview, track: int, found: list[tuple[tuple[bytes, ...], int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The same of the track's runs in fragments, each run as a chunk."""
    usual = next((struct.unpack_from(">III", data, start + 12) for path, start, _ in found if path[-1] == b"trex" and struct.unpack_from(">I", data, start + 4)[0] == track), (0, 0, 0))
    samples, per_chunk = [], []
    moof = base = end_of_run = 0
    mine, own = False, [0, 0, 0]
    for path, start, _ in found:
        if path[-1] == b"moof":
            moof = end_of_run = start - (8 if data[start - 4 : start] == b"moof" else 16)
        elif path[-2:] == (b"traf", b"tfhd"):
            flags, of = struct.unpack_from(">II", data, start)
            mine, at, own = of == track, start + 8, list(usual)
            base = moof if flags & 0x20000 or not flags & 0x1 else struct.unpack_from(">Q", data, at)[0]
            end_of_run = base
            at += sum(n for flag, n in HEADER_FIELDS if flags & flag)
            for k, flag in enumerate(DEFAULTS):
                if flags & flag:
                    own[k] = struct.unpack_from(">I", data, at)[0]
                    at += 4
        elif path[-2:] == (b"traf", b"trun") and mine:
            flags, n = struct.unpack_from(">II", data, start)
            flags, at = flags & 0xFFFFFF, start + 8
            if flags & 0x1:
                end_of_run, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            first = struct.unpack_from(">I", data, at)[0] if flags & 0x4 else None
            at += 4 if flags & 0x4 else 0
            given = [f for f in ENTRY_FIELDS if flags & f]
            entries = np.frombuffer(data, ">u4", n * len(given), at).astype(np.int64).reshape(n, len(given))
            lasts, sizes, kinds = (entries[:, given.index(f)] if f in given else np.full(n, own[k], np.int64) for k, f in enumerate(ENTRY_FIELDS[:3]))
            kinds = kinds.copy()
            if first is not None and n:
                kinds[0] = first
            samples.append(np.stack([end_of_run + np.cumsum(sizes) - sizes, sizes, lasts, (kinds & NOT_KEY) == 0], 1))
            per_chunk.append(n)
            end_of_run += int(sizes.sum())
    return np.concatenate([np.zeros((0, 4), np.int64), *samples]), np.array(per_chunk, np.int64)


def read_container(file: bytes) -> tuple[dict, list[tuple[int, int]]]:
    """What the tables and fragments of the first track say, and the byte ranges of its chunks in order."""
    data = memoryview(file)
    found = list(boxes(data))
    at: dict[bytes, int] = {}
    codec = None
    for path, start, _ in found:
        at.setdefault(path[-1], start)
        if len(path) > 1 and path[-2] == b"stsd" and codec is None:
            codec, entry = path[-1], start
    scale = struct.unpack_from(">I", data, at[b"mdhd"] + (20 if data[at[b"mdhd"]] == 1 else 12))[0]
    track = struct.unpack_from(">I", data, at[b"tkhd"] + (20 if data[at[b"tkhd"]] == 1 else 12))[0]
    parts = [_table_samples(data, at), _fragment_samples(data, track, found)]
    samples, per_chunk = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    per_chunk = per_chunk[per_chunk > 0]
    offsets, sizes, lasts, keys = samples.T
    keys = np.flatnonzero(keys)
    times = np.cumsum(lasts) - lasts
    width, height = struct.unpack_from(">HH", data, entry + 24)
    feature = {
        "codec": codec.decode("latin-1").strip(), "width": width, "height": height, "timescale": scale, "duration": int(lasts.sum()), "frames": len(sizes),
        "keyframes": [[int(a), int(b)] for a, b in zip(offsets[keys], sizes[keys], strict=True)], "keyframe_times": times[keys].tolist(),
    }
    first = np.cumsum(per_chunk) - per_chunk
    ends = offsets + sizes
    return feature, [(int(offsets[a]), int(ends[a + c - 1])) for a, c in zip(first, per_chunk, strict=True)]


def payload_of(file: bytes, chunks: list[tuple[int, int]]) -> bytes:
    return b"".join(file[a:b] for a, b in chunks)


STORED = "doc_id long, n_bytes long, media binary"
PROBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, feature string"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
        files = [write_container(padded(x)) for x in raw]
        yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        rows: dict[str, list] = {k.split()[0]: [] for k in PROBED.split(", ")[2:]}
        for file in batch.column("media").to_pylist():
            feature, chunks = read_container(file)
            payload = payload_of(file, chunks)
            for name, value in (
                ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-32:])), ("media_bytes", len(file)),
                ("media_sha256", hashlib.sha256(file).hexdigest()), ("codec", feature["codec"]), ("duration_s", feature["duration"] / feature["timescale"]), ("feature", json.dumps(feature, separators=(",", ":"))),
            ):
                rows[name].append(value)
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        made = [pa.array(rows[k.split()[0]], kinds[k.split()[1]]) for k in PROBED.split(", ")[2:]]
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *made], [k.split()[0] for k in PROBED.split(", ")])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a container, written to the shared folder."""
    return staged(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_store, STORED), "media")


def probe_media(media: DataFrame) -> DataFrame:
    """What the stored containers say of themselves, and digests of the payload read back from them."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_probe, PROBED)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_media(store_media(table(spark, sf_dir, "documents")))
