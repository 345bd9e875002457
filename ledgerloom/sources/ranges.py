"""Export ZIPs by byte ranges: the members of one archive are read by many tasks, of any size, in constant memory.

directory() lists members from each archive's central directory alone; filters on it decide what is read at all.
read_members() deals them by where they lie in their archives, so a large archive is many tasks' and a group of members
one stretch of the file. A member goes through digest, checksum and a structural walk piece by piece. What can't be read
is a row with its problem, never a failed job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.states import FAILED, UNAVAILABLE
from ledgerloom.functions.walks import NAME, VERSION, Walk

PIECE = 1 << 20
#: Members that begin in one stretch of this size are read by one task.
GROUP_BYTES = 64 << 20
#: The end of an archive, where its directory is announced: a fixed record and a comment of up to 64 kB.
TAIL_BYTES = (1 << 16) + 22 + 20
MEMBERS = "archive_path string, archive_size long, member_ordinal int, member_path string, method int, flags int, crc32 long, packed_size long, size long, header_at long, warning string, problem string"
READ = "archive_path string, member_ordinal int, member_path string, size long, sha256 string, payload_sha256 string, status string, validator string, version string, detail string, video_streams int, content binary, warning string, problem string"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch([pa.array(x, _KINDS[k]) for x, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class Unreadable(Exception):
    """An archive or member isn't what it should be."""


class Ranges:
    """Byte ranges of one file, in any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def at(self, start: int, n: int) -> bytes:
        found = self.file.read_at(n, start) if 0 <= start <= self.size else b""
        if len(found) < n:
            raise Unreadable("the archive ends too early")
        return found

    def close(self) -> None:
        self.file.close()


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive_path, archive_size) of the ZIPs below a folder, listed by Spark; no content is read. Spark lists no file
    without bytes: name those in the rows that directory() gets, to have them as unreadable."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    return found.select(F.col("path").alias("archive_path"), F.col("length").alias("archive_size"))


def _end_record(f: Ranges) -> tuple[int, int, int]:
    """(where the directory is, its size, how many members it has)"""
    start = max(0, f.size - TAIL_BYTES)
    tail = f.at(start, f.size - start)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise Unreadable("no end record: not a whole ZIP")
    n, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        far = struct.unpack_from("<Q", tail, at - 12)[0]
        record = f.at(far, 56)
        if record[:4] != b"PK\6\6":
            raise Unreadable("no 64-bit end record where one must be")
        n, size, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, size, n


def _members(f: Ranges) -> Iterator[tuple]:
    """Of each member: (ordinal, path, method, flags, crc, packed size, size, header's place)."""
    at, left, n = _end_record(f)
    held, ordinal = b"", 0
    while ordinal < n:
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            step = min(PIECE, left)
            if not step:
                raise Unreadable("the directory ends too early")
            held += f.at(at, step)
            at, left = at + step, left - step
        if held[:4] != b"PK\1\2":
            raise Unreadable("no directory entry where one must be")
        flags, method, crc, packed, size, name_n, extra_n, comment_n, header = struct.unpack_from("<8xHH4xIIIHHH8xI", held)
        raw, extra = held[46 : 46 + name_n], held[46 + name_n : 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, size_of = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = extra[4 : 4 + size_of]
                values = iter(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))
                size, packed, header = (next(values, v) if v == 0xFFFFFFFF else v for v in (size, packed, header))
            extra = extra[4 + size_of :]
        yield ordinal, raw.decode("utf-8" if flags & 0x800 else "cp437", "replace"), method, flags, crc, packed, size, header
        held = held[46 + name_n + extra_n + comment_n :]
        ordinal += 1


def directory(archives: DataFrame) -> DataFrame:
    """MEMBERS of archives (archive_path); folders aren't members. An unreadable archive is one row with its problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive_path").to_pylist():
                rows: list[tuple] = []
                seen: set[bytes] = set()
                size = None
                try:
                    f = Ranges(path)
                    size = f.size
                    for ordinal, name, *rest in _members(f):
                        if name.endswith("/"):
                            continue
                        key = hashlib.blake2b(name.encode(), digest_size=12).digest()
                        rows.append((path, size, ordinal, name, *rest, "duplicate member name" if key in seen else None, None))
                        seen.add(key)
                        if len(rows) >= 10_000:
                            yield _batch(rows, MEMBERS)
                            rows = []
                    f.close()
                except (Unreadable, OSError, struct.error) as e:
                    rows.append((path, size, *[None] * 9, str(e)))
                yield _batch(rows, MEMBERS)

    spark = archives.sparkSession
    return archives.select("archive_path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive_path").mapInArrow(run, MEMBERS)


def _pieces(f: Ranges, method: int, packed: int, size: int, header: int) -> Iterator[bytes]:
    """The member's bytes; more than the directory says is a fault, so nothing can grow without bound."""
    head = f.at(header, 30)
    if head[:4] != b"PK\3\4":
        raise Unreadable("no member where the directory says")
    at = header + 30 + sum(struct.unpack_from("<HH", head, 26))
    unpack = zlib.decompressobj(-15) if method == 8 else None
    done = 0
    for a in range(0, packed, PIECE):
        data = f.at(at + a, min(PIECE, packed - a))
        while data:
            piece = unpack.decompress(data, PIECE) if unpack else data
            data = unpack.unconsumed_tail if unpack else b""
            done += len(piece)
            if done > size:
                raise Unreadable("the member is larger than the directory says")
            if piece:
                yield piece
            if unpack and unpack.eof:
                data = b""
    if unpack:
        while (piece := unpack.flush()) and done <= size:
            done += len(piece)
            yield piece
    if done != size:
        raise Unreadable("the member isn't as large as the directory says")


def _read(f: Ranges, member: dict, inline: int) -> tuple:
    key = (member["archive_path"], member["member_ordinal"], member["member_path"])
    none = (None,) * 2
    if member["flags"] & 1 or member["method"] not in (0, 8):
        return *key, member["size"], *none, UNAVAILABLE, *none, "encrypted" if member["flags"] & 1 else f"packed by method {member['method']}", None, None, member["warning"], None
    walk, found, crc, kept = Walk(), hashlib.sha256(), 0, []
    try:
        for piece in _pieces(f, *(member[k] for k in ("method", "packed_size", "size", "header_at"))):
            found.update(piece)
            crc = zlib.crc32(piece, crc)
            walk.feed(piece)
            if member["size"] <= inline:
                kept.append(piece)
        if crc != member["crc32"]:
            raise Unreadable("the checksum differs")
    except (Unreadable, OSError, struct.error, zlib.error) as e:
        return *key, member["size"], *none, FAILED, *none, None, None, None, member["warning"], str(e)
    status, detail, payload, videos = walk.finish()
    return *key, member["size"], found.hexdigest(), payload, status, NAME, VERSION, detail, videos, b"".join(kept) if member["size"] <= inline else None, member["warning"], None


def read_members(members: DataFrame, inline_bytes: int = -1, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """READ of members (rows of directory(), filtered as needed). status tells whether a known format's structure is
    whole; content comes along up to inline_bytes, by default never. Rows with a problem stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            for member in batch.to_pylist():
                if member["problem"]:
                    yield _batch([(member["archive_path"], *[None] * 11, None, member["problem"])], READ)
                    continue
                try:
                    if path != member["archive_path"]:
                        if f:
                            f.close()
                        path, f = None, Ranges(member["archive_path"])
                        path = member["archive_path"]
                    row = _read(f, member, inline_bytes)
                except OSError as e:
                    row = (member["archive_path"], member["member_ordinal"], member["member_path"], *[None] * 10, str(e))
                yield _batch([row], READ)

    spark = members.sparkSession
    stretch = F.floor(F.col("header_at") / group_bytes)
    dealt = members.repartition(max(200, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive_path", stretch).sortWithinPartitions("archive_path", "header_at")
    return dealt.mapInArrow(run, READ)


def archive_digests(archives: DataFrame) -> DataFrame:
    """(archive_path, archive_sha256): a whole archive's digest needs one pass over it, so it is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive_path").to_pylist():
                try:
                    f, found = Ranges(path), hashlib.sha256()
                    for a in range(0, f.size, PIECE):
                        found.update(f.at(a, min(PIECE, f.size - a)))
                    row = (path, found.hexdigest())
                except (Unreadable, OSError):
                    row = (path, None)
                yield _batch([row], "archive_path string, archive_sha256 string")

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive_path").repartition(parts, "archive_path").mapInArrow(run, "archive_path string, archive_sha256 string")
