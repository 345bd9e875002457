"""Media files read in one pass, in pieces of any size: is the structure whole, how many video tracks, and a digest of
what is seen, without the metadata around it.

A walk is a generator that asks for bytes: some to look at, or a number to go past. Nothing but what it looks at is held,
so a file of any size takes a constant amount of memory. The payload digest covers image data and what changes colours
(profiles, palettes, transforms), in file order; text, dates, places and previews aren't in it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Generator

from ledgerloom.functions.media import boxes, signature_format
from ledgerloom.functions.states import FAILED, PASSED, UNAVAILABLE

NAME, VERSION = "structure-walk", "1"
#: Bytes that tell a format.
SIGNATURE_BYTES = 400
#: Descriptions (a HEIF file's meta box) larger than this aren't looked into.
LARGEST_META = 16 << 20
#: Chunks of PNG and WebP that have pixels or colours.
PNG_SEEN = (b"IHDR", b"PLTE", b"IDAT", b"tRNS", b"iCCP", b"sRGB", b"gAMA", b"cHRM", b"cICP", b"sBIT", b"acTL", b"fcTL", b"fdAT")
WEBP_SEEN = (b"VP8 ", b"VP8L", b"ALPH", b"ANIM", b"ANMF", b"ICCP")
#: Items of a HEIF file that aren't pictures.
NOT_SEEN = (b"Exif", b"mime", b"uri ")
_VIDEO = re.compile(rb"hdlr.{8}vide", re.DOTALL)
_VIDEO_BYTES = 16


class Broken(Exception):
    """The structure isn't whole."""


class Walk:
    """feed() pieces, then finish(). Requests of the generator: ("take", n) gives n bytes, ("next", n) the same or None
    at the file's end, ("pass", n, seen[, crc]) goes past n bytes (None: all) and gives their CRC-32 (going on from crc), ("mark",) goes to the next
    byte 255 in seen data."""

    def __init__(self) -> None:
        self.head, self.size, self.format = bytearray(), 0, None
        self.digest, self.videos, self.trailing = hashlib.sha256(), 0, 0
        self.walk: Generator | None = None
        self.problem: str | None = None
        self.over = False
        self.watch: bytes | None = None

    def _begin(self) -> None:
        self.format = signature_format(bytes(self.head))
        found = {"JPEG": jpeg, "PNG": png, "GIF": gif, "WEBP": webp, "HEIF": heif, "AVIF": heif}.get(self.format)
        if found is None and self.format == "VIDEO" and self.head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip", b"pnot"):
            found = movie
        if found:
            self.walk = found(self)
            self.at, self.held = 0, bytearray()
            self._ask(None, first=True)
        else:
            self.over = True
        data, self.head = bytes(self.head), bytearray()
        self._read(data)

    def _ask(self, answer, first: bool = False) -> None:
        try:
            self.request = next(self.walk) if first else self.walk.send(answer)
            self.left, self.crc = (self.request[1] if len(self.request) > 1 else 0), (self.request[3] if len(self.request) > 3 else 0)
        except StopIteration:
            self.over = True
        except (Broken, struct.error, IndexError) as e:
            self.over, self.problem = True, str(e) or "broken"

    def feed(self, piece: bytes) -> None:
        self.size += len(piece)
        if self.format is None:
            self.head += piece
            if len(self.head) >= SIGNATURE_BYTES:
                self._begin()
            return
        self._read(piece)

    def _read(self, data: bytes) -> None:
        at, view = 0, memoryview(data)
        while not self.over:
            kind = self.request[0]
            if kind in ("take", "next"):
                part = view[at : at + self.left - len(self.held)]
                self.held += part
                at += len(part)
                self.at += len(part)
                if len(self.held) < self.left:
                    return
                held, self.held = bytes(self.held), bytearray()
                self._ask(held)
            elif kind == "pass":
                part = view[at:] if self.left is None else view[at : at + self.left]
                if self.request[2]:
                    self.digest.update(part)
                self.crc = zlib.crc32(part, self.crc)
                if self.watch is not None:
                    joined = self.watch + bytes(part)
                    self.videos += len(_VIDEO.findall(joined))
                    self.watch = joined[-(_VIDEO_BYTES - 1) :]
                at += len(part)
                self.at += len(part)
                if self.left is None:
                    return
                self.left -= len(part)
                if self.left:
                    return
                self._ask(self.crc)
            else:
                found = data.find(b"\xff", at)
                end = len(data) if found < 0 else found
                self.digest.update(view[at:end])
                self.at += end - at
                at = end
                if found < 0:
                    return
                self._ask(None)
        self.trailing += len(data) - at

    def finish(self) -> tuple[str, str | None, str | None, int | None]:
        """(status, detail, payload_sha256, video tracks). A format that has no walk is unavailable."""
        if self.format is None:
            self._begin()
        if self.walk is None:
            return UNAVAILABLE, f"no walk for {self.format}", None, None
        if not self.over and self.request[0] == "next" and not self.held:
            self._ask(None)
        elif not self.over and self.request[0] == "pass" and self.left is None:
            self._ask(self.crc)
        if not self.over:
            self.problem = self.problem or "the file ends too early"
        if self.problem:
            return FAILED, self.problem, None, None
        videos = self.videos if self.format == "VIDEO" else None
        if videos == 0:
            return FAILED, "no video track", None, 0
        detail = f"{self.trailing} bytes after the end" if self.trailing else None
        return PASSED, detail, None if self.format == "VIDEO" else self.digest.hexdigest(), videos


def jpeg(w: Walk) -> Generator:
    yield ("take", 2)
    frames = scans = 0
    mark = yield ("take", 2)
    while mark[1] != 0xD9:
        while mark == b"\xff\xff":
            mark = mark[:1] + (yield ("take", 1))
        kind = mark[1]
        if mark[0] != 0xFF or not kind:
            raise Broken("no marker where one must be")
        if kind == 0xD9:
            break
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            mark = yield ("take", 2)
            continue
        size = struct.unpack(">H", (yield ("take", 2)))[0] - 2
        if size < 0:
            raise Broken("a segment shorter than its length")
        frames += 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        start = (yield ("take", min(size, 12))) if kind == 0xE2 else b""
        seen = start == b"ICC_PROFILE\0" or kind == 0xEE or not (0xE0 <= kind <= 0xEF or kind == 0xFE)
        if seen:
            w.digest.update(mark + start)
        yield ("pass", size - len(start), seen)
        if kind != 0xDA:
            mark = yield ("take", 2)
            continue
        scans += 1
        while True:  # coded data: 255 is a marker unless 0 or a restart's number follows
            yield ("mark",)
            mark = yield ("take", 2)
            while mark == b"\xff\xff":
                mark = mark[:1] + (yield ("take", 1))
            if mark[1] and not 0xD0 <= mark[1] <= 0xD7:
                break
            w.digest.update(mark)
    if not frames or not scans:
        raise Broken("no picture")


def png(w: Walk) -> Generator:
    yield ("take", 8)
    kind, before, pictures = b"", b"", 0
    while kind != b"IEND":
        size, kind = struct.unpack(">I4s", (yield ("take", 8)))
        if not before and kind != b"IHDR":
            raise Broken("the header isn't first")
        seen = kind in PNG_SEEN
        if seen and not kind == before == b"IDAT":
            w.digest.update(kind)
        found = yield ("pass", size, seen, zlib.crc32(kind))
        if found != struct.unpack(">I", (yield ("take", 4)))[0]:
            raise Broken(f"the checksum of {kind.decode('latin-1')} differs")
        pictures += kind == b"IDAT"
        before = kind
    if not pictures:
        raise Broken("no picture")


def gif(w: Walk) -> Generator:
    head = yield ("take", 13)
    w.digest.update(head)
    if head[10] & 0x80:
        yield ("pass", 3 << (head[10] & 7) + 1, True)
    pictures = 0
    while True:
        kind = (yield ("take", 1))[0]
        if kind == 0x3B:
            break
        if kind == 0x21:
            seen = (yield ("take", 1))[0] != 0xFE  # a comment
        elif kind == 0x2C:
            place = yield ("take", 9)
            w.digest.update(place)
            if place[8] & 0x80:
                yield ("pass", 3 << (place[8] & 7) + 1, True)
            yield ("pass", 1, True)
            seen, pictures = True, pictures + 1
        else:
            raise Broken("an unknown block")
        while size := (yield ("take", 1))[0]:
            yield ("pass", size, seen)
    if not pictures:
        raise Broken("no picture")


def webp(w: Walk) -> Generator:
    whole = struct.unpack("<4xI4x", (yield ("take", 12)))[0] + 8
    pictures = 0
    while w.at < whole:
        kind, size = struct.unpack("<4sI", (yield ("take", 8)))
        if w.at + size > whole:
            raise Broken("a chunk reaches over the end")
        if kind == b"VP8X" and size >= 10:
            flags = yield ("take", 10)
            w.digest.update(kind + bytes([flags[0] & ~0x0C]) + flags[1:])  # whether it has Exif and XMP isn't seen
            yield ("pass", size - 10 + size % 2, False)
            continue
        seen = kind in WEBP_SEEN
        if seen:
            w.digest.update(kind + struct.pack("<I", size))
        yield ("pass", size, seen)
        yield ("pass", size % 2, False)
        pictures += kind in (b"VP8 ", b"VP8L", b"ANMF")
    if not pictures:
        raise Broken("no picture")


def _box(w: Walk) -> Generator:
    """(kind, size of the body or None for all that is left); None at the end."""
    head = yield ("next", 8)
    if head is None:
        return None
    size, kind = struct.unpack(">I4s", head)
    if size == 1:
        size, used = struct.unpack(">Q", (yield ("take", 8)))[0], 16
    elif size == 0:
        return kind, None
    else:
        used = 8
    if size < used:
        raise Broken("a box shorter than its head")
    return kind, size - used


def movie(w: Walk) -> Generator:
    found = False
    while (box := (yield from _box(w))) is not None:
        kind, size = box
        w.watch = b"" if kind == b"moov" else None
        yield ("pass", size, False)
        found |= kind == b"moov"
        w.watch = None
        if size is None:
            break
    if not found:
        raise Broken("no description of tracks")


def heif(w: Walk) -> Generator:
    extents: list[tuple[int, int]] | None = None
    while (box := (yield from _box(w))) is not None:
        kind, size = box
        if kind == b"meta" and size is not None and extents is None:
            if size > LARGEST_META:
                raise Broken("the description is too large")
            extents = _pictures(w, (yield ("take", size)))
        elif size is None:
            yield ("pass", None, True)
            break
        else:
            end = w.at + size
            for a, b in extents or []:
                if a >= w.at and b <= end:
                    yield ("pass", a - w.at, False)
                    yield ("pass", b - a, True)
            yield ("pass", end - w.at, False)
    if not extents:
        raise Broken("no picture")
    if max(b for _, b in extents) > w.size:
        raise Broken("a picture reaches over the end")


def _number(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def _pictures(w: Walk, meta: bytes) -> list[tuple[int, int]]:
    """Where the pictures' bytes are in the file. Properties and pictures kept in the description itself are digested."""
    parts = {kind: (a, b) for kind, a, b in boxes(meta, 4)}
    kinds: dict[int, bytes] = {}
    if b"iinf" in parts:
        a, b = parts[b"iinf"]
        for kind, x, _ in boxes(meta, a + (6 if meta[a] == 0 else 8), b):
            if kind == b"infe" and meta[x] >= 2:
                wide = 2 if meta[x] == 2 else 4
                kinds[_number(meta, x + 4, wide)] = meta[x + 6 + wide : x + 10 + wide]
    if b"iprp" in parts:
        w.digest.update(meta[slice(*parts[b"iprp"])])
    if b"iloc" not in parts:
        raise Broken("no places of pictures")
    at = parts[b"iloc"][0]
    version = meta[at]
    offset_size, length_size, base_size, index_size = meta[at + 4] >> 4, meta[at + 4] & 15, meta[at + 5] >> 4, meta[at + 5] & 15 if version else 0
    wide = 4 if version == 2 else 2
    n, at = _number(meta, at + 6, wide), at + 6 + wide
    out = []
    for _ in range(n):
        item, at = _number(meta, at, wide), at + wide
        method = 0
        if version:
            method, at = _number(meta, at, 2) & 15, at + 2
        base, count = _number(meta, at + 2, base_size), _number(meta, at + 2 + base_size, 2)
        at += 4 + base_size
        for _ in range(count):
            offset = base + _number(meta, at + index_size, offset_size)
            length = _number(meta, at + index_size + offset_size, length_size)
            at += index_size + offset_size + length_size
            if kinds.get(item, b"mime") in NOT_SEEN:
                continue
            if method == 0 and length:
                out.append((offset, offset + length))
            elif method == 1 and b"idat" in parts:
                w.digest.update(meta[parts[b"idat"][0] + offset :][:length])
    return sorted(out)
