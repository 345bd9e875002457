"""Structural tests of media bytes: embedded motion, video streams, format by signature."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

BRANDS = {b"heic": "HEIF", b"heix": "HEIF", b"mif1": "HEIF", b"msf1": "HEIF", b"hevc": "HEIF", b"avif": "AVIF", b"avis": "AVIF"}
#: Brands of any coding of pictures and sequences.
GENERAL_BRANDS = (b"mif1", b"msf1")

#: The first bytes of ASF files, and boxes that movies from before file types begin with.
ASF = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")
OLD_MOVIE = (b"moov", b"mdat", b"wide", b"free", b"skip", b"pnot")


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of ISO media boxes; ends at the first that doesn't fit."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def signature_format(data: bytes) -> str:
    """The format that the first bytes tell, UNKNOWN if none."""
    if data[:3] == b"\xff\xd8\xff":
        return "JPEG"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP"
    if data[4:8] == b"ftyp":
        if data[8:12] in GENERAL_BRANDS:  # the compatible brands tell the coding
            end = min(len(data), struct.unpack_from(">I", data)[0])
            if any(BRANDS.get(data[at : at + 4]) == "AVIF" for at in range(16, end - 3, 4)):
                return "AVIF"
        return BRANDS.get(data[8:12], "VIDEO")
    if data[:4] in (b"\x00\x00\x01\xba", b"\x00\x00\x01\xb3") or data[:16] == ASF or data[4:8] in OLD_MOVIE:
        return "VIDEO"
    if any(len(data) > at + 188 and data[at] == data[at + size] == 0x47 for at, size in ((0, 188), (4, 192))):
        return "VIDEO"
    if data[:4] == b"\x1a\x45\xdf\xa3" or data[:4] == b"RIFF" and data[8:12] == b"AVI ":
        return "VIDEO"
    return "UNKNOWN"


def video_streams(data: bytes) -> int:
    """Tracks of an ISO media file whose handler is video; audio-only files have none."""
    n = 0
    for kind, a, b in boxes(data):
        if kind == b"moov":
            for kind2, a2, b2 in boxes(data, a, b):
                if kind2 == b"trak":
                    for kind3, a3, b3 in boxes(data, a2, b2):
                        if kind3 == b"mdia":
                            n += any(k == b"hdlr" and data[x + 8 : x + 12] == b"vide" for k, x, _ in boxes(data, a3, b3))
    return n


def motion_photo(data: bytes) -> str:
    """'embedded' if a video payload is really there, 'offset-only' if only an old offset points to one, 'claimed' if
    the metadata says so without a payload, else 'none'. HEIF and AVIF keep it in a box at the end."""
    kind = signature_format(data)
    if kind in ("HEIF", "AVIF"):
        last = None
        for last in boxes(data):
            pass
        if last and last[0] == b"mpvd" and last[2] == len(data) and video_streams(data[last[1] : last[2]]) > 0:
            return "embedded"
    elif kind == "JPEG":
        at = data.find(b"ftyp", 2)
        while at >= 4:
            if video_streams(data[at - 4 :]) > 0:
                found = re.search(rb"MicroVideoOffset[=>\"'\s]+(\d+)", data[: at - 4])
                return "offset-only" if found and not re.search(rb"MotionPhoto[=>\"'\s]+1", data[: at - 4]) else "embedded"
            at = data.find(b"ftyp", at + 4)
    return "claimed" if re.search(rb"(?:MotionPhoto|MicroVideo)[=>\"'\s]+1", data) else "none"
