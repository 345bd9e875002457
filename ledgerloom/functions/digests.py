"""Digests: contents, trees, metadata signatures, qualification ids and visual payloads."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_digest(content: Column) -> Column:
    """SHA-256 of exact bytes (or of a string's UTF-8), as lower-case hex."""
    return F.sha2(content, 256)


def tree_digest(path: Column, digest: Column) -> Column:
    """An aggregate: SHA-256 over 'path:digest' lines in path order, joined by ';'. The layout is this project's own."""
    entries = F.array_sort(F.collect_list(F.struct(path.alias("p"), digest.alias("d"))))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["p"].cast("string"), F.lit(":"), e["d"])), ";"), 256)


def signature(*fields: str) -> Column:
    """A digest of the fields that make up a material metadata revision; nulls count as such."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def qualification_id(tool_digest: Column, harness_digest: Column) -> Column:
    """A stable id from the two fingerprints."""
    return F.sha2(F.concat_ws(":", tool_digest, harness_digest), 256)


def jpeg_payload_digest(data: bytes) -> str | None:
    """SHA-256 of a JPEG without metadata segments (APPn, comments): unchanged by metadata edits. None if not a JPEG."""
    if data[:2] != b"\xff\xd8":
        return None
    kept = hashlib.sha256(data[:2])
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:  # padding
            at += 1
            continue
        if kind == 0xDA:  # the scan and all that follows
            kept.update(data[at:])
            return kept.hexdigest()
        size = struct.unpack_from(">H", data, at + 2)[0]
        if not (0xE0 <= kind <= 0xEF or kind == 0xFE):
            kept.update(data[at : at + 2 + size])
        at += 2 + size
    return None


def files_digest(entries: Iterable[tuple[str, str]]) -> str:
    """The digest of tree_digest() for entries at hand, such as a tool's own files."""
    return hashlib.sha256(";".join(f"{p}:{d}" for p, d in sorted(entries)).encode()).hexdigest()
