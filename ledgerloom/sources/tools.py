"""Bounded helpers: external tools and validators, run for each row of a partition.

Every call has a time limit and fails closed: a tool that is missing, hangs or breaks gives `unavailable` or `failed`
with the reason, never `passed`. Each result names the validator and its exact version.
"""

from __future__ import annotations

import importlib.util
import io
import json
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.functions.media import OLD_MOVIE, signature_format, video_streams
from ledgerloom.functions.states import FAILED, PASSED, UNAVAILABLE

RESULT = "status string, validator string, version string, detail string, video_streams int"
TIMEOUT_S = 20
Verdict = tuple[str, str | None, str | None, str | None, int | None]


def bounded(command: list[str], timeout: float = TIMEOUT_S, data: bytes | None = None) -> tuple[int | None, bytes, str | None]:
    """(exit code, output, problem); the code is None if it couldn't run or took too long."""
    if timeout <= 0:
        raise ValueError("the time limit must be positive")
    try:
        done = subprocess.run(command, input=data, capture_output=True, timeout=timeout, check=False)
        return done.returncode, done.stdout, None
    except subprocess.TimeoutExpired:
        return None, b"", f"took over {timeout} s"
    except OSError as e:
        return None, b"", str(e)


def validate_still(data: bytes) -> Verdict:
    """By Pillow where it is installed."""
    if importlib.util.find_spec("PIL") is None:
        return UNAVAILABLE, None, None, "Pillow isn't installed", None
    import PIL
    from PIL import Image

    try:
        with Image.open(io.BytesIO(data)) as image:
            image.load()
        return PASSED, "Pillow", PIL.__version__, None, None
    except Exception as e:  # any decoder error is a failed validation
        return FAILED, "Pillow", PIL.__version__, str(e)[:200], None


def validate_video(data: bytes, timeout: float = TIMEOUT_S) -> Verdict:
    """By ffprobe; at least one real video stream is needed. Without the tool the container's tracks are counted, which
    can fail a file but not pass it."""
    tool = shutil.which("ffprobe")
    if tool is None:
        if data[4:8] not in (b"ftyp", *OLD_MOVIE):
            return UNAVAILABLE, None, None, "ffprobe isn't installed", None
        n = video_streams(data)
        return (UNAVAILABLE if n else FAILED), "box walk", "1", "ffprobe isn't installed" if n else "no video stream", n
    code, out, problem = bounded([tool, "-version"], timeout)
    version = out.split()[2].decode() if code == 0 and len(out.split()) > 2 else None
    with tempfile.NamedTemporaryFile() as f:
        f.write(data)
        f.flush()
        code, out, problem = bounded([tool, "-v", "error", "-show_streams", "-of", "json", f.name], timeout)
    if code != 0:
        return FAILED, "ffprobe", version, problem or "it reports an error", None
    n = sum(s.get("codec_type") == "video" and not s.get("disposition", {}).get("attached_pic") for s in json.loads(out or b"{}").get("streams", []))
    return (PASSED if n else FAILED), "ffprobe", version, None if n else "no video stream", n


def validate_heif(data: bytes, timeout: float = TIMEOUT_S) -> Verdict:
    """By libheif's tools where installed; the tool's own name is recorded."""
    for name in ("heif-info", "heif-convert", "heif-dec"):
        tool = shutil.which(name)
        if tool:
            _, out, _ = bounded([tool, "--version"], timeout)
            with tempfile.NamedTemporaryFile(suffix=".heic") as f:
                f.write(data)
                f.flush()
                code, _, problem = bounded([tool, f.name], timeout)
            return (PASSED if code == 0 else FAILED), name, out.decode(errors="replace").strip() or None, problem, None
    return UNAVAILABLE, None, None, "libheif isn't installed", None


def validate_raw(data: bytes) -> Verdict:
    return UNAVAILABLE, None, None, "no validator is qualified for RAW", None


VALIDATORS: dict[str, Callable[[bytes], Verdict]] = {"JPEG": validate_still, "PNG": validate_still, "GIF": validate_still, "WEBP": validate_still, "HEIF": validate_heif, "AVIF": validate_heif, "VIDEO": validate_video, "RAW": validate_raw}


def validate(items: DataFrame, validators: dict[str, Callable[[bytes], Verdict]] | None = None) -> DataFrame:
    """items (occ_id, family, content) to (occ_id, sha-independent RESULT). A file whose bytes aren't its family fails;
    unknown families and contents that weren't read are unavailable."""
    known = validators or VALIDATORS

    def one(family: str | None, data: bytes | None) -> Verdict:
        if data is None:
            return UNAVAILABLE, None, None, "the content wasn't read", None
        if family not in known:
            return UNAVAILABLE, None, None, "unknown format", None
        told = signature_format(data)
        # Some videos have no signature that is known here: the validator decides.
        if family != "RAW" and told != family and not (family == "VIDEO" and told == "UNKNOWN"):
            return FAILED, "signature", "1", f"the bytes are {told}", None
        return known[family](data)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *one(k, d)) for i, k, d in zip(f["occ_id"], f["family"], f["content"], strict=True)]
            out = pd.DataFrame(rows, columns=["occ_id", "status", "validator", "version", "detail", "video_streams"])
            yield out.astype({"video_streams": "Int32"})

    return items.select("occ_id", "family", "content").mapInPandas(run, f"occ_id string, {RESULT}")


class MetadataReader:
    """Reads embedded metadata by a command that takes a file and prints JSON; only reviewed versions are used."""

    def __init__(self, executable: str = "exiftool", versions: tuple[str, ...] = ("13.55", "13.59"), timeout: float = TIMEOUT_S) -> None:
        if timeout <= 0:
            raise ValueError("the time limit must be positive")
        self.executable, self.versions, self.timeout = executable, versions, timeout

    def version(self) -> tuple[str | None, str | None]:
        code, out, problem = bounded([self.executable, "-ver"], self.timeout)
        found = out.decode(errors="replace").strip() if code == 0 else None
        if found is None:
            return None, problem or "it reports an error"
        return (found, None) if found in self.versions else (None, f"version {found} wasn't reviewed")

    def read(self, data: bytes) -> tuple[str | None, str | None]:
        """(JSON, problem)"""
        with tempfile.NamedTemporaryFile() as f:
            f.write(data)
            f.flush()
            code, out, problem = bounded([self.executable, "-j", "-G1", f.name], self.timeout)
        return (out.decode(errors="replace"), None) if code == 0 else (None, problem or "it reports an error")

    def apply(self, items: DataFrame) -> DataFrame:
        """items (occ_id, content) to (occ_id, metadata_json, tool_version, problem)."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            version, problem = self.version()
            for f in frames:
                rows = [(i, *((None, version, problem) if version is None or d is None else (lambda r: (r[0], version, r[1]))(self.read(d)))) for i, d in zip(f["occ_id"], f["content"], strict=True)]
                yield pd.DataFrame(rows, columns=["occ_id", "metadata_json", "tool_version", "problem"])

        return items.select("occ_id", "content").mapInPandas(run, "occ_id string, metadata_json string, tool_version string, problem string")


def may_write_metadata(version: str, executable_sha256: str, allowed: frozenset[tuple[str, str]] = frozenset()) -> bool:
    """Writing needs the exact build on the list; the list is empty, so nothing may write."""
    return (version, executable_sha256) in allowed
