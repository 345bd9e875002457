"""Names: sidecars, numbered camera files, formats, paths and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sidecar ending, and the most characters of a sidecar's name.
SIDECAR_ENDING = ".supplemental-metadata.json"
SIDECAR_LENGTH = 51
#: Still and video formats by ending.
STILL_FORMATS = {"jpg": "JPEG", "jpeg": "JPEG", "heic": "HEIF", "heif": "HEIF", "png": "PNG", "webp": "WEBP", "gif": "GIF", "avif": "AVIF"}
RAW_ENDINGS = ("dng", "cr2", "cr3", "nef", "arw", "orf", "rw2", "raf", "raw")
VIDEO_ENDINGS = ("mpg", "mpeg", "mod", "mmv", "tod", "wmv", "asf", "avi", "divx", "mov", "m4v", "3gp", "3g2", "mp4", "m2t", "m2ts", "mts", "mkv")


def _copy_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\(\d+\))(?:\.[^.]*)?$", 1)


def sidecar_name(media_name: Column) -> Column:
    """The sidecar that an export would write for a media file.

    A copy's '(n)' moves from before the ending to before '.json', and the name is cut so that it has at most
    SIDECAR_LENGTH characters with '.json'.
    """
    number = _copy_number(media_name)
    plain = F.when(number != "", F.regexp_replace(media_name, r"\(\d+\)(\.[^.]*)?$", "$1")).otherwise(media_name)
    full = F.concat(plain, F.lit(SIDECAR_ENDING.removesuffix(".json")))
    return F.concat(F.substring(full, 1, SIDECAR_LENGTH - len(".json")), number, F.lit(".json"))


def is_sidecar(name: Column) -> Column:
    return F.lower(name).endswith(".json")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def camera_number(name: Column) -> Column:
    """The last number in a camera's file name, null if there is none."""
    return F.regexp_extract(name, r"(\d{1,9})\D*$", 1).try_cast("int")


def format_family(path: Column) -> Column:
    """JPEG, HEIF, PNG, WEBP, GIF, AVIF, RAW, VIDEO; UNKNOWN files are kept as they are and shown for review."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(ending.isin(*VIDEO_ENDINGS), "VIDEO").when(ending.isin(*RAW_ENDINGS), "RAW")
    for k, v in STILL_FORMATS.items():
        out = out.when(ending == k, v)
    return out.otherwise("UNKNOWN")


def unsafe_path(path: Column) -> Column:
    """Whether a manifest path could leave its root or isn't portable: absolute, with '..', '.', empty parts, back
    slashes, drive letters or control characters."""
    return F.coalesce(path.isNull() | (path == "") | path.rlike(r"^/|^[A-Za-z]:|\\|[\x00-\x1f]|(^|/)\.{1,2}(/|$)|//|/$"), F.lit(True))


def place_label(city: Column, region: Column, country: Column) -> Column:
    """'Nara, Japan': names only; a region that is a bare code, or equal to the city, isn't part of it. Null if nothing is known."""
    shown = F.when(region.rlike(r"^[0-9]+$") | (region == city), F.lit(None)).otherwise(region)
    label = F.concat_ws(", ", city, F.when(city.isNull(), shown), country)
    return F.when(label != "", label)
