"""Zone rules from compiled zone files (TZif), as rows: each zone's periods of one offset.

A period is [utc_from, utc_to) with its offset from UTC; the first has no begin. Periods after the last recorded change
follow the file's rule for later years, up to LAST_YEAR; a file without such a rule ends with an open period.
"""

from __future__ import annotations

import calendar
import os
import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Later periods aren't made; times there have no known offset.
LAST_YEAR = 2100
PERIODS = "zone string, utc_from timestamp_ntz, utc_to timestamp_ntz, offset_s int, is_dst boolean, abbreviation string, problem string"
EPOCH = datetime(1970, 1, 1)
#: Recorded changes before this are as good as no begin.
EARLIEST = -62_135_596_800

_NAME = r"(<[A-Za-z0-9+-]+>|[A-Za-z]{3,})"
_TIME = r"([+-]?\d{1,3}(?::\d{1,2}(?::\d{1,2})?)?)"
_RULE = re.compile(rf"{_NAME}{_TIME}(?:{_NAME}{_TIME}?(?:,([^,/]+)(?:/{_TIME})?,([^,/]+)(?:/{_TIME})?)?)?")


def _seconds(text: str) -> int:
    parts = [int(x) for x in text.lstrip("+-").split(":")] + [0, 0]
    return (parts[0] * 3600 + parts[1] * 60 + parts[2]) * (-1 if text.startswith("-") else 1)


def _day(rule: str, year: int) -> int:
    """Days from the year's begin to a rule's day: Mmonth.week.weekday, Jn (never 29 February) or n."""
    first = datetime(year, 1, 1)
    if rule.startswith("M"):
        month, week, weekday = map(int, rule[1:].split("."))
        begin = datetime(year, month, 1)
        day = (weekday - begin.isoweekday()) % 7 + 7 * (week - 1)
        while day >= calendar.monthrange(year, month)[1]:
            day -= 7
        return (begin - first).days + day
    if rule.startswith("J"):
        n = int(rule[1:])
        return n - 1 + (calendar.isleap(year) and n > 59)
    return int(rule)


class Rule:
    """The rule for years after the last recorded change, as POSIX writes it."""

    def __init__(self, text: str) -> None:
        found = _RULE.fullmatch(text)
        if not found:
            raise ValueError(f"the rule {text!r} can't be read")
        name, offset, other, other_offset, begin, begin_at, end, end_at = found.groups()
        self.standard = (-_seconds(offset), False, name.strip("<>"))
        self.summer = None
        if other:
            if not begin:
                raise ValueError(f"the rule {text!r} doesn't say when it changes")
            self.summer = (-_seconds(other_offset) if other_offset else self.standard[0] + 3600, True, other.strip("<>"))
            self.changes = ((begin, _seconds(begin_at or "2"), self.standard[0], self.summer), (end, _seconds(end_at or "2"), self.summer[0], self.standard))

    def of_year(self, year: int) -> list[tuple[int, tuple]]:
        start = int((datetime(year, 1, 1) - EPOCH).total_seconds())
        return sorted((start + 86400 * _day(day, year) + at - offset, kind) for day, at, offset, kind in self.changes)


def _block(data: bytes, at: int, wide: int) -> tuple[list[int], list[int], list[tuple], int]:
    """(times, kinds, (offset, dst, name) of each kind, where the block ends); `at` is its header's place."""
    if data[at : at + 4] != b"TZif":
        raise ValueError("no zone file")
    n_ut, n_std, n_leap, n_times, n_kinds, n_letters = struct.unpack(">6I", data[at + 20 : at + 44])
    at += 44
    times = list(struct.unpack(f">{n_times}{'q' if wide == 8 else 'i'}", data[at : at + wide * n_times]))
    at += wide * n_times
    which = list(data[at : at + n_times])
    at += n_times
    kinds = [struct.unpack(">iBB", data[at + 6 * i : at + 6 * i + 6]) for i in range(n_kinds)]
    at += 6 * n_kinds
    letters = data[at : at + n_letters]
    named = [(offset, bool(dst), letters[i : letters.index(b"\0", i)].decode()) for offset, dst, i in kinds]
    return times, which, named, at + n_letters + n_leap * (wide + 4) + n_std + n_ut


def periods(data: bytes, last_year: int = LAST_YEAR) -> list[tuple[int | None, int | None, int, bool, str]]:
    """(from, to, offset, dst, name) in seconds of UTC."""
    version = data[4:5]
    times, which, kinds, end = _block(data, 0, 4)
    rule = None
    if version >= b"2":
        times, which, kinds, end = _block(data, end, 8)
        text = data[end:].strip(b"\n").decode()
        rule = Rule(text) if text else None
    if not kinds:
        raise ValueError("a zone without offsets")
    first = next((k for k in kinds if not k[1]), kinds[0]) if times else kinds[0]
    changes = [(t, kinds[k]) for t, k in zip(times, which, strict=True) if t > EARLIEST]
    early = [kinds[k] for t, k in zip(times, which, strict=True) if t <= EARLIEST]
    spans: list[tuple[int | None, tuple]] = [(None, early[-1] if early else kinds[0] if times else first), *changes]
    stop = None
    if rule and rule.summer:
        after = changes[-1][0] if changes else EARLIEST
        year = (EPOCH + timedelta(seconds=after)).year if changes else 1970
        spans += [x for y in range(year, last_year + 1) for x in rule.of_year(y) if x[0] > after]
        stop = int((datetime(last_year + 1, 1, 1) - EPOCH).total_seconds())
    elif rule and not changes:
        spans = [(None, rule.standard)]
    out = []
    for (a, kind), (b, _) in zip(spans, [*spans[1:], (stop, None)], strict=True):
        if out and out[-1][2:] == kind:
            out[-1] = (out[-1][0], b, *kind)
        else:
            out.append((a, b, *kind))
    return out


def read_zone_files(files: DataFrame, last_year: int = LAST_YEAR) -> DataFrame:
    """files (zone, content) to PERIODS; a file that can't be read is one row with its problem and no offset."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = lambda s: None if s is None else EPOCH + timedelta(seconds=s)
        for batch in batches:
            rows = []
            for zone, content in zip(batch.column("zone").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(zone, time(a), time(b), offset, dst, name, None) for a, b, offset, dst, name in periods(content or b"", last_year)]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((zone, None, None, None, None, None, f"unreadable zone file: {e}"))
            kinds = (pa.string(), pa.timestamp("us"), pa.timestamp("us"), pa.int32(), pa.bool_(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PERIODS.split(", ")])

    return files.select("zone", "content").mapInArrow(parse, PERIODS)


def zone_files(spark: SparkSession, folder: str) -> DataFrame:
    """(zone, content) of a folder of compiled zone files, in any store that Spark reads."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", folder.rstrip("/")) + "/"
    zone = F.col("path").substr(F.locate(root, F.col("path")) + len(root), F.length("path"))
    return found.filter(F.substring("content", 1, 4) == F.lit(b"TZif")).select(zone.alias("zone"), "content")  # such folders also hold text files


def installed_zones(spark: SparkSession, zones: list[str]) -> DataFrame:
    """(zone, content) of these zones from the rules that come with Python or the system: a few kB each."""
    import zoneinfo
    from importlib import resources

    rows = []
    for zone in zones:
        for folder in zoneinfo.TZPATH:
            if os.path.isfile(path := os.path.join(folder, zone)):
                with open(path, "rb") as f:
                    rows.append((zone, bytearray(f.read())))
                break
        else:
            rows.append((zone, bytearray(resources.files("tzdata").joinpath("zoneinfo", zone).read_bytes())))
    return spark.createDataFrame(rows, "zone string, content binary")
