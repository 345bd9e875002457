"""Dates that are only partly known, offsets, placement, coordinates. Nothing is filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTIAL_DATE = "struct<year:int,month:int,day:int,time:string,offset_min:int,precision:string>"
_PATTERN = r"^(\d{4})(?:[-:](\d{2})(?:[-:](\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"


def partial_date(text: Column) -> Column:
    """PARTIAL_DATE of 'YYYY', 'YYYY-MM', 'YYYY-MM-DD' or with a time and an offset; null if it isn't one.

    An offset that isn't given stays null: the zone is unknown, not UTC.
    """
    part = lambda i: F.nullif(F.regexp_extract(text, _PATTERN, i), F.lit(""))
    year, month, day, time, zone = (part(i) for i in range(1, 6))
    digits = F.regexp_replace(zone, "[:+-]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    offset = F.when(zone == "Z", 0).otherwise(F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    month, day = month.cast("int"), day.cast("int")
    whole = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    real = F.coalesce(month, F.lit(1)).between(1, 12) & (day.isNull() | whole.try_cast("date").isNotNull())
    precision = F.when(time.isNotNull(), "time").when(day.isNotNull(), "day").when(month.isNotNull(), "month").otherwise("year")
    made = F.struct(year.cast("int").alias("year"), month.alias("month"), day.alias("day"), time.alias("time"), offset.cast("int").alias("offset_min"), precision.alias("precision"))
    return F.when(year.isNotNull() & real, made)


def partial_text(year: Column, month: Column, day: Column) -> Column:
    """'YYYY', 'YYYY-MM' or 'YYYY-MM-DD', as precise as what is known."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.lpad(year.cast("string"), 4, "0")
    return F.when(day.isNotNull() & month.isNotNull(), F.concat(text, F.lit("-"), two(month), F.lit("-"), two(day))).when(month.isNotNull(), F.concat(text, F.lit("-"), two(month))).otherwise(text)


NEEDS_PLACEMENT = "_Needs Placement"


def folder(date: Column) -> Column:
    """Photos/YYYY/MM - Month of a date."""
    return F.concat(F.lit("Photos/"), F.date_format(date, "yyyy/MM"), F.lit(" - "), F.date_format(date, "MMMM"))


def placement(earliest: Column, latest: Column) -> Column:
    """The folder if both bounds lie in one month; what is uncertain across folders needs placement."""
    return F.coalesce(F.when(F.trunc(earliest, "month") == F.trunc(latest, "month"), folder(earliest)), F.lit(NEEDS_PLACEMENT))


def local_time(utc: Column, zone: Column | str) -> Column:
    """Wall time in an IANA zone by its rules at that date; null where the zone is unknown."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit("UTC"), zone, utc.cast("timestamp_ntz"))


def coordinate(text: Column, reference: Column | None = None) -> Column:
    """Signed degrees of '34.68N', '34,40.8N' (degrees, minutes), '34 40 48 N' or '-34.68'; the hemisphere may stand apart.

    Null if it can't be read, lies outside of its range, or value and reference contradict each other.
    """
    letter = F.upper(F.regexp_extract(text, r"([NSEWnsew])\s*$", 1))
    apart = F.upper(F.substring(F.coalesce(reference, F.lit("")) if reference is not None else F.lit(""), 1, 1))
    side = F.when(letter != "", letter).otherwise(apart)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.try_cast("double"))
    at = lambda i: F.coalesce(F.try_element_at(numbers, F.lit(i)), F.lit(0.0))
    size = at(1) + at(2) / 60 + at(3) / 3600
    minus = text.rlike(r"^\s*-")
    value = F.when(minus | side.isin("S", "W"), -size).otherwise(size)
    good = F.size(numbers).between(1, 3) & ~(minus & side.isin("S", "W", "N", "E")) & ((letter == "") | (apart == "") | (letter == apart))
    limit = F.when(side.isin("N", "S"), 90.0).otherwise(180.0)
    return F.when(good & (size <= limit) & (at(2) < 60) & (at(3) < 60), value)
