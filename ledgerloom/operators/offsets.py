"""Between UTC and wall time, by the periods of zone rules. What the rules don't tell stays unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.intervals import interval_join

#: One instant; none, as the clock skipped that time; two, as the clock was set back; no known offset.
EXACT, GAP, AMBIGUOUS, UNKNOWN = "exact", "gap", "ambiguous", "unknown"


def _shifted(column: str, seconds: str, sign: int = 1):
    return F.expr(f"{column} + make_dt_interval(0, 0, 0, {'-' if sign < 0 else ''}({seconds}))")


def to_local(df: DataFrame, periods: DataFrame, key: str, utc: str, zone: str) -> DataFrame:
    """(key, local, offset_s, abbreviation) of df (key, utc timestamp_ntz, zone), a row for each key; null where the zone
    or its rules at that time aren't known. key must be unique."""
    rows = df.select(F.col(key), F.col(utc).alias("_utc"), F.col(zone).alias("_zone"))
    rules = periods.filter("offset_s is not null").select(F.col("zone").alias("_zone"), "utc_from", "utc_to", "offset_s", "abbreviation")
    found = interval_join(rows, rules, "_utc", "utc_from", "utc_to", ("_zone",))
    return df.select(key).join(found.select(key, _shifted("_utc", "offset_s").alias("local"), "offset_s", "abbreviation"), key, "left")


def to_utc(df: DataFrame, periods: DataFrame, key: str, local: str, zone: str) -> DataFrame:
    """(key, status, earliest, latest) of df (key, local timestamp_ntz, zone), a row for each key.

    A wall time that occurs twice has both instants, one that the clock skipped has none; neither is guessed. A null
    time, an unknown zone and times beyond the rules are unknown. key must be unique.
    """
    rules = periods.filter("offset_s is not null").select(F.col("zone").alias("_zone"), "utc_from", "utc_to", "offset_s")
    wall = rules.select("_zone", _shifted("utc_from", "offset_s").alias("wall_from"), _shifted("utc_to", "offset_s").alias("wall_to"), "offset_s")
    rows = df.select(F.col(key), F.col(local).alias("_local"), F.col(zone).alias("_zone"))
    instants = interval_join(rows, wall, "_local", "wall_from", "wall_to", ("_zone",)).withColumn("_utc", _shifted("_local", "offset_s", -1))
    found = instants.groupBy(key).agg(F.min("_utc").alias("earliest"), F.max("_utc").alias("latest"))
    # Up to where a zone's rules reach, by the wall: beyond, nothing was skipped.
    ends = rules.groupBy("_zone").agg(F.bool_or(F.col("utc_to").isNull()).alias("_open"), F.max(_shifted("utc_to", "offset_s")).alias("_last"))
    told = rows.join(ends, "_zone", "left").join(found, key, "left")
    covered = F.coalesce(F.col("_local").isNotNull() & (F.col("_open") | (F.col("_local") < F.col("_last"))), F.lit(False))
    status = F.when(F.col("earliest").isNull(), F.when(covered, GAP).otherwise(UNKNOWN)).when(F.col("earliest") == F.col("latest"), EXACT).otherwise(AMBIGUOUS)
    return told.select(key, status.alias("status"), "earliest", "latest")
