"""Sidecar JSON: the known fields by an explicit schema, everything else kept as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import file_name, folder_of, is_sidecar

#: The fields that are read; exports name no schema, so this is this project's choice.
FIELDS = "title string, description string, url string, creationTime struct<timestamp:string>, photoTakenTime struct<timestamp:string>, geoData struct<latitude:double,longitude:double>"


def sidecars(archives: DataFrame) -> DataFrame:
    """archives() rows to (occ_id, folder, filename, raw_json, parsed, rest): parsed is null if the JSON isn't valid,
    rest holds the whole document as a variant so that unknown material is never lost."""
    rows = archives.filter(is_sidecar(F.col("member_path")))
    text = F.decode("content", "UTF-8")
    return rows.select(F.concat_ws(":", "archive_sha256", "member_ordinal").alias("occ_id"), folder_of(F.col("member_path")).alias("folder"), file_name(F.col("member_path")).alias("filename"), text.alias("raw_json"), F.from_json(text, FIELDS).alias("parsed"), F.try_parse_json(text).alias("rest"))
