"""Sinks of the archive: media in their folders, and a record (open JSON and XMP) for each content.

Every file is a staged commit that overwrites nothing, so a rerun finds exact bytes and fills what is missing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.functions.names import unsafe_path
from ledgerloom.sources.commits import CONFLICT, commit_pieces, file_pieces, file_sha256, has_link

#: XMP properties by field. A capture time is never a resource's creation time.
XMP_FIELDS = {"captured": "photoshop:DateCreated", "description": "dc:description", "latitude": "exif:GPSLatitude", "longitude": "exif:GPSLongitude"}
_HEAD = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:exif="http://ns.adobe.com/exif/1.0/">'
_TAIL = "</rdf:Description></rdf:RDF></x:xmpmeta>\n"


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, "[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def _property(name: str, value: Column) -> Column:
    inner = _escaped(value)
    if name == "dc:description":
        inner = F.concat(F.lit('<rdf:Alt><rdf:li xml:lang="x-default">'), inner, F.lit("</rdf:li></rdf:Alt>"))
    return F.coalesce(F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>")), F.lit(""))


def records(facts: DataFrame) -> DataFrame:
    """facts (sha256, field, value, fact_class, source) to (sha256, json, xmp).

    The JSON has every fact with its class and source. The XMP has the fields of XMP_FIELDS whose original and
    user-confirmed values agree; what is disputed, suggested or derived stays in the JSON alone.
    """
    sure = F.when(F.col("fact_class").isin("original", "confirmed"), F.col("value"))
    agreed = facts.groupBy("sha256", "field").agg(F.min(sure).alias("low"), F.max(sure).alias("high"), F.sort_array(F.collect_set(F.struct("fact_class", "value", "source"))).alias("facts"))
    agreed = agreed.withColumn("agreed", F.when(F.col("low") == F.col("high"), F.col("low")))
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("agreed")))
    made = agreed.groupBy("sha256").agg(F.sort_array(F.collect_list(F.struct("field", "agreed", "facts"))).alias("fields"), *(value(f).alias(f"_{f}") for f in XMP_FIELDS))
    xmp = F.concat(F.lit(_HEAD), *(_property(name, F.col(f"_{f}")) for f, name in XMP_FIELDS.items()), F.lit(_TAIL))
    return made.select("sha256", F.to_json(F.struct("sha256", "fields")).alias("json"), xmp.alias("xmp"))


def write_records(made: DataFrame, root: str) -> None:
    """records/ab/abcd….json and .xmp below root. A record that has changed is a conflict: revisions are new records."""

    def run(rows: Iterator[Row]) -> None:
        import hashlib

        for r in rows:
            for ending, text in (("json", r["json"]), ("xmp", r["xmp"])):
                data = text.encode()
                path = f"records/{r['sha256'][:2]}/{r['sha256']}.{ending}"
                if commit_pieces([data], root, path, hashlib.sha256(data).hexdigest()) == CONFLICT:
                    raise ValueError(f"{path}: another record is there")

    os.makedirs(root, exist_ok=True)
    made.foreachPartition(run)


def place_media(items: DataFrame, source: str, archive: str) -> None:
    """items (path, sha256, folder, name): copies source/path to archive/folder/name. The whole set is checked before
    the first write: safe and different targets, sources with the planned bytes, nothing else in the targets' places."""
    planned = items.select("path", "sha256", F.concat_ws("/", "folder", "name").alias("target"))
    twice = planned.groupBy("target").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | unsafe_path(F.col("target"))).limit(5).collect()
    if twice:
        raise ValueError(f"nothing was written: targets are unsafe or named twice, such as {[r['target'] for r in twice]}")

    def check(frames):
        for f in frames:
            bad = []
            for path, digest, target in zip(f["path"], f["sha256"], f["target"], strict=True):
                at, to = os.path.join(source, path), os.path.join(archive, target)
                good = not has_link(source, path) and os.path.isfile(at) and file_sha256(at) == digest
                bad.append(not good or has_link(archive, target) or os.path.exists(to) and file_sha256(to) != digest)
            yield f.loc[bad, ["path"]]

    os.makedirs(archive, exist_ok=True)
    wrong = planned.mapInPandas(check, "path string").limit(5).collect()
    if wrong:
        raise ValueError(f"nothing was written: sources or targets aren't as planned, such as {[r['path'] for r in wrong]}")

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            if commit_pieces(file_pieces(os.path.join(source, r["path"])), archive, r["target"], r["sha256"]) == CONFLICT:
                raise ValueError(f"{r['target']}: other bytes have appeared")

    planned.foreachPartition(run)
