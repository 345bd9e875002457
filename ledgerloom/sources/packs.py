"""Reference data packs: checked against their manifest before use, and named by their hash in what they yield."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.digests import files_digest
from ledgerloom.sources.archives import file_sha256

REQUIRED = ("role", "version", "source", "license", "attribution", "temporal_scope", "files")
#: Packs that only hold current data mustn't answer for the past.
CURRENT_ONLY = "current"


def verify_pack(folder: str) -> dict:
    """The pack's manifest (pack.json: the REQUIRED fields, files with path and sha256), with pack_sha256; raises if a
    field is missing, or a file is missing, unlisted, a link or different."""
    with open(os.path.join(folder, "pack.json"), encoding="utf-8") as f:
        pack = json.load(f)
    if missing := [k for k in REQUIRED if not pack.get(k)]:
        raise ValueError(f"the pack's manifest lacks {', '.join(missing)}")
    named = {x["path"]: x["sha256"] for x in pack["files"]}
    there = {os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names} - {"pack.json"}
    if there != set(named):
        raise ValueError(f"files differ from the manifest: {sorted(there ^ set(named))}")
    for path, digest in named.items():
        full = os.path.join(folder, path)
        if os.path.islink(full) or file_sha256(full) != digest:
            raise ValueError(f"{path} isn't the file that the manifest names")
    return pack | {"pack_sha256": hashlib.sha256(files_digest(named.items()).encode()).hexdigest()}


def read_pack(spark: SparkSession, folder: str, path: str, schema: str, historical: bool = False, separator: str = "\t") -> DataFrame:
    """A table of a verified pack, with pack_sha256 in each row so that what is derived keeps its evidence."""
    pack = verify_pack(folder)
    if historical and pack["temporal_scope"] == CURRENT_ONLY:
        raise ValueError("a pack of current data can't be used for the past")
    rows = spark.read.option("sep", separator).schema(schema).csv(os.path.join(folder, path))
    return rows.withColumn("pack_sha256", F.lit(pack["pack_sha256"]))
