"""Archives into a vault as a data source's write: tasks store objects, the commit publishes their records.

A task streams each archive into the vault's staging folder while it hashes it, and links it to its place by digest; an
object that is there already is verified and reused. Its record is staged beside it. Only when all tasks have ended does
the commit link the records to their places: before that, no reader sees any. A run that ends at any point leaves whole
objects, at worst without a record, and staging files; the next run reuses the former, and sweep() takes the latter away.
Bytes go from the source to the vault in the tasks; the driver only gets a folder's name from each.

The vault is a folder that all executors mount, with hard links.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerloom.operators.integrity import vault_audit
from ledgerloom.sources.archives import file_sha256
from ledgerloom.sources.commits import STAGING, _sync_folder, file_pieces, has_link

OBJECTS, RECORDS = "objects", "records"
#: Staging of a run that began longer ago than this is nobody's any more.
STALE_SECONDS = 7 * 86_400
RECORD = "archive_path string, sha256 string, size long"


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _written(path: str, data: bytes) -> None:
    with open(path, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def _placed(staging: str, target: str, digest: str) -> str:
    """Links a staged file to its place: copied, or reused where exact bytes are there already."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.link(staging, target)
    except FileExistsError:
        if os.path.islink(target) or file_sha256(target) != digest:
            raise ValueError(f"{target} has other bytes than its name says") from None
        return "reused"
    _sync_folder(os.path.dirname(target))
    return "copied"


@dataclass
class Staged(WriterCommitMessage):
    """A task's staging folder."""

    folder: str


class VaultWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.root = _plain(options["path"])
        self.names = schema.names
        if "archive_path" not in self.names:
            raise ValueError("rows need a column archive_path")
        self.run = f"{uuid.uuid4().hex}"

    def _staging(self, *parts: str) -> str:
        return os.path.join(self.root, f"{self.run}{STAGING}", *parts)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        folder = self._staging(f"{context.partitionId()}-{context.taskAttemptId()}")
        os.makedirs(folder)
        for row in rows:
            values = row.asDict(recursive=True) if hasattr(row, "asDict") else dict(zip(self.names, row, strict=True))
            source = _plain(values["archive_path"])
            if os.path.islink(source):
                raise ValueError(f"{source} is a link")
            held, found, size = os.path.join(folder, "object"), hashlib.sha256(), 0
            with open(held, "xb") as f:
                for piece in file_pieces(source):
                    found.update(piece)
                    f.write(piece)
                    size += len(piece)
                f.flush()
                os.fsync(f.fileno())
            digest = found.hexdigest()
            place = f"{OBJECTS}/{digest[:2]}/{digest}"
            if has_link(self.root, place):
                raise ValueError(f"{place} goes over a link")
            _placed(held, os.path.join(self.root, place), digest)
            os.unlink(held)
            told = {k: v.isoformat() if isinstance(v, (date, datetime)) else v for k, v in values.items()}
            line = json.dumps(told | {"archive_path": os.path.basename(source), "sha256": digest, "size": size}, sort_keys=True, ensure_ascii=False).encode()
            name = os.path.join(folder, f"{hashlib.sha256(line).hexdigest()}.json")
            if not os.path.exists(name):
                _written(name, line)
        return Staged(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        target = os.path.join(self.root, RECORDS)
        os.makedirs(target, exist_ok=True)
        for m in messages:
            if m:
                for name in sorted(os.listdir(m.folder)):
                    _placed(os.path.join(m.folder, name), os.path.join(target, name), name.removesuffix(".json"))
        shutil.rmtree(self._staging(), ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self._staging(), ignore_errors=True)


class ArchiveVault(DataSource):
    """df.write.format("archive_vault").mode("append").save(folder); df has archive_path and what its record is to tell."""

    @classmethod
    def name(cls) -> str:
        return "archive_vault"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a vault is never overwritten; use mode append")
        return VaultWriter(self.options, schema)


def import_archives(archives: DataFrame, vault: str) -> None:
    """Every archive (archive_path and its record's columns) into the vault; those that are there already are reused."""
    spark = archives.sparkSession
    spark.dataSource.register(ArchiveVault)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives.repartition(parts, "archive_path").write.format("archive_vault").mode("append").save(vault)


def records(spark: SparkSession, vault: str) -> DataFrame:
    """(path, archive_path, size, sha256): what each published record says of its object's place."""
    folder = os.path.join(_plain(vault), RECORDS)
    if not os.path.isdir(folder):
        return spark.createDataFrame([], f"path string, {RECORD}").select("path", "archive_path", "size", "sha256")
    found = spark.read.schema(RECORD).json(f"file://{folder}")
    return found.select(F.concat_ws("/", F.lit(OBJECTS), F.substring("sha256", 1, 2), "sha256").alias("path"), "archive_path", "size", "sha256")


def objects(spark: SparkSession, vault: str) -> DataFrame:
    """(path, size, sha256) of the vault's objects, listed by Spark and hashed again in pieces by the tasks."""
    root = _plain(vault).rstrip("/")
    if not os.path.isdir(os.path.join(root, OBJECTS)):
        return spark.createDataFrame([], "path string, size long, sha256 string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}/{OBJECTS}").select("path", F.col("length").alias("size"))

    def run(frames):
        for f in frames:
            full = [_plain(p) for p in f["path"]]
            yield f.assign(path=[os.path.relpath(p, root) for p in full], sha256=[file_sha256(p) for p in full])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "path").mapInPandas(run, "path string, size long, sha256 string")


def audit(spark: SparkSession, vault: str) -> DataFrame:
    """One row: records, archives and problems, from new hashes of all objects."""
    return vault_audit(records(spark, vault), objects(spark, vault), F.col("sha256"))


def sweep(vault: str, stale_seconds: float = STALE_SECONDS) -> list[str]:
    """Removes the staging of runs that began long ago, and names them. Objects and records aren't touched."""
    root, gone = _plain(vault), []
    for name in sorted(os.listdir(root)):
        at = os.path.join(root, name)
        if name.endswith(STAGING) and not os.path.islink(at) and os.path.isdir(at) and time.time() - os.path.getmtime(at) >= stale_seconds:
            shutil.rmtree(at)
            gone.append(name)
    return gone
