"""Export ZIPs as a data source: one partition for each archive, each archive opened once.

Rows are keyed by (archive_sha256, member_ordinal), never by name, so members that share a name are all there, with a
warning. Contents up to `inline_bytes` come along; larger ones are only hashed, in pieces.
"""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive_sha256 string, archive_path string, member_ordinal int, member_path string, size long, sha256 string, content binary, warning string"
PIECE = 1 << 20
INLINE_BYTES = 1 << 20


def file_sha256(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            found.update(piece)
    return found.hexdigest()


class OneArchive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        paths = options.get("path") or ""
        self.paths = sorted(p for part in paths.split(",") if part for p in ([os.path.join(part, n) for n in os.listdir(part) if n.lower().endswith(".zip")] if os.path.isdir(part) else [part]))
        self.inline = int(options.get("inline_bytes", INLINE_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [OneArchive(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        digest = file_sha256(partition.path)
        seen: set[str] = set()
        with zipfile.ZipFile(partition.path) as z:
            for ordinal, info in enumerate(z.infolist()):
                if info.is_dir():
                    continue
                warning = "duplicate member name" if info.filename in seen else None
                seen.add(info.filename)
                found, size, kept = hashlib.sha256(), 0, []
                with z.open(info) as f:
                    while piece := f.read(PIECE):
                        found.update(piece)
                        size += len(piece)
                        if info.file_size <= self.inline:
                            kept.append(piece)
                yield digest, partition.path, ordinal, info.filename, size, found.hexdigest(), b"".join(kept) if info.file_size <= self.inline else None, warning


class ExportArchives(DataSource):
    """spark.read.format("export_archives").load(folder, file or comma-separated list)"""

    @classmethod
    def name(cls) -> str:
        return "export_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, inline_bytes: int = INLINE_BYTES) -> DataFrame:
    spark.dataSource.register(ExportArchives)
    return spark.read.format("export_archives").option("inline_bytes", inline_bytes).load(path)


def occurrences(archives: DataFrame) -> DataFrame:
    """(occ_id, archive_sha256, member_ordinal, member_path, size, sha256): one for each member; occ_id is its identity."""
    from pyspark.sql import functions as F

    return archives.select(F.concat_ws(":", "archive_sha256", "member_ordinal").alias("occ_id"), "archive_sha256", "member_ordinal", "member_path", "size", "sha256")
