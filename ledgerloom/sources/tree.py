"""What is below a folder that all executors mount, listed level by level in tasks; links are told and never followed.

A level's folders are dealt to tasks, which list them; their folders are the next level. So no walk is the driver's or
one task's, and a folder is the only thing that one task lists whole. What lies below a link isn't part of the tree: paths
that would go over one are found by their prefixes.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

FILE, FOLDER, LINK, OTHER, UNREADABLE = "file", "folder", "link", "other", "unreadable"
ENTRIES = "path string, kind string, size long, detail string"
#: Fixed values of Windows: the attribute of reparse points, and the tags of links and of junctions.
REPARSE_POINT = 0x400
REPARSE_TAGS = {0xA000000C: "symbolic link", 0xA0000003: "junction"}


def kind_of(found: os.stat_result) -> tuple[str, str | None]:
    """(kind, detail) of what lstat says. Every reparse point counts as a link, also those of kinds that aren't known."""
    if stat.S_ISLNK(found.st_mode):
        return LINK, "symbolic link"
    if getattr(found, "st_file_attributes", 0) & REPARSE_POINT:
        return LINK, REPARSE_TAGS.get(getattr(found, "st_reparse_tag", 0), "reparse point")
    if stat.S_ISDIR(found.st_mode):
        return FOLDER, None
    if stat.S_ISREG(found.st_mode):
        return FILE, None
    return OTHER, "neither a file nor a folder"


def _listed(root: str, folder: str) -> Iterator[tuple]:
    try:
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                try:
                    found = os.lstat(e.path)
                    kind, detail = kind_of(found)
                    yield path, kind, found.st_size if kind == FILE else None, detail
                except OSError as problem:
                    yield path, UNREADABLE, None, str(problem)
    except OSError as problem:
        yield folder, UNREADABLE, None, str(problem)


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, size, detail) of all below root, by paths from there; root itself may be a link, as a mount is."""
    root = root.removeprefix("file://")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for row in _listed(root, folder):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in ENTRIES.split(", ")])
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in ENTRIES.split(", ")])

    levels, folders = [], spark.createDataFrame([("",)], "path string")
    while True:
        level = stored(folders.repartition(parts, "path").mapInArrow(run, ENTRIES), "tree-level")
        levels.append(level)
        folders = level.filter(F.col("kind") == FOLDER).select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def over_links(paths: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """Rows of paths that are a link or lie below one (found: rows of entries()), with the topmost as _link. Each path
    meets the links by its own prefixes, so the join has equal keys."""
    links = found.filter(F.col("kind") == LINK).select(F.col("path").alias("_link"))
    steps = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    hit = paths.select(path, F.explode(prefixes).alias("_link")).join(links, "_link").groupBy(path).agg(F.min_by("_link", F.length("_link")).alias("_link"))
    return paths.join(hit, path)
