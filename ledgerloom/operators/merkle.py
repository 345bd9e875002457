"""Trees of files by hashes of their folders: one digest for all that is below a folder, and the difference of two trees
by opening only folders that differ.

A folder's digest is of its parts, in order; a part is of the entries whose names' hashes begin with the same three
digits, in the order of their names. So a folder with very many entries is 4,096 groups, and a tree is never one task's.
Levels are made from the deepest up, each from the level below it.

Defined results: a path that is null or names no file is left out, as a file or a folder's empty name; the same path twice
is one file, unknown unless both agree; an unknown digest makes all folders above it unknown, and unknown equals nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

#: Digits of a name's hash that tell its part of a folder.
PART_DIGITS = 3
FILE, FOLDER = "file", "folder"
ADDED, REMOVED, CHANGED, UNKNOWN = "added", "removed", "changed", "unknown"
NODES = ["tree", "depth", "parent", "name", "kind", "digest", "n_files", "n_bytes"]


def _digest_of(entries: Column, unknown: Column) -> Column:
    """Of sorted (name, kind, digest) rows; null if one is unknown."""
    lines = F.transform(entries, lambda e: F.concat_ws(":", e["kind"], e["digest"], e["name"]))
    return F.when(~unknown, F.sha2(F.array_join(lines, "\n"), 256))


def _files(files: DataFrame, tree: str, path: str, digest: str, size: str | None) -> DataFrame:
    rows = files.select(F.col(tree).alias("tree"), F.col(path).alias("path"), F.col(digest).alias("d"), (F.col(size) if size else F.lit(0)).cast("long").alias("b"))
    rows = rows.filter("path is not null and path <> '' and not path like '%/'")
    one = rows.groupBy("tree", "path").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count_if(F.col("d").isNull()).alias("none"), F.max("b").alias("n_bytes"))
    same = F.when((F.col("none") == 0) & (F.col("low") == F.col("high")), F.col("low"))
    parts = F.split("path", "/")
    return one.select("tree", F.size(parts).alias("depth"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("parent"), F.element_at(parts, -1).alias("name"), F.lit(FILE).alias("kind"), same.alias("digest"), F.lit(1).cast("long").alias("n_files"), "n_bytes")


def _folders(entries: DataFrame, depth: int) -> DataFrame:
    """The folders that hold entries of one depth."""
    told = entries.withColumn("part", F.substring(F.sha2("name", 256), 1, PART_DIGITS))
    unknown = F.bool_or(F.col("digest").isNull())
    row = F.struct("name", "kind", "digest")
    parts = told.groupBy("tree", "parent", "part").agg(F.sort_array(F.collect_list(row)).alias("rows"), unknown.alias("no"), F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    parts = parts.select("tree", "parent", "n_files", "n_bytes", F.struct(F.col("part").alias("name"), F.lit("part").alias("kind"), _digest_of(F.col("rows"), F.col("no")).alias("digest")).alias("row"))
    whole = parts.groupBy("tree", "parent").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.bool_or(F.col("row.digest").isNull()).alias("no"), F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    steps = F.split("parent", "/")
    above = F.when(F.size(steps) > 1, F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), "/")).otherwise("")
    return whole.select("tree", F.lit(depth - 1).alias("depth"), above.alias("parent"), F.when(F.col("parent") == "", "").otherwise(F.element_at(steps, -1)).alias("name"), F.lit(FOLDER).alias("kind"), _digest_of(F.col("rows"), F.col("no")).alias("digest"), "n_files", "n_bytes")


def nodes(files: DataFrame, tree: str, path: str, digest: str, size: str | None = None) -> DataFrame:
    """(tree, depth, parent, name, kind, digest, n_files, n_bytes): every file and folder; a tree's root has depth 0."""
    leaves = stored(_files(files, tree, path, digest, size), "merkle-files")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    levels, below = [leaves], None
    for depth in range(deepest, 0, -1):
        here = leaves.filter(F.col("depth") == depth)
        below = stored(_folders(here if below is None else here.unionByName(below), depth), "merkle-folders")
        levels.append(below)
    return reduce(DataFrame.unionByName, levels).select(*NODES)


def roots(found: DataFrame) -> DataFrame:
    """(tree, digest, n_files, n_bytes)"""
    return found.filter("depth = 0").select("tree", "digest", "n_files", "n_bytes")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tree, path, status, before, after) of the files that differ between two sets of nodes, tree by tree.

    From the roots down, level by level, only the entries of folders that differ are looked at; equal folders stay shut,
    whatever they hold. A folder on one side only is opened to its files.
    """
    side = lambda df, d, n: df.filter(F.col("depth") == d).select("tree", "parent", "name", "kind", F.col("digest").alias(n), F.lit(True).alias(f"_{n}"))
    deepest = max(df.agg(F.max("depth")).first()[0] or 0 for df in (before, after))
    found, opened = [], None
    for depth in range(deepest + 1):
        both = [side(df, depth, n) for df, n in ((before, "before"), (after, "after"))]
        if opened is not None:
            both = [x.join(opened, ["tree", "parent"], "left_semi") for x in both]
        pairs = both[0].join(both[1], ["tree", "parent", "name", "kind"], "full_outer")
        differ = stored(pairs.filter(~F.coalesce(F.col("before") == F.col("after"), F.lit(False))), "merkle-differences")
        path = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws("/", "parent", "name"))
        status = F.when(F.col("_before").isNull(), ADDED).when(F.col("_after").isNull(), REMOVED).when(F.col("before").isNull() | F.col("after").isNull(), UNKNOWN).otherwise(CHANGED)
        found.append(differ.filter(F.col("kind") == FILE).select("tree", path.alias("path"), status.alias("status"), "before", "after"))
        opened = differ.filter(F.col("kind") == FOLDER).select("tree", path.alias("parent"))
        if opened.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def evidence(before: DataFrame, after: DataFrame, allowed: Column) -> DataFrame:
    """What an upgrade of trees did: (tree, before, after, changed, not_allowed, ok). `allowed` tells of `path` and
    `status` whether a difference may be; ok needs both roots known and nothing else different."""
    differ = differences(before, after).withColumn("_ok", F.coalesce(allowed, F.lit(False)))
    counts = differ.groupBy("tree").agg(F.count("*").alias("changed"), F.count_if(~F.col("_ok")).alias("not_allowed"))
    a, b = (roots(df).select("tree", F.col("digest").alias(n)) for df, n in ((before, "before"), (after, "after")))
    all_of = a.join(b, "tree", "full_outer").join(counts, "tree", "left").na.fill(0, ["changed", "not_allowed"])
    return all_of.withColumn("ok", F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("not_allowed") == 0))
