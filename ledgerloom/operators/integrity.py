"""Manifests and mirrors, records and objects."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerloom.functions.names import unsafe_path

REUSED, MISSING, CONFLICT, EXTRA, UNSAFE = "reused", "missing", "conflict", "extra", "unsafe"


def reconcile(manifest: DataFrame, destination: DataFrame, key: str = "path", same: tuple[str, ...] = ("size", "sha256")) -> DataFrame:
    """(key, status): what is there and exact is reused, what isn't is missing, what differs is a conflict, and what the
    manifest doesn't name is extra, never to be deleted. Unknown sizes or digests agree with nothing."""
    m, d = (x.select(key, F.struct(*same).alias(n)) for x, n in ((manifest, "_m"), (destination, "_d")))
    agree = F.lit(True)
    for c in same:
        agree = agree & F.coalesce(F.col(f"_m.{c}") == F.col(f"_d.{c}"), F.lit(False))
    status = F.when(F.col("_m").isNull(), EXTRA).when(F.col("_d").isNull(), MISSING).when(agree, REUSED).otherwise(CONFLICT)
    return m.join(d, key, "full_outer").select(key, status.alias("status"))


def unsafe_rows(manifest: DataFrame, key: str = "path") -> DataFrame:
    """Paths that could leave the root or are named twice."""
    twice = manifest.groupBy(key).agg(F.count("*").alias("n"))
    return twice.filter(unsafe_path(F.col(key)) | (F.col("n") > 1)).select(key, unsafe_path(F.col(key)).alias("unsafe"), (F.col("n") > 1).alias("repeated"))


def mirror_plan(manifest: DataFrame, destination: DataFrame) -> DataFrame:
    """reconcile() with unsafe paths marked. It only reads; write it before acting on it."""
    found = reconcile(manifest.dropDuplicates(["path"]), destination)
    bad = unsafe_rows(manifest).select("path", F.lit(True).alias("_bad"))
    return found.join(bad, "path", "left").select("path", F.when(F.col("_bad"), UNSAFE).otherwise(F.col("status")).alias("status"))


def mirror_counts(plan: DataFrame) -> DataFrame:
    """One row: what is to be copied, reused, and all of the manifest; ok only without conflicts and unsafe paths."""
    n = lambda s: F.count_if(F.col("status") == s)
    return plan.agg(n(MISSING).alias("copied"), n(REUSED).alias("reused"), F.count_if(F.col("status") != EXTRA).alias("total"), n(CONFLICT).alias("conflicts"), n(UNSAFE).alias("unsafe_paths")).withColumn("ok", (F.col("conflicts") == 0) & (F.col("unsafe_paths") == 0))


def preflight_passes(plan: DataFrame) -> bool:
    """The barrier before any write: the whole set has neither conflicts nor unsafe paths."""
    return plan.filter(F.col("status").isin(CONFLICT, UNSAFE)).isEmpty()


def orphans(objects: DataFrame, records: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Objects that no record names."""
    r = records.select(*(F.col(b).alias(f"_{b}") for _, b in on)).distinct()
    return objects.join(r, [F.col(a) == F.col(f"_{b}") for a, b in on], "left_anti")


def dangling(records: DataFrame, objects: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Records whose object isn't there."""
    return orphans(records, objects, on)


def binding_conflicts(records: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that records bind to different values."""
    return records.groupBy(*key).agg(F.countDistinct(value).alias("n_values"), F.count("*").alias("n_records")).filter("n_values > 1")


def tree_digests(df: DataFrame, key: str, path: str, digest: str) -> DataFrame:
    """(key, n_files, digest): digests.tree_digest() of each tree, fed from sorted rows, so that a task holds none whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, found = None, 0, None
        made = lambda: pa.record_batch([pa.array([now[0]], kind), pa.array([n]), pa.array([found.hexdigest()])], [key, "n_files", "digest"])
        kind = None
        for batch in batches:
            kind = batch.schema.field(key).type
            for k, p, d in zip(*(batch.column(c).to_pylist() for c in (key, path, digest)), strict=True):
                if now != (k,):
                    if now:
                        yield made()
                    now, n, found = (k,), 0, hashlib.sha256()
                found.update(f"{';' if n else ''}{p}:{d}".encode())
                n += 1
        if now:
            yield made()

    rows = df.select(key, path, digest).filter(F.col(path).isNotNull() & F.col(digest).isNotNull()).repartition(key).sortWithinPartitions(key, path)
    return rows.mapInArrow(run, StructType([df.schema[key], StructField("n_files", LongType()), StructField("digest", StringType())]))


def record_mismatches(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Records that disagree with their verified object's (size, sha256). Objects are verified once and bound often."""
    o = objects.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    agree = F.coalesce((F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha")), F.lit(False))
    return records.join(o, "path").filter(~agree).drop("_size", "_sha")


def vault_audit(records: DataFrame, objects: DataFrame, archive: Column) -> DataFrame:
    """One row: records, archives and problems (mismatches, dangling records, orphan objects)."""
    bad = record_mismatches(records, objects).select(F.lit("mismatch").alias("problem")).unionByName(dangling(records, objects, [("path", "path")]).select(F.lit("dangling").alias("problem"))).unionByName(orphans(objects, records, [("path", "path")]).select(F.lit("orphan").alias("problem")))
    total = records.agg(F.count("*").alias("records"), F.countDistinct(archive).alias("archives"))
    return total.crossJoin(bad.agg(F.count("*").alias("problems")))  # one row each
