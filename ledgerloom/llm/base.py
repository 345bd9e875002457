"""What the operators of this folder share: input tables, shared-folder staging, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of wide columns are written in row groups of this size, so that a task holds little of them.
ROW_GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only where none is set and all tasks run on this
    machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free_shuffles(spark: SparkSession) -> None:
    """Turns on, for the session, that a query's shuffle files go when it has ended, not when the driver happens to
    collect its garbage. What a later step needs is in a table by then."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    free_shuffles(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Deletes the tables in the shared folder that df reads, or their folders of that name; for those that nothing needs
    any more."""
    spark = df.sparkSession
    base = shared_dir(spark).removeprefix("file:").lstrip("/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if base in folder and folder.endswith(part):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@cache
def _trim():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Gives back to the system what this process has freed: of the chunk, group or stage before."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def parts_for(df: DataFrame) -> int:
    """Shuffle partitions that grow with the input: as many as it is read in, and no fewer than the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty. It is copied first: casts of slices keep their buffers' offsets,
    which some Arrow functions don't mind."""
    import numpy as np
    import pyarrow.compute as pc

    return pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column takes about `most` bytes in each; a longer row stays alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.nbytes <= most or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def portions(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of about `most` bytes, by their rows' average size."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
