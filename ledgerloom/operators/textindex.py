"""A stored index of texts by runs of three characters, for searches that don't read all texts.

Postings are rows (gram, block, n, deltas): the ids of one block of 65,536 that have the run, as differences. So the most
frequent run is many rows, and no list grows with the table. Each intake adds a generation of postings; compact() merges
them. A search reads the rows of its words' runs (a filter that reaches the scan), intersects them block by block, and
tests the few texts that are left, so it finds what a scan would.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN, BLOCK_BITS = 3, 16
POSTINGS = "gram long, block long, n int, deltas binary"
#: A task sorts about so many runs of texts together.
PART_RUNS = 2_000_000
#: A search that leaves no more candidates than this asks the scan for their ids; with more, texts are joined.
LISTED = 2_000


def grams_of(text: str) -> np.ndarray:
    """The text's different runs, as numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < RUN:
        return np.zeros(0, np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])


def _packed(gram: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Rows of sorted, distinct (gram, id)."""
    block = ids >> BLOCK_BITS
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])])) if len(ids) else np.zeros(0, np.int64)
    delta = np.diff(ids, prepend=0)
    delta[new] = ids[new] & ((1 << BLOCK_BITS) - 1)
    n = np.diff(np.append(new, len(ids)))
    ends = np.append(new, len(ids)).astype(np.int32) * 2
    data = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(delta.astype("<u2"))])
    return pa.record_batch([pa.array(gram[new]), pa.array(block[new]), pa.array(n.astype(np.int32)), data], [c.split()[0] for c in POSTINGS.split(", ")])


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(gram, id) of all rows."""
    n = batch.column("n").to_numpy().astype(np.int64)
    delta = np.frombuffer(b"".join(batch.column("deltas").to_pylist()), "<u2").astype(np.int64)
    through = np.cumsum(delta)
    starts = np.cumsum(n) - n
    inside = through - np.repeat(through[starts] - delta[starts], n) if len(n) else through
    return np.repeat(batch.column("gram").to_numpy(), n), np.repeat(batch.column("block").to_numpy() << BLOCK_BITS, n) + inside


def _distinct(gram: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, gram))
    gram, ids = gram[order], ids[order]
    keep = np.concatenate([[True], (gram[1:] != gram[:-1]) | (ids[1:] != ids[:-1])]) if len(ids) else np.zeros(0, bool)
    return gram[keep], ids[keep]


def postings(texts: DataFrame) -> DataFrame:
    """POSTINGS of each part of texts (id, text); parts aren't merged. Null ids and texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grams, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id"), batch.column("text"), strict=True):
                ids.append(i.as_py())
                grams.append(grams_of(t.as_py()))
                size += len(grams[-1])
                if size >= PART_RUNS:
                    yield part(ids, grams)
                    ids, grams, size = [], [], 0
        if ids:
            yield part(ids, grams)

    def part(ids: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
        return _packed(*_distinct(np.concatenate(grams), np.repeat(np.array(ids, np.int64), [len(g) for g in grams])))

    return texts.filter("id is not null and text is not null").select(F.col("id").cast("long"), F.lower("text").alias("text")).mapInArrow(run, POSTINGS)


def merged(rows: DataFrame) -> DataFrame:
    """POSTINGS with one row for each (gram, block), in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # rows of the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, block = batch.column("gram").to_numpy(), batch.column("block").to_numpy()
            cut = int(np.argmax((gram == gram[-1]) & (block == block[-1])))
            first = rest[0] if rest else batch
            goes_on = cut == 0 and first.column("gram")[0].as_py() == gram[-1] and first.column("block")[0].as_py() == block[-1]
            if not goes_on:
                whole = pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()
                if whole:
                    yield _packed(*_distinct(*unpacked(whole[0])))
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield _packed(*_distinct(*unpacked(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])))

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    return rows.repartitionByRange(parts, "gram", "block").sortWithinPartitions("gram", "block").mapInArrow(run, POSTINGS)


class TextIndex:
    """An index in a folder that all executors share. generations are its parts, oldest first."""

    def __init__(self, spark: SparkSession, folder: str, generations: tuple[str, ...] = ()) -> None:
        self.spark, self.folder, self.generations = spark, folder.rstrip("/"), generations

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/generation-{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", 8 << 20).parquet(path)
        return path

    def add(self, texts: DataFrame) -> TextIndex:
        """The index with an intake (id, text) more. Ids may come again with other texts: searches test the text that is
        there now."""
        return TextIndex(self.spark, self.folder, (*self.generations, self._write(merged(postings(texts)))))

    def compact(self) -> TextIndex:
        """One generation of all; the old ones stay for readers that have them."""
        return TextIndex(self.spark, self.folder, (self._write(merged(self._rows())),)) if len(self.generations) > 1 else self

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(*self.generations)

    def candidates(self, words: str) -> DataFrame | None:
        """(id) of texts that have all runs of the words; None where the words are too short to tell."""
        lowered = self.spark.range(1).select(F.lower(F.lit(words))).first()[0]
        grams = grams_of(lowered).tolist()
        if not grams:
            return None
        if not self.generations:
            return self.spark.createDataFrame([], "id long")

        def run(rows: pa.Table) -> pa.Table:
            batches = rows.combine_chunks().to_batches()
            _, ids = _distinct(*unpacked(batches[0]))
            found, n = np.unique(ids, return_counts=True)
            return pa.table([pa.array(found[n == len(grams)])], ["id"])

        return self._rows().filter(F.col("gram").isin(grams)).groupBy("block").applyInArrow(run, "id long")

    def search(self, df: DataFrame, key: str, text: str, words: str, k: int, order: list[Column]) -> DataFrame:
        """The first k rows of df whose text contains the words, regardless of case; df has the texts that were added."""
        found = self.candidates(words)
        if found is not None:
            ids = [r["id"] for r in found.limit(LISTED + 1).collect()]
            df = df.filter(F.col(key).isin(ids)) if len(ids) <= LISTED else df.join(found.withColumnRenamed("id", key), key, "left_semi")
        return df.filter(F.contains(F.lower(F.col(text)), F.lower(F.lit(words)))).orderBy(*order).limit(k)
