"""Importance resampling towards a target distribution, by hashed word features in a sparse matrix.

The documents' counts of features in buckets are a sparse matrix, kept in the shared folder as blocks of compressed
sparse rows (ids, where each row begins, buckets, counts). Column sums of the blocks, and of the target's, give the two
distributions and with them each bucket's gain; the product of the blocks with the gains gives the documents' weights.
Gumbel noise, seeded by the id, turns the weights into scores whose largest are the draw.

The draw's order is made by ranges of scores, so no task sorts more than its range. What reaches the driver is one sum
for each bucket (BUCKETS of them) and one count for each range.

Defined results: null and empty texts have no feature and weight 0, and are only drawn if they have LEAST_WORDS words,
that is never by default; a null id is hashed as the word null and comes last of equal scores; repeated rows are
documents of their own; an empty table gives no rows; without target texts all gains come from the documents alone;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.base import discard, parts_for, slices, staged, table
from ledgerloom.llm.words import ALPHANUMERIC, word_runs

BUCKETS = 10_000
#: Runs of up to so many consecutive words are features.
ORDER = 1
LEAST_WORDS = 20
#: Of the documents with enough words this part is drawn.
PART = (10, 100)
SEED = 2024

BLOCKS = "doc_ids array<long>, words binary, starts binary, buckets binary, counts binary"


def bucket_numbers(column: pa.Array, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each feature, and the number of words of each row. Features are runs of 1 to `order` words."""
    runs, n = word_runs(column, ALPHANUMERIC)
    coded = runs.dictionary_encode()
    names, of = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    rows, found = [row], [np.fromiter((zlib.crc32(w) % buckets for w in names), np.int64, len(names))[of]]
    for k in range(2, order + 1):
        # A longer feature's checksum goes on from the shorter one's: distinct pairs of (run so far, next word) once each.
        at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
        words = np.stack([of[at + i] for i in range(k)], 1)
        distinct, place = np.unique(words, axis=0, return_inverse=True)
        sums = np.fromiter((zlib.crc32(b" ".join(names[i] for i in w)) % buckets for w in distinct.tolist()), np.int64, len(distinct))
        rows.append(row[at])
        found.append(sums[place.reshape(-1)])
    return np.concatenate(rows), np.concatenate(found), n


def matrix(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of documents (doc_id, text) as compressed sparse rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, bucket, words = bucket_numbers(batch.column("text"), order, buckets)
            cells, counts = np.unique(row * buckets + bucket, return_counts=True)
            starts = np.searchsorted(cells, np.arange(batch.num_rows + 1) * buckets)
            values = [words.astype("<i8"), starts.astype("<i8"), (cells % buckets).astype("<i4"), counts.astype("<i4")]
            yield pa.record_batch([pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in values)], [c.split()[0] for c in BLOCKS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, BLOCKS)


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    kinds = {"words": "<i8", "starts": "<i8", "buckets": "<i4", "counts": "<i4"}
    for x in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
        yield tuple(np.frombuffer(v, kinds[n]) if n in kinds else v for n, v in zip(names, x, strict=True))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: tasks add up their blocks, so at most a row for each task and bucket is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for of, n in _arrays(batch, "buckets", "counts"):
                np.add.at(total, of, n.astype(np.int64))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the log of each bucket's ratio of the two distributions, each with one more of every bucket."""
    s_all, t_all, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the product of the matrix with the gains."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, starts, of, n in _arrays(batch, *(c.split()[0] for c in BLOCKS.split(", "))):
                n = n.astype(np.int64)
                through = np.concatenate([[0], np.cumsum(n * gain[of])])[starts]
                seen = np.concatenate([[0], np.cumsum(n)])[starts]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(words), pa.array(np.diff(seen)), pa.array(np.diff(through))], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(product, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and Gumbel noise from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return weighted.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long"))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, part: tuple[int, int] = PART) -> DataFrame:
    """Adds rank to the drawn rows, in the order of score (largest first), then id. Rows are dealt to ranges of that
    order; a range's rows are numbered after all those of the ranges before it."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    enough = F.col("n_words") >= least_words
    dealt = scored.filter(enough).repartitionByRange(parts_for(scored), *order).withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, "resample-ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"), F.max("score").alias("top")).orderBy("_range").collect()
    before, total = {}, 0
    for r in sizes:  # ranges are numbered in their order
        before[r["_range"]] = total
        total += r["n"]
    drawn = total * part[0] // part[1]
    starts = scored.sparkSession.createDataFrame(list(before.items()), "_range int, _before long")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    chosen = dealt.join(F.broadcast(starts), "_range").withColumn("rank", at.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_range", "_before")
    return chosen.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, part: tuple[int, int] = PART, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs (doc_id, text); rank is null for those
    that aren't drawn. target: rows with a column text."""
    blocks = staged(matrix(docs, order, buckets), "resample-matrix")
    aims = matrix(target.select(F.lit(0).alias("doc_id"), "text"), order, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(aims, buckets))
    scored = staged(with_scores(weights(blocks, gain), seed), "resample-scores")
    discard(blocks)
    return ranked(scored, least_words, part)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def oracle(documents: str = "documents", benchmark: str = "benchmark", least_words: int = LEAST_WORDS, part: tuple[int, int] = PART, seed: int = SEED) -> str:
    """The same for features of one word. SQL has no CRC-32, so it is made byte by byte from its polynomial."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda text: f"unnest(regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE source AS (SELECT doc_id, {words("text")} AS w FROM {documents}),
aim AS (SELECT {words("text")} AS w FROM {benchmark}),
eight(b, i, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, i + 1, {step} FROM eight WHERE i < 8),
steps AS (SELECT list(c ORDER BY b) AS t FROM eight WHERE i = 8),
names AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM source UNION SELECT w FROM aim)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(h, CAST(i AS BIGINT), 1)) - 1) + instr('0123456789ABCDEF', substr(h, CAST(i + 1 AS BIGINT), 1)) - 1 AS BIGINT))),
        lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS k FROM names, steps),
mine AS (SELECT s.doc_id, k, count(*) AS n FROM source s JOIN crc USING (w) GROUP BY ALL),
sums AS (SELECT k, sum(s) AS s, sum(t) AS t FROM (SELECT k, n AS s, 0 AS t FROM mine UNION ALL SELECT k, 0, 1 FROM aim JOIN crc USING (w)) GROUP BY k),
gain AS (SELECT k, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g FROM sums),
weight AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM mine JOIN gain USING (k) GROUP BY doc_id),
score AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
          coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM {documents} LEFT JOIN weight USING (doc_id)),
place AS (SELECT *, CASE WHEN n_features >= {least_words} THEN row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (n_features >= {least_words}) OVER () AS n FROM score)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN r <= {part[0]} * n // {part[1]} THEN r END AS BIGINT) AS rank FROM place"""
