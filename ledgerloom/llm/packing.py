"""Best-fit packing of token pieces into sequences.

Documents above one third of the capacity go at most two to a sequence: the longest is matched with the longest that
still fits beside it. Smaller ones, longest first, go to the fullest sequence that takes them. Lengths are whole
numbers up to the capacity, so the plan is made from the histogram of lengths (as many rows as the capacity at most)
and says which ranks of a length go to which run of sequences at which offset; pieces then look up their rank.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.base import release, slices, staged, table
from ledgerloom.llm.tokens import PieceEncoder, blobs, ended

CAPACITY = 2048
END_ID = 0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Pieces of one length that one task ranks, about.
RANKED_AT_ONCE = 200_000
#: Texts that are encoded at once: what that takes is many times as much.
TEXT_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, offset, how many), by length and rank, and the number of sequences.

    Row: ranks first..first+many-1 of that length go to as many sequences in a row, at that offset.
    """
    left = {k: int(v) for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    ranked = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    gaps: list[int] = []
    made = 0

    def put(length: int, first: int, offset: int, many: int) -> None:
        rows.append((length, ranked[length], first, offset, many))
        ranked[length] += many
        left[length] -= many

    def open_run(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, many))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        fits = bisect_left(large, capacity - a + 1) - 1
        b = large[fits] if fits >= 0 else None
        if b == a and left[a] < 2:
            b = large[fits - 1] if fits else None
        many = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        put(a, made, 0, many)
        if b is not None:
            put(b, made, a, many)
        open_run(capacity - a - (b or 0), made, many)
        made += many
        large = [k for k in large if left[k]]

    for length in sorted((k for k in left if left[k]), reverse=True):
        while left[length]:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                each = capacity // length
                open_run(capacity, made, -(-left[length] // each))
                made += -(-left[length] // each)
                continue
            gap = gaps[i]
            first, many = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[i]
            each = gap // length
            whole = min(many, left[length] // each)
            if whole:
                for k in range(each):
                    put(length, first, capacity - gap + k * length, whole)
                open_run(gap - each * length, first, whole)
            elif rest := left[length]:
                whole = 1
                for k in range(rest):
                    put(length, first, capacity - gap + k * length, 1)
                open_run(gap - rest * length, first, 1)
            open_run(gap, first + whole, many - whole)
    out = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return out, made


def cut_pieces(batches: Iterator[pa.RecordBatch], tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> Iterator[pa.RecordBatch]:
    """Pieces of batches with doc_id and text, of TEXT_BYTES of texts at once."""
    release()  # what earlier stages left in this process
    encoder = PieceEncoder.shared(tokenizer)
    for batch in slices(batches, "text", TEXT_BYTES):
        ids, n = ended(*encoder.encode(batch.column("text")), end_id)
        pieces = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[doc] - number * capacity)
        yield pa.record_batch([batch.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(size), blobs(ids, size)], ["doc_id", "piece", "start", "length", "ids"])
        release()


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids, cut from each text's ids and the end id; ids are packed 32-bit integers."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: cut_pieces(batches, tokenizer, end_id, capacity), PIECES)


def place(pieces: DataFrame, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """sequence_id and offset for each (doc_id, piece, start, length, *keep) of a table that has been written."""
    names = ["doc_id", "piece", "start", "length", *keep]
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(counts, capacity)
    parts = max(1, max(counts.values(), default=1) // RANKED_AT_ONCE)
    dealt = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int").alias("_deal"))
    if parts > 1:
        before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
        sums = dealt.groupBy("length", "_deal").agg(F.count("*").alias("_n"))
        sums = sums.select("length", "_deal", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        dealt = dealt.join(F.broadcast(sums), ["length", "_deal"]) if parts * capacity < 100_000 else dealt.join(sums, ["length", "_deal"])
    else:
        dealt = dealt.withColumn("_before", F.lit(0).cast("long"))
    order = Window.partitionBy("length", "_deal").orderBy("doc_id", "piece", *keep)
    ranked = dealt.select(*names, (F.col("_before") + F.row_number().over(order) - 1).alias("_rank"))
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    shift = np.int64(1) << 40
    starts = rows[:, 0] * shift + rows[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "_rank"))
            at = np.searchsorted(starts, length * shift + rank, "right") - 1
            found = rows[at]
            yield pa.record_batch([*(batch.column(k) for k in names), pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids (a table in the shared folder), and where each is placed, with a digest of its ids."""
    pieces = staged(tokenize(docs, tokenizer, end_id, capacity), "pieces")
    return pieces, place(pieces.withColumn("ids_crc32", F.crc32("ids")), capacity, ("ids_crc32",))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))[1]
