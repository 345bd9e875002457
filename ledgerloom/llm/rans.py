"""Token ids in files: a static range asymmetric numeral system over interleaved lanes.

A table of frequencies, scaled to a power of two, is shared by all blocks. A block holds the ids of whole documents;
id i belongs to lane i mod LANES, so that one step codes an id of every lane at once. A state has 63 bits and gives or
takes 32 at a time. Each block has checkpoints (all states and the place in the words) from which a reader can start,
a checksum of its bytes and one of its ids, and can be read without the others.

The file is a Parquet table of blocks beside one of frequencies, in the shared folder, in ascending doc_id order.

Defined results: a null text is empty and gives the end id alone; repeated rows stay, side by side; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.base import ROW_GROUP_BYTES, parts_for, shared_dir, slices, staged, table
from ledgerloom.llm.tokens import PieceEncoder, blobs, ended

END_ID = 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCALE = 20
LANES = 512
#: A block is closed when it has so many ids.
BLOCK_IDS = 1 << 17
#: Steps between two checkpoints.
CHECKPOINT_STEPS = 128
MAGIC = b"LLR1"
HEADER = struct.Struct("<4sBHIIII")  # magic, scale, lanes, ids, steps between checkpoints, words, checkpoints
LOW = np.uint64(1 << 31)


class Table:
    """Frequencies that add up to 2 ** SCALE; every id that was counted has one at least."""

    def __init__(self, counts: dict[int, int]) -> None:
        ids = np.array(sorted(counts), np.int64)
        if len(ids) > 1 << (SCALE - 1):
            raise ValueError("too many different ids for this scale")
        n = np.array([counts[i] for i in ids.tolist()], np.float64)
        room = (1 << SCALE) - len(ids)
        part = n / n.sum() * room if len(ids) else n
        freq = np.floor(part).astype(np.int64)
        order = np.argsort(-(part - freq), kind="stable")
        freq[order[: room - freq.sum()]] += 1
        self.ids, self.freq = ids, (freq + 1).astype(np.uint64)
        self._spread()

    def _spread(self) -> None:
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        top = int(self.ids[-1]) + 1 if len(self.ids) else 1
        self.freq_of, self.cum_of = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq_of[self.ids], self.cum_of[self.ids] = self.freq, self.cum
        self.slot = None

    def slots(self) -> np.ndarray:
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))
        return self.slot

    def __getstate__(self):
        return self.ids.astype(np.int32), self.freq.astype(np.int32)

    def __setstate__(self, state):
        self.ids, self.freq = state[0].astype(np.int64), state[1].astype(np.uint64)
        self._spread()


def encode_block(ids: np.ndarray, shared: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """The block's bytes: header, checkpoints from step 0 on, words in reading order, checksum."""
    n = len(ids)
    steps = -(-n // lanes)
    freq, cum = shared.freq_of[ids], shared.cum_of[ids]
    if n and not freq.all():
        raise ValueError("an id has no frequency")
    limit = freq << np.uint64(63 - SCALE)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    total = 0
    low32, shift32, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        full = x >= limit[a:b]
        if full.any():
            out = x[full]
            words.append((out & low32).astype("<u4"))
            total += len(out)
            x[full] = out >> shift32
        q = x // f
        state[: b - a] = (q << scale) + (x - q * f) + cum[a:b]
        if t % every == 0:
            marks.append((total, state.copy()))
    marks.reverse()
    body = b"".join([
        HEADER.pack(MAGIC, SCALE, lanes, n, every, total, len(marks)),
        np.array([total - m for m, _ in marks], "<u4").tobytes(),
        *(s.astype("<u8").tobytes() for _, s in marks),
        *(w.tobytes() for w in reversed(words)),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes, shared: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint `first` to before checkpoint `last`, by default all."""
    body, (check,) = data[:-4], struct.unpack("<I", data[-4:])
    magic, scale_bits, lanes, n, every, n_words, n_marks = HEADER.unpack_from(body)
    if magic != MAGIC or zlib.crc32(body) != check:
        raise ValueError("the block is damaged")
    at = HEADER.size
    places = np.frombuffer(body, "<u4", n_marks, at)
    at += 4 * n_marks
    states = np.frombuffer(body, "<u8", n_marks * lanes, at).reshape(n_marks, lanes)
    at += 8 * n_marks * lanes
    words = np.frombuffer(body, "<u4", n_words, at).astype(np.uint64)
    steps = -(-n // lanes)
    last = n_marks if last is None else last
    if first >= last:
        return np.zeros(0, np.int64)
    slot, freq, cum = shared.slots(), shared.freq, shared.cum
    state, w = states[first].astype(np.uint64), int(places[first])
    begin, end = first * every, min(steps, last * every)
    out = np.empty(min(n, end * lanes) - begin * lanes, np.int32)
    mask, scale, shift32 = np.uint64((1 << scale_bits) - 1), np.uint64(scale_bits), np.uint64(32)
    for t in range(begin, end):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x = state[: b - a]
        low = x & mask
        sym = slot[low]
        out[a - begin * lanes : b - begin * lanes] = sym
        x = freq[sym] * (x >> scale) + low - cum[sym]
        need = x < LOW
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << shift32) | words[w : w + k]
            w += k
        state[: b - a] = x
    return shared.ids[out]


TOKENS = "part int, row long, start long, doc_id long, n_tokens long, ids binary, kinds binary, counts binary"
BLOCKS = "part int, row long, start long, n_docs int, n_ids long, ids_crc32 long, doc_ids array<long>, lengths binary, block binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Ids of each text in ascending doc_id order: `part` is a range of doc_id, start counts from the part's begin. A
    part's last row has no document, but the different ids of the part and how often each occurs."""
    names = [x.split()[0] for x in TOKENS.split(", ")]

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, start = TaskContext.get().partitionId(), 0, 0
        encoder = PieceEncoder.shared(tokenizer, "<u2")
        counts = np.zeros(1 << 16, np.int64)
        for batch in slices(batches, "text", 16 << 20):
            ids, n = ended(*encoder.encode(batch.column("text")), end_id)
            counts += np.bincount(ids, minlength=1 << 16)
            through = start + np.cumsum(n)
            none = pa.nulls(len(n), pa.binary())
            yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(row + np.arange(len(n))), pa.array(through - n), batch.column("doc_id"), pa.array(n), blobs(ids, n), none, none], names)
            row, start = row + len(n), int(through[-1])
        if row:
            found = np.flatnonzero(counts)
            both = [pa.array([x.tobytes()], pa.binary()) for x in (found.astype("<u2"), counts[found].astype("<i8"))]
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([row]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *both], names)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts_for(docs), "doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    return ordered.mapInArrow(ids_of, TOKENS)


def frequencies(tokens: DataFrame) -> Table:
    """From all ids; at most as many rows as the vocabulary has reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for kinds, counts in zip(batch.column("kinds").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n[np.frombuffer(kinds, "<u2")] += np.frombuffer(counts, "<i8")
        found = np.flatnonzero(n)
        yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(n[found])], ["id", "n"])

    rows = tokens.filter("kinds is not null").select("kinds", "counts").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return Table({r["id"]: r["n"] for r in rows})


def write_blocks(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> str:
    """Writes the blocks and the frequency table under a new folder in the shared one, and returns its path."""
    spark = docs.sparkSession
    tokens = staged(tokenize(docs, tokenizer, end_id), "ids")
    shared = frequencies(tokens)
    tokens = tokens.filter("kinds is null")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row for each task of tokenize()
    placed = tokens.join(F.broadcast(bases), "part", "left").select("part", "row", (F.col("start") + F.col("_base")).alias("start"), "doc_id", "n_tokens", "ids")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = b"".join(r[5] for r in held)
            block = encode_block(np.frombuffer(ids, "<u2"), shared)
            row = (held[0][0], held[0][1], held[0][2], len(held), len(ids) // 2, zlib.crc32(ids), [r[3] for r in held], np.array([r[4] for r in held], "<u4").tobytes(), block)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in slices(batches, "ids"):
            for row in zip(*(batch.column(k).to_pylist() for k in ("part", "row", "start", "doc_id", "n_tokens", "ids")), strict=True):
                if held and (size >= BLOCK_IDS or row[0] != held[-1][0] or row[1] != held[-1][1] + 1):
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += row[4]
        if held:
            yield close()

    path = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    placed.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/blocks")
    spark.createDataFrame(pa.table({"id": pa.array(shared.ids.astype(np.int32)), "freq": pa.array(shared.freq.astype(np.int32))})).coalesce(1).write.parquet(f"{path}/frequencies")
    return path


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files; ids as packed 32-bit integers."""
    rows = spark.read.schema("id int, freq int").parquet(f"{path}/frequencies").collect()  # vocabulary rows at most
    shared = Table.__new__(Table)
    rows.sort(key=lambda r: r["id"])
    shared.__setstate__((np.array([r["id"] for r in rows], np.int32), np.array([r["freq"] for r in rows], np.int32)))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block", 1 << 20):
            for start, check, docs, lengths, block in zip(*(batch.column(k).to_pylist() for k in ("start", "ids_crc32", "doc_ids", "lengths", "block")), strict=True):
                ids = decode_block(block, shared)
                if zlib.crc32(ids.astype("<u2").tobytes()) != check:
                    raise ValueError("the ids differ from those that were written")
                n = np.frombuffer(lengths, "<u4").astype(np.int64)
                data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(n)
                parts = [data[b - 4 * k : b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(docs, pa.int64()), pa.array(start + ends // 4 - n), pa.array(n), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("start", "ids_crc32", "doc_ids", "lengths", "block").mapInArrow(documents, READ)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(spark, write_blocks(table(spark, sf_dir, "documents"))).drop("ids")
