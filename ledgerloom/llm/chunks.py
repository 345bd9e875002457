"""Documents as numbers, in chunks with their own numbering of words, and packed arrays.

A chunk's row has its documents, the hashes of its different words, and the words' numbers in the order of the texts;
every document ends with the end token. Words are runs of characters other than ASCII white space, A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.base import slices, strings

#: Tokens of a chunk, about; a longer document is a chunk of its own.
CHUNK_TOKENS = 1_000_000
#: Bytes of a word with the space after it, about.
WORD_BYTES = 6
#: Stands for a document's end; no word has white space.
END = b"\n"

CHUNKS = "chunk long, n_tokens long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary"


def packed(x: np.ndarray) -> bytes:
    """Compressed, byte by byte: first all lowest bytes, then the next."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.dtype.char.encode() + x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:1].decode())
    return np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1)


def numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words with END as the last, the words' numbers with END after each text's, and how many each text
    has with it."""
    texts = strings(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten().dictionary_encode()
    names, tokens = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(zero_copy_only=False)
    through = lists.offsets.to_numpy().astype(np.int64)
    through -= through[0]
    if b"" in names:  # white space at an end of a text
        empty = names.index(b"")
        keep = tokens != empty
        through = np.concatenate([[0], np.cumsum(keep)])[through]
        tokens = tokens[keep]
        tokens = tokens - (tokens > empty)
        del names[empty]
    return [*names, END], np.insert(tokens, through[1:], len(names)).astype(np.uint32), np.diff(through) + 1


def chunk_rows(batches: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[list]:
    """A task's chunks, of batches with doc_id, held and text."""
    import xxhash

    task, made = TaskContext.get().partitionId(), count()
    for batch in slices(batches, "text", chunk_tokens * WORD_BYTES):
        names, tokens, lengths = numbered(batch.column("text"))
        h = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        yield [(task << 32) + next(made), len(tokens), batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), lengths.astype(np.uint32), h, tokens]


def chunks(docs: DataFrame, held: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary())
        for row in chunk_rows(batches, chunk_tokens):
            row[4:] = map(packed, row[4:])
            yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), held.alias("held"), "text").mapInArrow(cut, CHUNKS)
