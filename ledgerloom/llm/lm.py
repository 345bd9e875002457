"""A language model of any order with Katz backoff, and scores of all documents by it.

Counts are discounted by Good and Turing's estimate up to LARGEST; what a context gives up goes to words that weren't
seen after it, by their probability after the context without its first word, with a weight that makes the context's
probabilities add up to one. The unigrams give a part to all unknown words together. A document is read between end
tokens; the end is predicted too. Contexts don't reach beyond the end token before a document's first word.

Documents are cut into chunks, each with its own numbering of words. Order by order, a chunk sends its distinct words,
pairs and longer runs, with counts, to buckets by their context's hash, packed as arrays; a bucket adds up what all
chunks sent (its part of the model's table) and answers each chunk in the order in which it asked. So a frequent run is
one entry for each chunk, however often it occurs, and runs of a context that is too frequent for one bucket are dealt
by their last word too. A word that was seen after a context was seen after the shorter one, so the count of the shorter
run, which the chunk knows by then, is all that a bucket needs for the weights.

A run that one chunk alone has is private: what follows it is in no other chunk either, so the chunk counts that itself
and sends its part of the sums. A run that ends with a private one is private too; its last word isn't sent, as it needs
no telling apart. Where the counts shall stay as a table for other uses (`stored`), every run is sent in full.

Where Good and Turing's estimate isn't defined or isn't between 0 and 1, r counts as r - 1/2. A context whose counts
aren't discounted counts as seen once more, so that something is left for other words. Words are known by 64 bits of
a hash.

Defined results: a null or empty text is the end token alone; repeated rows count and are scored each; null ids are
training documents; an empty table gives no rows; without training documents every token is unknown with probability
one; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.base import ROW_GROUP_BYTES, discard, free_shuffles, release, shared_dir, staged, table
from ledgerloom.llm.chunks import CHUNK_TOKENS, chunk_rows, packed, unpacked

#: Tokens for each bucket, about.
BUCKET_TOKENS = 2_000_000
#: Counts up to this are discounted.
LARGEST = 5
#: Chunks are scored in rounds of about so many tokens, ROUNDS at most, so that shuffles hold a part of what the tables hold.
ROUND_TOKENS, ROUNDS = 8_000_000, 4
#: Words of the longest runs that are counted.
ORDER = 3

ANSWERS = "kind int, chunk long, bucket int, a binary, b binary, c binary"
#: Kinds of answers: to a chunk (counts), a bucket's part of the model, its sums, sums of hot contexts, to a chunk (sums
#: of contexts). Counts in answers are doubled, with one more for private runs.
ANSWER, MODEL, SUMS, HOT, CONTEXTS = range(5)
#: Kinds of a chunk's rows: the texts, and the words' hashes and counts, which only the first question needs.
TEXTS, HASHES = range(2)
CHUNKED = "kind int, chunk long, n_tokens long, doc_ids array<long>, held array<boolean>, lengths binary, tokens binary, words binary, counts binary"


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["kind", "chunk", "bucket", "a", "b", "c"])


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return _answers(rows).combine_chunks().to_batches()[0]


def _train_counts(tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(tokens[np.repeat(~held, lengths)], minlength=size)


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are in ascending order, equal ones as they come, and the sorted keys. Places go into the low bits
    where there is room: sorting numbers is much faster than sorting places."""
    bits = np.uint64(len(keys).bit_length())
    if len(keys) and not int(keys.max()) >> int(64 - bits):
        both = np.sort(keys.astype(np.uint64) << bits | np.arange(len(keys), dtype=np.uint64))
        return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def numbered_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and each key's place among them."""
    order, ranked = in_order(keys)
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def texts_and_hashes(docs: DataFrame, held: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Two rows for each chunk. That of the texts has the order of the words by hash, in place of the hashes."""
    names = [x.split()[0] for x in CHUNKED.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, n_tokens, ids, out, lengths, h, tokens in chunk_rows(batches, chunk_tokens):
            n = _train_counts(tokens, lengths, np.array(out, bool), len(h))
            order = np.argsort(h)
            texts = (TEXTS, chunk, n_tokens, ids, out, packed(lengths), packed(tokens), packed(order.astype(np.uint32)), None)
            hashes = (HASHES, chunk, None, None, None, None, None, packed(np.diff(h[order], prepend=np.uint64(0))), packed(n[order]))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(texts, hashes, strict=True), kinds, strict=True)], names)
            release()

    return docs.select(F.col("doc_id").cast("long"), held.alias("held"), "text").mapInArrow(run, CHUNKED)


def ask_words(hashes: DataFrame, buckets: int) -> DataFrame:
    """A message (chunk, bucket, hashes, training counts) for each chunk and bucket, which is a range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([-(-(b << 64) // buckets) for b in range(buckets)], np.uint64)
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(k).to_pylist() for k in ("chunk", "words", "counts")), strict=True):
                h, n = np.cumsum(unpacked(words)), unpacked(counts)
                cuts = np.append(np.searchsorted(h, edges), len(h))
                yield _messages([(ANSWER, chunk, b, packed(h[part]), packed(n[part]), None) for b in range(buckets) for part in (slice(cuts[b], cuts[b + 1]),) if cuts[b] < cuts[b + 1]])

    return hashes.select("chunk", "words", "counts").mapInArrow(run, ANSWERS)


def added(place: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The whole numbers of each place added up, without the rounding of bincount's weights."""
    out = np.zeros(size, np.int64)
    np.add.at(out, place, counts.astype(np.int64))
    return out


def _sums(counts: np.ndarray) -> np.ndarray:
    """[kinds, tokens, how many have 1, 2, ... LARGEST + 1, tokens of those over LARGEST]"""
    counts = counts[counts > 0].astype(np.int64)
    return np.array([len(counts), counts.sum(), *np.bincount(np.minimum(counts, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2], counts[counts > LARGEST].sum()], np.int64)


def _marked(total: np.ndarray, place: np.ndarray, stored: bool) -> np.ndarray:
    """Doubled counts, with one more for what one chunk alone has sent."""
    return total * 2 + (0 if stored else np.bincount(place, minlength=len(total)) == 1)


def answer_words(asked: DataFrame, buckets: int, stored: bool = True) -> DataFrame:
    """To each message the words' ids and total counts; ids are bucket + place * buckets, frequent words first: small
    numbers pack well."""

    def run(rows: pa.Table) -> pa.Table:
        release()
        chunk, bucket = rows.column("chunk").to_pylist(), rows.column("bucket")[0].as_py()
        h, n = ([unpacked(x) for x in rows.column(k).to_pylist()] for k in "ab")
        keys, place = numbered_keys(np.concatenate(h))
        total = added(place, np.concatenate(n), len(keys))
        order = np.lexsort((keys, -total))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        keys, total, place = keys[order], total[order], rank[place]
        ends = np.cumsum([len(x) for x in h])[:-1]
        ids = (bucket + np.arange(len(keys), dtype=np.uint64) * np.uint64(buckets)).astype(np.uint32 if len(keys) * buckets < 2**32 else np.uint64)
        told = _marked(total, place, stored)
        out = [(ANSWER, c, bucket, packed(ids[p]), packed(told[p]), None) for c, p in zip(chunk, np.split(place, ends), strict=True)]
        model = [(MODEL, None, bucket, packed(keys), packed(total), None)] if stored else []
        return _answers([*out, *model, (SUMS, None, bucket, packed(_sums(total)), None, None)])

    return asked.groupBy("bucket").applyInArrow(run, ANSWERS)


class Discounts:
    """From the sums over all buckets."""

    def __init__(self, sums: np.ndarray) -> None:
        self.kinds, self.tokens = int(sums[0]), int(sums[1])
        n = [0, *map(int, sums[2 : LARGEST + 3])]
        last = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
        self.d = np.ones(LARGEST + 1)
        for r in range(1, LARGEST + 1):
            found = ((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last) if n[r] and last != 1 else 0.0
            self.d[r] = found if 0 < found < 1 else (r - 0.5) / r
        self.kept = sum(self.d[r] * r * n[r] for r in range(1, LARGEST + 1)) + int(sums[LARGEST + 3])
        self.unknown = max(n[1], 1) / (self.tokens + 1)

    def of(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.d[np.where(counts <= LARGEST, counts, 0)]

    def of_classes(self, n: np.ndarray) -> np.ndarray:
        """The sums of discounted counts, by rows of `_classes`."""
        return n[:, :LARGEST] @ (self.d[1:] * np.arange(1, LARGEST + 1)) + n[:, LARGEST]

    def unigram_classes(self, n: np.ndarray) -> np.ndarray:
        return (1 - self.unknown) * self.of_classes(n) / (self.kept or 1)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, (1 - self.unknown) * self.of(counts) / (self.kept or 1), self.unknown)


@dataclass
class Runs:
    """A chunk's different runs of one length. Arrays are by run, those of contexts by the next shorter run."""

    #: Each word of the runs, and the shorter runs without their last and without their first word.
    words: list[np.ndarray]
    context: np.ndarray
    lower: np.ndarray
    #: The run that ends at each place of the texts; -1 where a run would reach beyond the document.
    at: np.ndarray
    #: What the buckets say: counts; each context's counts of counts, and what its seen words have in the shorter model.
    counts: np.ndarray
    sums: np.ndarray
    seen: np.ndarray
    #: Which are in this chunk alone, and which have a private context and aren't sent.
    private: np.ndarray
    own: np.ndarray
    #: The order in which they are sent, where each bucket's begin in it, and which have a hot context.
    order: np.ndarray
    cuts: np.ndarray
    hot: np.ndarray


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = (mixed ^ c) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


class Chunk:
    """A chunk with what the buckets say of its words and, in `runs`, of pairs and longer runs."""

    def __init__(self, row: dict, answers: list[tuple], uni: Discounts, buckets: int) -> None:
        self.lengths, order, self.tokens = (unpacked(row[k]) for k in ("lengths", "words", "tokens"))
        self.held, self.uni, self.buckets = np.array(row["held"], bool), uni, buckets
        self.ids, told = np.zeros(len(order), np.uint64), np.zeros(len(order), np.int64)
        # Buckets are ranges of hashes, so their answers follow one another in the order of the hashes.
        answers = sorted(answers, key=lambda x: x[0])
        self.ids[order], told[order] = (np.concatenate([unpacked(x[k]) for x in answers]) for k in (1, 2))
        self.counts, self.private = told >> 1, (told & 1).astype(bool)
        self.train = np.repeat(~self.held, self.lengths)
        ends = np.cumsum(self.lengths.astype(np.int64))
        self.starts = ends - self.lengths
        self.inside = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)
        # Words in the order of their ids, so that the numbers of runs sort as their words' ids do.
        self.by_id = np.argsort(self.ids)
        self.rank = np.empty(len(order), np.uint64)
        self.rank[self.by_id] = np.arange(len(order), dtype=np.uint64)
        self.runs: list[Runs] = []

    def lengthen(self) -> Runs:
        """Runs of one word more, not told about yet. The first word's context is the end token."""
        last = self.runs[-1] if self.runs else None
        at = last.at if last else self.tokens.astype(np.int64)
        before = np.empty_like(at)
        before[1:] = at[:-1]
        if last:
            before[self.starts] = -1
        else:
            before[self.starts] = at[self.starts[0] + int(self.lengths[0]) - 1]
        there = np.flatnonzero(before >= 0)
        ranks = before[there].astype(np.uint64) if last else self.rank[before[there]]
        keys = ranks * np.uint64(len(self.ids)) + self.rank[self.tokens[there]]
        found, number = numbered_keys(keys)
        here = np.full(len(at), -1, np.int64)
        here[there] = number
        context, word = (x.astype(np.int64) for x in np.divmod(found, np.uint64(len(self.ids))))
        context, word = context if last else self.by_id[context], self.by_id[word]
        lower = np.empty(len(found), np.int64)
        lower[number] = at[there]
        words = [w[context] for w in last.words] if last else [context]
        counts, private = (last.counts, last.private) if last else (self.counts, self.private)
        # What follows a context that training hasn't seen isn't asked for, nor what follows a private one.
        follows = counts[context] > 0
        own = follows & private[context]
        hot = ~own & (counts[context] >= max(2, self.uni.tokens // self.buckets))
        asked = np.flatnonzero(follows & ~own)
        of = _mixed([*(self.ids[w[asked]] for w in words), np.where(hot[asked], self.ids[word[asked]] + np.uint64(1), np.uint64(0))]) % np.uint64(self.buckets)
        order, of = in_order(of)
        order, cuts = asked[order], np.searchsorted(of, np.arange(self.buckets + 1, dtype=np.uint64))
        self.runs.append(Runs([*words, word], context, lower, here, np.zeros(len(found), np.int64), np.zeros((len(counts), LARGEST + 1)), np.zeros(len(counts)), own | private[lower], own, order, cuts, hot))
        return self.runs[-1]

    def trained(self, x: Runs) -> np.ndarray:
        """How often training has each run in this chunk."""
        return np.bincount(x.at[self.train & (x.at >= 0)], minlength=len(x.context))

    def learn(self, answers: list[tuple], sums: list[tuple], hot: dict[tuple, np.ndarray], weight: Callable[[np.ndarray], np.ndarray]) -> None:
        """What the buckets say of the next longer runs, and what the chunk knows of what follows private ones."""
        lower = self.runs[-1].counts if self.runs else self.counts
        x = self.lengthen()
        for b, totals, *_ in answers:
            part = x.order[x.cuts[b] : x.cuts[b + 1]]
            told = unpacked(totals)
            x.counts[part], x.private[part] = told >> 1, told & 1 > 0
        own = np.flatnonzero(x.own)
        x.counts[own] = self.trained(x)[own]
        if not sums and answers:
            return
        for b, code, values, _ in sums:
            found = unpacked(values).reshape(2 * LARGEST + 2, -1).T[unpacked(code)]
            first = x.context[x.order[x.cuts[b] : x.cuts[b + 1]]]
            names = first[np.concatenate([[True], np.diff(first) != 0])]
            x.sums[names], x.seen[names] = found[:, : LARGEST + 1], weight(found[:, LARGEST + 1 :])
        if len(own):
            start = np.flatnonzero(np.concatenate([[True], np.diff(x.context[own]) != 0]))
            names = x.context[own[start]]
            found = _context_sums(start, x.counts[own], lower[x.lower[own]])
            x.sums[names], x.seen[names] = found[:, : LARGEST + 1], weight(found[:, LARGEST + 1 :])
        if hot:
            runs = x.order[x.hot[x.order]]
            for run in runs[np.unique(x.context[runs], return_index=True)[1]]:
                context = x.context[run]
                name = tuple(int(self.ids[w[run]]) for w in x.words[:-1])
                x.sums[context], x.seen[context] = hot[name][: LARGEST + 1], weight(hot[name][None, LARGEST + 1 :])[0]

    def messages(self, chunk: int) -> list[tuple]:
        """Words go as their ids and one more, or as zero in private runs."""
        lower, private = (self.runs[-1].counts, self.runs[-1].private) if self.runs else (self.counts, self.private)
        x = self.lengthen()
        n = self.trained(x)
        ids = self.ids.astype(np.uint32 if int(self.ids.max()) < 2**32 - 1 else np.uint64)
        last = np.where(private[x.lower], 0, ids[x.words[-1]] + ids.dtype.type(1)).astype(ids.dtype)
        out = [(SUMS, chunk, chunk % self.buckets, packed(_sums(n[x.own])), None, None)] if x.own.any() else []
        for b in range(self.buckets):
            part = x.order[x.cuts[b] : x.cuts[b + 1]]
            if len(part):
                first = x.context[part]
                new = np.flatnonzero(np.concatenate([[True], np.diff(first) != 0]))
                names = [ids[w[part[new]]].astype(np.uint64) for w in x.words[:-1]]
                names[0] = np.diff(names[0], prepend=np.uint64(0))  # they ascend
                heads = np.concatenate([*names, np.diff(np.append(new, len(part))).astype(np.uint64), x.hot[part[new]].astype(np.uint64)])
                out.append((ANSWER, chunk, b, packed(heads), packed(last[part]), packed(np.concatenate([n[part], lower[x.lower[part]]]))))
        return out

    def log_probabilities(self, found: list[Discounts]) -> np.ndarray:
        """Of each token, as a logarithm to base 10."""
        shorter = self.uni.unigram(self.counts)
        out = np.log10(shorter)[self.tokens]
        whole = lower = None
        for x, d in zip(self.runs, found, strict=True):
            seen = x.seen if whole is None else x.seen / whole[lower]
            shorter, whole = katz(x, seen, shorter, d)
            lower = x.lower
            there = x.at >= 0
            out[there] = np.log10(shorter)[x.at[there]]
        return out


def katz(x: Runs, seen: np.ndarray, shorter: np.ndarray, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """Each run's probability, and what each context's discounted counts are divided by. seen: what the words that were
    seen after a context have in the shorter model; shorter: probabilities of the runs without their first word."""
    r = np.arange(1, LARGEST + 1)
    size = x.sums[:, :LARGEST] @ r + x.sums[:, LARGEST]
    kept = x.sums[:, :LARGEST] @ (d.d[1:] * r) + x.sums[:, LARGEST]
    whole = np.where(kept < size * (1 - 1e-12), size, size + 1)
    left = np.where(size > 0, (1 - kept / whole) / np.maximum(1 - seen, 1e-300), 1.0)
    return np.where(x.counts > 0, d.of(x.counts) / whole[x.context], left[x.context] * shorter[x.lower]), whole


def _told(tables: list[DataFrame], sums: bool) -> DataFrame:
    """The answers of all tables, with or without the sums of contexts; kind is twice the table's place, and one more for sums."""
    out = None
    for k, t in enumerate(tables):
        part = t.filter(F.col("kind").isin([ANSWER, CONTEXTS] if sums else [ANSWER])).withColumn("kind", F.when(F.col("kind") == ANSWER, 2 * k).otherwise(2 * k + 1))
        out = part if out is None else out.unionByName(part)
    return out


def _chunk(left: pa.Table, right: pa.Table, buckets: int, uni: Discounts, longer: list[Discounts], hot: list[dict]) -> tuple[dict, Chunk]:
    row = left.to_pylist()[0]
    kinds = right.column("kind").to_pylist()
    rows = list(zip(*(right.column(k).to_pylist() for k in ("bucket", "a", "b", "c")), strict=True))
    found = [[x for k, x in zip(kinds, rows, strict=True) if k == level] for level in range(2 * len(longer) + 2)]
    chunk = Chunk(row, found[0], uni, buckets)
    for k, h in enumerate(hot, 1):
        chunk.learn(found[2 * k], found[2 * k + 1], h, _weight(uni, longer[: k - 1]))
    return row, chunk


def _weight(uni: Discounts, longer: list[Discounts]) -> Callable[[np.ndarray], np.ndarray]:
    """What seen words have in the shorter model, from their shorter runs' counts by classes, but for a factor that each
    context has."""
    return longer[-1].of_classes if longer else uni.unigram_classes


def ask_runs(chunked: DataFrame, tables: list[DataFrame], buckets: int, uni: Discounts, longer: list[Discounts], hot: list[dict]) -> DataFrame:
    """A message (chunk, bucket, contexts, words, counts) for each chunk and bucket, of runs of one word more than the
    tables tell about, and the sums of those that aren't sent."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        row, chunk = _chunk(left, right, buckets, uni, longer, hot)
        return _answers(chunk.messages(row["chunk"]))

    return chunked.groupBy("chunk").cogroup(_told(tables, False).groupBy("chunk")).applyInArrow(run, ANSWERS)


def _classes(start: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For stretches of counts: how many are 1 ... LARGEST, and the sum of larger ones."""
    return [*(np.add.reduceat((counts == r).astype(np.int64), start) for r in range(1, LARGEST + 1)), np.add.reduceat(np.where(counts > LARGEST, counts, 0), start)]


def _context_sums(start: np.ndarray, total: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For runs, from where each context's begin: the classes of their counts, and of the shorter runs' counts of those
    that were seen."""
    if not len(start):
        return np.zeros((0, 2 * LARGEST + 2), np.int64)
    return np.stack([*_classes(start, total), *_classes(start, np.where(total > 0, lower, 0))], 1)


class Kinds:
    """Contexts by all their sums. Most are of a few kinds, so an answer has a number for each context and its kinds'
    sums; frequent kinds have small numbers."""

    def __init__(self, sums: np.ndarray) -> None:
        self.sums, kind, size = sums, np.zeros(len(sums), np.uint64), 1
        for c in sums.T:
            most = int(c.max(initial=0)) + 1
            if size * most >= 1 << 40:
                found, place = numbered_keys(kind)
                kind, size = place.astype(np.uint64), len(found)
            kind, size = kind * np.uint64(most) + c.astype(np.uint64), size * most
        kind = numbered_keys(kind)[1]
        often = np.argsort(-np.bincount(kind), kind="stable")
        rank = np.empty(len(often), np.uint64)
        rank[often] = np.arange(len(often), dtype=np.uint64)
        self.kind = rank[kind]
        self.one = np.empty(len(often), np.int64)
        self.one[self.kind] = np.arange(len(kind))

    def answer(self, contexts: np.ndarray) -> tuple[bytes, bytes]:
        found, place = numbered_keys(self.kind[contexts])
        return packed(place.astype(np.uint16 if len(found) < 1 << 16 else np.uint32)), packed(self.sums[self.one[found]].T.reshape(-1))


def answer_runs(asked: DataFrame, words: int, stored: bool = True) -> DataFrame:
    """To each message the runs' total counts, and the sums of its contexts of so many words."""

    def run(rows: pa.Table) -> pa.Table:
        release()
        bucket, kinds = rows.column("bucket")[0].as_py(), rows.column("kind").to_numpy()
        own = sum(unpacked(x) for x in rows.filter(pa.array(kinds == SUMS)).column("a").to_pylist())
        rows = rows.filter(pa.array(kinds == ANSWER))
        if not rows.num_rows:
            return _answers([(SUMS, None, bucket, packed(own), None, None)])
        chunk = rows.column("chunk").to_pylist()
        heads = [unpacked(x).reshape(words + 2, -1) for x in rows.column("a").to_pylist()]
        last = [unpacked(x) for x in rows.column("b").to_pylist()]
        counts = [unpacked(x).reshape(2, -1) for x in rows.column("c").to_pylist()]
        for h in heads:
            h[0] = np.cumsum(h[0])
        names = np.concatenate(heads, axis=1)
        sizes, is_hot = names[words].astype(np.int64), names[words + 1] > 0
        key = names[0]
        for j in range(1, words):
            key = numbered_keys(key)[1].astype(np.uint64) * (names[j].max() + np.uint64(1)) + names[j]
        contexts, number = numbered_keys(key)
        at = np.empty(len(contexts), np.int64)
        at[number] = np.arange(len(number))
        names, is_hot = names[:words, at], is_hot[at]
        n, lower = np.concatenate(counts, axis=1).astype(np.int64)
        word = np.concatenate(last).astype(np.uint64)
        size = word.max() + np.uint64(1)
        order, key = in_order(np.repeat(number, sizes).astype(np.uint64) * size + word)
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (key[1:] % size == 0)  # private ones are each for itself
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        key, lower = key[new], lower[order[new]]
        total = added(place, n, len(key))
        of = (key // size).astype(np.int64)
        sums = _context_sums(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), total, lower)
        told = _marked(total, place, stored)[place]
        ends, runs = np.cumsum([h.shape[1] for h in heads])[:-1], np.cumsum([len(x) for x in last])[:-1]
        out = [(ANSWER, c, bucket, packed(t), None, None) for c, t in zip(chunk, np.split(told, runs), strict=True)]
        kinds = Kinds(sums)
        out += [(CONTEXTS, c, bucket, *kinds.answer(k), None) for c, k in zip(chunk, np.split(number, ends), strict=True)]
        if stored:
            kept = total > 0
            out.append((MODEL, None, bucket, packed(names[:, of[kept]].reshape(-1)), packed(key[kept] % size - np.uint64(1)), packed(total[kept])))
        of_hot = (HOT, None, bucket, packed(names[:, is_hot].reshape(-1)), packed(sums[is_hot].reshape(-1)), None)
        return _answers([*out, (SUMS, None, bucket, packed(_sums(total) + own), None, None), of_hot])

    return asked.groupBy("bucket").applyInArrow(run, ANSWERS)


def _totals(answers: DataFrame) -> np.ndarray:
    """The sums of all buckets."""
    cols = [f"s{i}" for i in range(LARGEST + 4)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpacked(a) for a in batch.column("a").to_pylist()]
            if found:
                yield pa.record_batch([pa.array(x) for x in np.sum(found, axis=0, keepdims=True).T], cols)

    made = answers.filter(F.col("kind") == SUMS).select("a").mapInArrow(rows, ", ".join(f"{c} long" for c in cols)).agg(*(F.sum(c) for c in cols)).first()
    return np.array([x or 0 for x in made], np.int64)


def _hot_contexts(answers: DataFrame, words: int) -> dict[tuple, np.ndarray]:
    """Sums of contexts that are dealt over buckets. There are no more of them than buckets."""
    ids, cols = [f"id{j}" for j in range(words)], [f"s{i}" for i in range(2 * LARGEST + 2)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(k).to_pylist() for k in "ab"), strict=True):
                names = unpacked(a).astype(np.int64).reshape(words, -1)
                sums = unpacked(b).reshape(names.shape[1], 2 * LARGEST + 2)
                yield pa.record_batch([*map(pa.array, names), *(pa.array(x) for x in sums.T)], [*ids, *cols])

    made = answers.filter(F.col("kind") == HOT).select("a", "b").mapInArrow(rows, ", ".join(f"{c} long" for c in [*ids, *cols]))
    return {tuple(r[c] for c in ids): np.array([r[c] for c in cols]) for r in made.groupBy(*ids).agg(*(F.sum(c).alias(c) for c in cols)).collect()}


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Model:
    """Counts in buckets (tables in the shared folder, one for each length of runs) and the discounts that turn them into
    probabilities. An order of 1 has unigrams only. stored: the tables have all runs with their counts, for other uses."""

    def __init__(self, docs: DataFrame, held: Column, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, order: int = ORDER, stored: bool = True) -> None:
        spark = docs.sparkSession
        self.chunks, hashes = self._written(texts_and_hashes(docs, held, chunk_tokens), TEXTS, HASHES)
        tokens = self.chunks.agg(F.sum("n_tokens")).first()[0] or 0
        self.rounds = max(1, min(ROUNDS, tokens // ROUND_TOKENS))
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // bucket_tokens)
        self.tables = [self._table(answer_words(ask_words(hashes, self.buckets), self.buckets, stored))]
        discard(hashes, f"kind={HASHES}")
        self.uni = Discounts(_totals(self.tables[0]))
        self.longer: list[Discounts] = []
        self.hot: list[dict] = []
        for words in range(1, order):
            asked = ask_runs(self.chunks, self.tables, self.buckets, self.uni, self.longer, self.hot)
            self.tables.append(self._table(answer_runs(asked, words, stored)))
            self.longer.append(Discounts(_totals(self.tables[-1])))
            self.hot.append(_hot_contexts(self.tables[-1], words))

    @staticmethod
    def _written(rows: DataFrame, *kinds: int) -> list[DataFrame]:
        """A table in the shared folder by kind of row: all of it, or a table for each of these kinds."""
        spark = rows.sparkSession
        path = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
        free_shuffles(spark)  # the table has all that the shuffles were for
        rows.write.partitionBy("kind").option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        read = spark.read.schema(rows.schema).parquet(path)
        return [read.filter(F.col("kind") == k) for k in kinds] or [read]

    @classmethod
    def _table(cls, answers: DataFrame) -> DataFrame:
        return cls._written(answers)[0]

    def scores(self) -> DataFrame:
        uni, longer, hot, buckets = self.uni, self.longer, self.hot, self.buckets

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            release()
            row, x = _chunk(left, right, buckets, uni, longer, hot)
            base = np.log10((x.counts + 0.5) / (uni.tokens + 0.5 * (uni.kinds + 1)))
            add = lambda v: np.add.reduceat(v, x.starts)
            scores = add(x.log_probabilities(longer))
            made = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(x.lengths.astype(np.int64)), pa.array(add((x.counts[x.tokens] > 0).astype(np.int64))), pa.array(np.full(len(scores), uni.tokens, np.int64)), pa.array(add(base[x.tokens])), pa.array(scores)]
            return pa.table(made, [k.split()[0] for k in SCORED.split(", ")])

        told, out = _told(self.tables, True), None
        for r in range(self.rounds):
            left, right = (t.filter(F.pmod(F.xxhash64("chunk"), F.lit(self.rounds)) == r).groupBy("chunk") for t in (self.chunks, told))
            part = left.cogroup(right).applyInArrow(run, SCORED)
            part = staged(part, "lm-scores") if self.rounds > 1 else part
            out = part if out is None else out.unionByName(part)
        return out


def held_out(fold: int = 5, held: int = 1) -> Column:
    """The fold by the id's digits; a null id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(table(spark, sf_dir, "documents"), held_out(), stored=False).scores()
