"""Near-duplicate passages by compact windows.

A text is a sequence of hashes of five words. For each of HASHES orders of these hashes, every passage of LEAST or
more has one least element; passages with the same one form a compact window (from, centre, to): a node of the
Cartesian tree over the sequence. The nodes that span LEAST or more are found together, as the runs of the places of
sliding minima. Two passages whose similarity is s share the least element in a part s of the orders.

A passage can only agree with another document's if SIMILAR of its hashes occur in other documents at all. So chunks
of documents first ask, by bucket, which of their hashes are shared; only regions in which LEAST or more hashes in a
row are shared to that part have windows. Windows of neighbouring orders are joined where one stretch has both
centres, and documents that share such a pair of centres are candidates. Each is compared with its group's least
document first. Those that have no passage there after that are open, and are compared with all earlier ones of the
group that can have one, until one has it; equal contents are one in that.
Candidates are verified on the passages themselves: all stretches that begin and end with runs that agree, and have a
similarity (of the sets of five words) of SIMILAR or more, the largest first.

Defined results: null or short texts and null ids take no part; rows with one id are one document; repeats within a
document aren't reported; whole copies are passages like others; words are runs of characters other than ASCII white
space, A-Z in lower case; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.base import discard, portions, slices, staged, table
from ledgerloom.llm.chunks import chunks, packed, unpacked

SHINGLE = 5
#: Words of the shortest passage, and its shingles.
WORDS = 50
LEAST = WORDS - SHINGLE + 1
SIMILAR = 0.8
HASHES = 8
#: Words of a chunk and for each bucket, about.
CHUNK_WORDS = 500_000
BUCKET_WORDS = 2_000_000
#: Chunks ask about so many bits of a hash more than number the words: one hash in 4,096 is taken for shared by chance.
MORE_BITS = 12
#: Shingles whose windows are found together, so that the arrays stay in a core's cache.
TOGETHER = 1 << 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = 0x9E3779B97F4A7C15


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each five hashes of words in a row."""
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * _MIX[0] + words[k : k + n]
    return mixed(h, SHINGLE)


def shingles(text: str | None) -> np.ndarray:
    import xxhash

    return shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in (text or "").encode().lower().split()], np.uint64))


def mixed(x: np.ndarray, order: int) -> np.ndarray:
    """A hash of the hash: another order of shingles for each number."""
    x = x + np.uint64(_STEP * (order + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def places_by(values: np.ndarray, bits: int) -> np.ndarray:
    """The places in the order of values of so many bits, of equals the first first. Where the place fits beside the
    value, numbers are sorted and not places, which is several times as fast."""
    room = len(values).bit_length()
    if bits + room > 64:
        return np.argsort(values, kind="stable")
    both = values << np.uint64(room) | np.arange(len(values), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << room) - 1)).astype(np.int64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value (the first of equals) of each stretch of that width.

    The low bits of a value give way to its place; longer sequences are taken in parts that overlap.
    """
    n, part = len(values), 1 << 22
    if n > part:
        return np.concatenate([a + sliding_argmin(values[a : a + part + width - 1], width) for a in range(0, n - width + 1, part)])
    place = np.uint64((1 << 24) - 1)
    v = (values & ~place) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = v
    grid = full.reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(after[: n - width + 1], before[width - 1 : n]) & place).astype(np.int64)


def _nearest_smaller(v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The nearest place before each with a smaller value or another document, -1 for none. All places jump at once:
    what lies between a place and its pointer isn't smaller than it, so a pointer may skip to its target's pointer."""
    v, doc = np.concatenate([[0], v]), np.concatenate([[-1], doc])
    before = np.maximum(np.arange(len(v)) - 1, 0)
    todo = np.arange(1, len(v))
    while len(todo):
        j = before[todo]
        todo = todo[(v[j] >= v[todo]) & (doc[j] == doc[todo])]
        before[todo] = before[before[todo]]
    return before[1:] - 1


def compact_windows(values: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Columns (from, first stretch, last stretch, to, centre) of all windows within documents.

    doc: the number of each value's document, ascending. Nodes of the Cartesian tree that span `least` are the least
    elements of a stretch of that length; those stretches are a run. The nearest smaller elements on both sides, which
    bound a node, are such nodes too.
    """
    none = np.zeros((5, 0), np.int64)
    if len(values) < least:
        return none
    at = sliding_argmin(values, least)
    start = np.flatnonzero(doc[: len(at)] == doc[least - 1 :])
    at = at[start]
    if not len(at):
        return none
    new = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0]))
    c, last = at[new], start[np.append(new[1:], len(at)) - 1]
    own = doc[c]
    order = np.empty(len(c), np.int64)
    order[places_by(values[c] >> np.uint64(24), 40)] = np.arange(len(c))  # ties: the first is the smaller
    starts, ends = np.searchsorted(doc, own), np.searchsorted(doc, own, "right") - 1
    left = _nearest_smaller(order, own)
    right = len(c) - 1 - _nearest_smaller(order[::-1], own[::-1])[::-1]
    low = np.where((left >= 0) & (own[left] == own), c[left] + 1, starts)
    at_end = np.minimum(right, len(c) - 1)
    high = np.where((right < len(c)) & (own[at_end] == own), c[at_end] - 1, ends)
    return np.stack([low, start[new], last, high, c])


class Shingled:
    """A chunk's shingles: their values, document (by its place in the chunk) and place; short documents and those
    without an id are left out."""

    def __init__(self, row: dict, bits: int) -> None:
        self.bits = bits
        lengths, words, tokens = (unpacked(row[k]) for k in ("lengths", "words", "tokens"))
        ends = np.cumsum(lengths.astype(np.int64)) - 1  # the end token isn't a word
        starts = ends + 1 - lengths
        count = ends - starts - SHINGLE + 1
        good = (count >= LEAST) & np.array([d is not None for d in row["doc_ids"]], bool)
        n = count[good]
        self.doc = np.repeat(np.flatnonzero(good), n)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        self.values = shingle_hashes(words[tokens])[starts[self.doc] + self.place] if len(self.doc) else np.zeros(0, np.uint64)
        self.ids = np.array([0 if d is None else d for d in row["doc_ids"]], np.int64)
        key = self.values >> np.uint64(64 - bits)
        self.order = places_by(key, bits)
        key = key[self.order]
        self.new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(self.new)
        self.keys = key[first]
        id_of = self.ids[self.doc[self.order]]
        self.several = np.maximum.reduceat(id_of, first) != np.minimum.reduceat(id_of, first) if len(first) else np.zeros(0, bool)

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket's keys begin; a bucket is a range of keys."""
        edges = [-(-(b << self.bits) // buckets) for b in range(buckets)]
        return np.append(np.searchsorted(self.keys, np.array(edges, np.uint64)), len(self.keys))


SENT = "bucket int, chunk long, keys binary, several binary"
TOLD = "chunk long, bucket int, shared binary"


def ask(chunked: DataFrame, buckets: int, bits: int) -> DataFrame:
    """A message for each chunk and bucket: the different keys, as differences, and which the chunk has in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = Shingled(row, bits)
                cuts = x.cuts(buckets)
                parts = [(b, slice(cuts[b], cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
                keys, several = ([f(p) for _, p in parts] for f in (lambda p: packed(np.diff(x.keys[p], prepend=np.uint64(0))), lambda p: packed(np.packbits(x.several[p]))))
                yield pa.record_batch([pa.array([b for b, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array(keys, pa.binary()), pa.array(several, pa.binary())], ["bucket", "chunk", "keys", "several"])

    return chunked.mapInArrow(run, SENT)


def answer(asked: DataFrame) -> DataFrame:
    """To each message, which of its keys occur in several documents: a bit for each."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x)) for x in rows.column("keys").to_pylist()]
        several = [np.unpackbits(unpacked(x), count=len(k)).astype(bool) for x, k in zip(rows.column("several").to_pylist(), keys, strict=True)]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every = every[order]
        same = every[1:] == every[:-1]
        shared = np.concatenate(several)[order]
        shared[1:] |= same
        shared[:-1] |= same
        if len(every):  # several documents of one chunk
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            shared = np.repeat(np.logical_or.reduceat(shared, first), np.diff(np.append(first, len(every))))
        told = np.empty(len(every), bool)
        told[order] = shared
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table([rows.column("chunk"), rows.column("bucket"), pa.array([packed(np.packbits(t)) for t in np.split(told, ends)], pa.binary())], ["chunk", "bucket", "shared"])

    return asked.groupBy("bucket").applyInArrow(run, TOLD)


def dense_regions(weight: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each place is in a stretch of LEAST or more of its document whose weights add up to zero or more."""
    n = len(weight)
    # A row of sums for each document, one longer than it is.
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(first, n))
    number = np.repeat(np.arange(len(first)), size + 1)
    begin = np.cumsum(size + 1) - size - 1
    total = np.zeros(len(number), np.int64)
    put = np.arange(n) + np.repeat(np.arange(len(first)), size) + 1
    total[put] = weight
    total = np.cumsum(total)
    total -= np.repeat(total[begin], size + 1)
    wide = np.int64(1) << 40
    # The least sum of the document so far, turned round: it never falls, and each document's lies above the last one's.
    ladder = -np.minimum.accumulate(total - number * wide)
    left, at = np.searchsorted(ladder, number * wide - total), np.arange(len(total))
    good = left <= at - LEAST
    edge = np.bincount(left[good], minlength=len(total) + 1) - np.bincount(at[good], minlength=len(total) + 1)
    return (np.cumsum(edge)[:-1] > 0)[put - 1]


def span_of(a, b):
    """An interval in one number."""
    return a << 32 | b


def joined_windows(values: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key of two centres, part, from, to, first, last) of the windows of neighbouring orders that meet, by parts: the
    common interval, and the run of stretches (first to last) that have both centres. Places count over all parts.

    Two windows meet if one stretch of LEAST has both centres as its least elements, so there are only as many pairs
    as runs of stretches; a passage that agrees has stretches that do.
    """
    found = []
    for order in range(HASHES):
        m = mixed(values, order)
        a, first, last, b, c = compact_windows(m, part)
        found.append((m[c], a, first, last, b))
    out = []
    for k in range(HASHES):
        x, y = found[k], found[(k + 1) % HASHES]
        # Runs of stretches come in their order and don't overlap, so each run's begin falls into one run at most.
        at = [np.searchsorted(v[2], u[2], "right") - 1 for u, v in ((x, y), (y, x))]
        into = [(w >= 0) & (v[3][np.maximum(w, 0)] >= u[2]) if len(v[2]) else np.zeros(len(w), bool) for w, u, v in ((at[0], x, y), (at[1], y, x))]
        i, j = np.flatnonzero(into[0]), at[0][into[0]]
        j2, i2 = np.flatnonzero(into[1]), at[1][into[1]]
        new = x[2][i2] < y[2][j2]  # those that begin together have been found
        i, j = np.concatenate([i, i2[new]]), np.concatenate([j, j2[new]])
        key = mixed(x[0][i] ^ (y[0][j] << np.uint64(1) | y[0][j] >> np.uint64(63)), 77 + k)
        first = np.maximum(x[2][i], y[2][j])
        out.append((key, part[first], np.maximum(x[1][i], y[1][j]), np.minimum(x[4][i], y[4][j]), first, np.minimum(x[3][i], y[3][j])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def one_for_each_key(key: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same windows, but those of one key and part that overlap are one. Texts that repeat themselves have very
    many such windows, one within the other."""
    rank = np.lexsort((low, part, key))
    key, part, low, high, first, last = (v[rank] for v in (key, part, low, high, first, last))
    group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(part) != 0)]))
    wide = np.int64(1) << 33
    reach = np.maximum.accumulate(group * wide + high)
    new = np.flatnonzero(np.concatenate([[True], group[1:] * wide + low[1:] > reach[:-1]]))
    return key[new], part[new], low[new], np.maximum.reduceat(high, new), np.minimum.reduceat(first, new), np.maximum.reduceat(last, new)


REGIONS = "doc long, key long, span long, run long, begin int, values binary"


def windows_and_regions(chunked: DataFrame, told: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Rows (doc, key, span, run) of windows, and rows (doc, begin, values) of the regions that they are in."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in REGIONS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        x = Shingled(left.to_pylist()[0], bits)
        cuts = x.cuts(buckets)
        shared = np.zeros(len(x.keys), bool)
        for b, flags in zip(right.column("bucket").to_pylist(), right.column("shared").to_pylist(), strict=True):
            shared[cuts[b] : cuts[b + 1]] = np.unpackbits(unpacked(flags), count=cuts[b + 1] - cuts[b])
        if not shared.any():
            return pa.table([pa.nulls(0, t) for t in kinds], names)
        weight = np.empty(len(x.values), np.int64)
        again = ~x.new
        again[1:] &= x.doc[x.order[1:]] == x.doc[x.order[:-1]]
        # A similarity is one of sets: what a document repeats and nobody else has counts once.
        weight[x.order] = np.where(shared[np.cumsum(x.new) - 1], 1, np.where(again, 0, -round(SIMILAR / (1 - SIMILAR))))
        at = np.flatnonzero(dense_regions(weight, x.doc))
        if not len(at):
            return pa.table([pa.nulls(0, t) for t in kinds], names)
        values, doc, place = x.values[at], x.doc[at], x.place[at]
        part = np.cumsum(np.concatenate([[False], (np.diff(doc) != 0) | (np.diff(place) != 1)]))
        begins = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
        edges = sorted({0, len(values), *begins[np.searchsorted(begins, np.arange(TOGETHER, len(values), TOGETHER), "right") - 1].tolist()})
        found = [one_for_each_key(*joined_windows(values[a:b], part[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
        shift = np.repeat(edges[:-1], [len(f[0]) for f in found])
        key, of, *spots = (np.concatenate(c) for c in zip(*found, strict=True))
        low, high, first, last = (place[s + shift] for s in spots)
        n, r = len(key), len(begins)
        data = [values[a:b].astype("<u4").tobytes() for a, b in zip(begins, np.append(begins[1:], len(values)), strict=True)]  # 32 bits tell the shingles of two documents apart
        both = lambda w, none: pa.concat_arrays([pa.array(w), pa.nulls(none, pa.int64())])
        pa.default_memory_pool().release_unused()  # of the chunk before
        return pa.table(
            [pa.array(np.concatenate([x.ids[doc[begins[of]]], x.ids[doc[begins]]])), both(key.view(np.int64), r), both(span_of(low, high), r), both(span_of(first, last), r),
             pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(place[begins].astype(np.int32))]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(data, pa.binary())])],
            names,
        )

    return chunked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, REGIONS)


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (from, to), both included, of intervals that overlap or touch as one."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1] + 1]))
    return np.stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]], 1)


def _spans(column: pa.ListArray) -> list[np.ndarray]:
    """Merged intervals of each row of packed ones."""
    flat, cuts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    both = np.stack([flat >> 32, flat & 0xFFFFFFFF], 1)
    return [merged(both[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places by value, the values in that order, and for each place the one before it with its value, -1 for none."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1])
    before = np.full(len(x), -1)
    before[order[again + 1]] = order[again]
    return order, ranked, before


def fewest_kinds(before: np.ndarray, size: np.ndarray, least: int = LEAST) -> np.ndarray:
    """How many different shingles each part has in any stretch of `least` at least; if it is shorter, more than can be.

    before: the place before each that has its shingle in the same part, -1 for none; parts of these sizes are in a row.
    """
    at = np.cumsum(size) - size
    place, begin, end = np.arange(len(before)), np.repeat(at, size), np.repeat(at + size, size)
    # A place is the first of its shingle in the stretches that begin from here to it.
    first = np.maximum(np.maximum(before + 1, place - least + 1), begin)
    kinds = np.cumsum(np.bincount(first, minlength=len(before))) - place
    kinds[place > end - least] = 1 << 40
    return np.minimum.reduceat(kinds, at)


def _places(x: np.ndarray, y: np.ndarray, order: np.ndarray, ranked: np.ndarray, low: np.ndarray, there: np.ndarray, once: bool) -> np.ndarray:
    """A place in y (ranked = y[order], ascending) for each shingle of x (there: it is at ranked[low]), -1 for none. Of
    several (none if each is in y once), the one that goes on from a neighbour's, or else the first of those that agree
    furthest, up to LEAST."""
    place = np.where(there, order[low], -1)
    if once:
        return place
    high = np.searchsorted(ranked, x, "right")
    several = np.flatnonzero(there & (high > low + 1))
    if not len(several):
        return place
    place[several] = -2
    spots, near, n, m = several.tolist(), place.tolist(), len(x), len(y)
    for k in reversed(spots):
        if k + 1 < n and near[k + 1] > 0 and y[near[k + 1] - 1] == x[k]:
            near[k] = near[k + 1] - 1
    for k in spots:
        if near[k] == -2:
            last = near[k - 1] if k else -1
            if 0 <= last < m - 1 and y[last + 1] == x[k]:
                near[k] = last + 1
                continue
            found = order[low[k] : high[k]]
            for step in range(1, min(LEAST, n - k)):
                on = found[found + step < m]
                on = on[y[on + step] == x[k + step]]
                if not len(on):
                    break
                found = on
            near[k] = int(found[0])
    return np.array(near, np.int64)


def agreeing(x: np.ndarray, y: np.ndarray, least: int = LEAST, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """(from, to, from, to, similarity) of passages of x and y, ends excluded, that agree: the largest first, then those
    beside it. Passages begin and end with runs that both have; one shorter than `least` is filled up to it.

    All stretches of runs are tried whose part of agreeing shingles allows the similarity. A run is left out of those
    whose place in y is far from the first run's; far is a quarter of the stretch, or all of it for what was moved.
    """
    if min(len(x), len(y)) < least:
        return []
    if len(x) == len(y) and np.array_equal(x, y):
        return [(0, len(x), 0, len(y), 1.0)]
    order, ranked, before_y = _order(y)
    low = np.minimum(np.searchsorted(ranked, x), len(y) - 1)
    there = ranked[low] == x
    if np.count_nonzero(there) < similar * least:
        return []
    before_x, once = _order(x)[2], (before_y < 0).all()
    plain = bool(once and (before_x < 0).all())
    if not plain:  # two passages have at least so many shingles, and no more in common than x and y
        kinds = sum(int(fewest_kinds(b, np.array([len(b)]), least)[0]) for b in (before_x, before_y))
        if (1 + similar) * np.count_nonzero(there & (before_x < 0)) < similar * kinds - 1e-6:
            return []
    place = _places(x, y, order, ranked, low, there, once)
    hit = np.flatnonzero(there)
    on = place[hit]
    new = np.concatenate([[0], np.flatnonzero((hit[1:] != hit[:-1] + 1) | (on[1:] != on[:-1] + 1)) + 1])
    total = np.append(new, len(hit))
    begin, size = hit[new], total[1:] - total[:-1]
    cost = similar / (1 - similar)
    gain = (1 + cost) * total[1:] - cost * (begin + size)
    reach, level = np.maximum.accumulate(gain[::-1])[::-1].tolist(), ((1 + cost) * total[:-1] - cost * begin - 1e-6).tolist()
    #: Distinct shingles before each place.
    of_x, of_y = [range(len(b) + 1) if plain else [0, *np.cumsum(b < 0).tolist()] for b in (before_x, before_y)]
    if not plain:  # the same number for the same shingle, in x the last one for those that y hasn't
        number = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
        of = np.empty(len(y), np.int64)
        of[order] = number
        in_y, mine = np.zeros(number[-1] + 2, bool), np.where(there, number[low], number[-1] + 1)
    starts, ends, lows, highs = begin.tolist(), (begin + size).tolist(), place[begin].tolist(), (place[begin] + size).tolist()
    sizes, before = size.tolist(), total.tolist()

    def filled(a: int, b: int, n: int) -> tuple[int, int]:
        a = max(0, min(a, n - least))
        return a, max(b, a + least)

    def tried(f: int, g: int, every: bool) -> list[tuple[int, int, int, int, int]]:
        """(agreeing, first run, last run, from, to) of stretches of runs that may be similar; only growing ones, or all."""
        out, best = [], 0
        for u in range(f, g):
            if before[g] - before[u] <= (0 if every else best) or before[g] - before[u] < similar * least:
                break
            for far in (0.25, 1.0):
                both, low, high = 0, lows[u], highs[u]
                for v in range(u, g):
                    if reach[v] < level[u]:
                        break
                    if abs(lows[v] - starts[v] - lows[u] + starts[u]) > max(12, far * (ends[v] - starts[u])):
                        continue
                    both += sizes[v]
                    low, high = min(low, lows[v]), max(high, highs[v])
                    if both <= best and not every:
                        continue
                    left, right = (max(both, k) for k in (of_x[ends[v]] - of_x[starts[u]], of_y[high] - of_y[low]))
                    left, right = left + max(0, least - ends[v] + starts[u]), right + max(0, least - high + low)
                    if both >= similar * (left + right - both):
                        best = max(best, both)
                        out.append((both, u, v, low, high))
                if u + 1 == g:
                    break
        return out

    out, todo = [], [(0, len(starts))]
    while todo:
        f, g = todo.pop()
        if before[g] - before[f] < similar * least:
            continue
        for every in (False, True):
            found = sorted(tried(f, g, every), reverse=True)
            for _, u, v, low, high in found:
                (i, j), (p, q) = filled(starts[u], ends[v], len(x)), filled(low, high, len(y))
                if plain:
                    left, right, both = j - i, q - p, int(np.count_nonzero((place[i:j] >= p) & (place[i:j] < q)))
                else:
                    first = before_x[i:j] < i
                    left, right = int(np.count_nonzero(first)), int(np.count_nonzero(before_y[p:q] < p))
                    in_y[of[p:q]] = True
                    both = int(np.count_nonzero(in_y[mine[i:j]] & first))
                    in_y[:] = False
                s = both / (left + right - both)
                if s >= similar:
                    out.append((i, j, p, q, s))
                    todo += [(f, u), (v + 1, g)]
                    break
            else:
                if found:
                    continue
            break
    return sorted(out)


def groups_of(windows: DataFrame) -> DataFrame:
    """(key, doc, span, n): the least document of each key that several windows have, and how many have it."""
    return windows.groupBy("key").agg(F.min(F.struct("doc", "span")).alias("_f"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("_f.doc").alias("other"), F.col("_f.span").alias("theirs"), "n")


def candidates(beside: DataFrame) -> DataFrame:
    """(doc, other, own, theirs): documents beside their groups' least ones, with intervals of both."""
    return beside.groupBy("doc", "other").agg(F.collect_set("span").alias("own"), F.collect_set("theirs").alias("theirs"))


FOUND = "doc_id long, start_word int, end_word int, source_doc_id long, source_start int, source_end int, similarity double"


def within(begin: int, end: int, regions: list[dict]) -> np.ndarray | None:
    """The shingles from begin to end, both included, of the region that has them."""
    for r in regions:
        if r["begin"] <= begin and end < r["begin"] + len(r["values"]) // 4:
            return np.frombuffer(r["values"], "<u4")[begin - r["begin"] : end + 1 - r["begin"]]
    return None  # rows with one id may have other texts


def verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Passages of each pair of documents that agree."""

    def cut(spans: np.ndarray, regions: list[dict]) -> list[tuple[int, np.ndarray]]:
        """(begin, shingles) of each interval."""
        found = [(a, within(a, b, regions)) for a, b in spans.tolist()]
        return [(a, v) for a, v in found if v is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = []
            columns = [_spans(batch.column(k)) for k in ("own", "theirs")] + [batch.column(k).to_pylist() for k in ("doc", "other", "regions", "regions2")]
            for own, theirs, doc, other, regions, regions2 in zip(*columns, strict=True):
                right = cut(theirs, regions2)
                y = np.concatenate([v for _, v in right]) if right else np.zeros(0, np.uint32)
                spot = np.concatenate([s + np.arange(len(v)) for s, v in right]) if right else np.zeros(0, np.int64)
                for start, x in cut(own, regions):
                    for i, j, p, q, s in agreeing(x, y):
                        rows.append((doc, start + i, start + j - 1 + SHINGLE, other, int(spot[p]), int(spot[q - 1]) + SHINGLE, s))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    theirs = parts.select(F.col("doc").alias("other"), F.col("regions").alias("regions2"))
    return pairs.join(parts, "doc").join(theirs, "other").mapInArrow(run, FOUND)


MEMBERS = "bucket int, keys binary, docs binary, begins binary, runs binary, sizes binary, values binary"


def open_groups(grouped: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, keys, spans, runs) of the groups that have open members: those with no found passage around a stretch of
    their run. Each group's members up to the last open one; a run of -1 stands for one that isn't open."""
    covered = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.expr(f"cast(start_word as long) << 32 | (end_word - {SHINGLE})")).alias("covered"))
    is_open = f"not coalesce(exists(covered, c -> greatest(run >> 32, c >> 32) + {LEAST - 1} <= least((run & 4294967295) + {LEAST - 1}, c & 4294967295)), false)"
    # A group of two windows has been compared.
    last = grouped.filter("n > 2 and doc > other").select("key", "doc", "run").join(covered, "doc", "left").filter(is_open).groupBy("key").agg(F.max("doc").alias("last"))
    members = grouped.filter("n > 2").select("key", "doc", "span", "run").join(last, "key").filter("doc <= last").groupBy("doc").agg(F.collect_list("key").alias("keys"), F.collect_list("span").alias("spans"), F.collect_list("run").alias("runs"))
    members = members.join(covered, "doc", "left").withColumn("runs", F.expr(f"transform(runs, run -> if({is_open}, run, -1L))"))
    return members.drop("covered")


def messages(parts: DataFrame, members: DataFrame, buckets: int) -> DataFrame:
    """The groups by bucket. For each member: key, document, begin of the interval, run, and the interval's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 4 << 20):
            rows: list[list] = [[] for _ in range(6)]
            for doc, regions, *lists in zip(*(batch.column(k).to_pylist() for k in ("doc", "regions", "keys", "spans", "runs")), strict=True):
                for key, span, stretches in zip(*lists, strict=True):
                    low = span >> 32
                    part = within(low, span & 0xFFFFFFFF, regions)
                    if part is not None:
                        for col, v in zip(rows, (key, doc, low, stretches, len(part), part), strict=True):
                            col.append(v)
            key = np.array(rows[0], np.int64)
            of = key % buckets
            cols: list[list] = [[] for _ in range(7)]
            for b in np.unique(of).tolist():
                pick = np.flatnonzero(of == b)
                numbers = [packed(np.array(c, np.int64)[pick]) for c in rows[:5]]
                for col, v in zip(cols, (b, *numbers, np.concatenate([rows[5][k] for k in pick.tolist()]).tobytes()), strict=True):
                    col.append(v)
            yield pa.record_batch([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(cols)], [x.split()[0] for x in MEMBERS.split(", ")])

    return parts.join(members, "doc").mapInArrow(run, MEMBERS)


def possible(place: np.ndarray, plain: np.ndarray, first: int, last: int) -> np.ndarray:
    """Which rows may have a similar passage around a stretch that begins from first to last. place: for each other
    interval the places of the shingles in it, -1 for none.

    Such a passage has SIMILAR of its shingles in the other. Where the places rise and no shingle is repeated (plain),
    those of the other between them that aren't shared count against it too. A passage of less than LEAST is filled up.
    """
    rows, size = place.shape
    least, cost = int(np.ceil(SIMILAR * LEAST)), SIMILAR / (1 - SIMILAR)
    ends = np.arange(min(size, max(0, first) + least - 1), size)
    begins = np.minimum(ends - least + 1, last + LEAST - least)
    if not len(ends) or begins[-1] < 0:
        return np.zeros(rows, bool)
    ends, begins = ends[begins >= 0], begins[begins >= 0]
    has, at = place >= 0, np.arange(size, dtype=np.int32)
    before = np.full((rows, size), -1, np.int32)
    before[:, 1:] = np.maximum.accumulate(np.where(has, at, -1), axis=1)[:, :-1]
    step = place - np.take_along_axis(place, np.maximum(before, 0), 1) - 1
    begun = has & (before >= 0)
    rising = ((step >= 0) | ~begun).all(axis=1) & plain
    # Of the other's own shingles only the one-sided part counts where the places don't rise.
    gain = has - cost * np.where(begun, at - before - 1 + np.where(rising[:, None], step, 0), 0)
    total = np.cumsum(gain, axis=1)
    lowest = np.minimum.accumulate(np.where(has, total, np.inf), axis=1)
    return (has[:, ends] & (total[:, ends] - lowest[:, begins] + 1 >= -1e-6)).any(axis=1)


def settled(doc: np.ndarray, begin: np.ndarray, stretches: np.ndarray, parts: list[np.ndarray], group: np.ndarray | None = None) -> list[tuple]:
    """Passages of groups' open members: each is compared with all of its group before it, those with most in common
    first, until one has a stretch of its run. Members come sorted by group and document. Those with the same interval
    are one: the later ones have all of the first's."""
    group = np.zeros(len(doc), np.int64) if group is None else group
    out, firsts, seen = [], [], {}
    for k, (p, g) in enumerate(zip(parts, group.tolist(), strict=True)):
        o = seen.setdefault((g, p.tobytes()), k)
        if o == k:
            firsts.append(k)
        elif stretches[k] >= 0 and doc[o] < doc[k]:
            out.append((int(doc[k]), int(begin[k]), int(begin[k]) + len(p) - 1 + SHINGLE, int(doc[o]), int(begin[o]), int(begin[o]) + len(p) - 1 + SHINGLE, 1.0))
    doc, begin, stretches, group, parts = doc[firsts], begin[firsts], stretches[firsts], group[firsts], [parts[k] for k in firsts]
    size = np.array([len(p) for p in parts])
    at = np.cumsum(size) - size
    # A kind is a shingle in a group; pairs are kinds by member, each with the first place there.
    whose = np.repeat(np.arange(len(parts)), size)
    value = (group - group[0])[whose].astype(np.uint64) << np.uint64(32) | np.concatenate(parts)
    order = places_by(value, 32 + int(group[-1] - group[0]).bit_length())
    value, by = value[order], whose[order]
    new_kind = np.concatenate([[True], value[1:] != value[:-1]])
    new = new_kind | np.concatenate([[True], by[1:] != by[:-1]])
    earlier, number, first = np.full(len(order), -1), np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    again = np.flatnonzero(~new)
    earlier[order[again]] = order[again - 1]
    number[order] = np.cumsum(new) - 1  # of the place's pair
    cuts = np.flatnonzero(new_kind[new])
    first[order] = cuts[np.cumsum(new_kind) - 1]  # the first pair of its kind
    member, spot_of = by[new], (order[new] - at[by[new]]).astype(np.int32)
    plain, fewest = np.bincount(member, minlength=len(parts)) == size, fewest_kinds(earlier, size)
    # The members from head to before are a member's earlier ones.
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    heads = np.maximum.accumulate(np.where(fresh, np.arange(len(parts)), 0))
    befores = np.maximum.accumulate(np.where(fresh | np.concatenate([[True], doc[1:] != doc[:-1]]), np.arange(len(parts)), 0))
    todo = np.flatnonzero((stretches >= 0) & (befores > heads))
    work = np.cumsum(np.add.reduceat(number - first, at)[todo] + befores[todo] - heads[todo])
    while len(todo):
        count = max(1, int(np.searchsorted(work, 1 << 20, "right")))
        these, todo, work = todo[:count], todo[count:], work[count:] - work[count - 1]
        # Entries: a place of a member and an earlier member's pair of its kind.
        row = np.repeat(np.arange(count), size[these])
        spot = np.arange(len(row)) - np.repeat(np.cumsum(size[these]) - size[these], size[these])
        place = at[these][row] + spot
        n = number[place] - first[place]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[place], n)
        row, spot, once, has = np.repeat(row, n), np.repeat(spot, n), np.repeat(earlier[place] < 0, n), member[entry]
        keep = has < befores[these][row]
        row, spot, once, has, entry = row[keep], spot[keep], once[keep], has[keep], entry[keep]
        wide = befores[these] - heads[these]
        edges = np.concatenate([[0], np.cumsum(wide)])
        cell = (edges[:-1] - heads[these])[row] + has
        same, kinds = np.bincount(cell, minlength=edges[-1]), np.bincount(cell[once], minlength=edges[-1])
        other = np.arange(edges[-1]) + np.repeat(heads[these] - edges[:-1], wide)
        # Passages of both have these many shingles at least, and no more in common than both members.
        fit = np.flatnonzero((same >= SIMILAR * LEAST) & ((1 + SIMILAR) * kinds >= SIMILAR * (np.repeat(fewest[these], wide) + fewest[other]) - 1e-6))
        fits, entries = np.searchsorted(fit, edges), np.searchsorted(row, np.arange(count + 1))
        for r in np.flatnonzero(fits[1:] > fits[:-1]).tolist():
            k, head = int(these[r]), int(heads[these[r]])
            likely = fit[fits[r] : fits[r + 1]]
            likely = other[likely[np.argsort(-same[likely], kind="stable")]]
            own = slice(entries[r], entries[r + 1])
            low, high = (int(v) - int(begin[k]) for v in (stretches[k] >> 32, stretches[k] & 0xFFFFFFFF))
            done, a = False, 0
            while a < len(likely) and not done:
                block = likely[a : a + (8 if not a else max(1, (1 << 20) // int(size[k])))]
                a += len(block)
                line = np.full(wide[r], -1)
                line[block - head] = np.arange(len(block))
                line = line[has[own] - head]
                mine = np.flatnonzero(line >= 0)
                places = np.full((len(block), int(size[k])), -1, np.int32)
                places[line[mine], spot[own][mine]] = spot_of[entry[own][mine]]
                for o in block[possible(places, plain[block] & plain[k], low, high)].tolist():
                    for i, j, p, q, s in agreeing(parts[k], parts[o]):
                        out.append((int(doc[k]), int(begin[k]) + i, int(begin[k]) + j - 1 + SHINGLE, int(doc[o]), int(begin[o]) + p, int(begin[o]) + q - 1 + SHINGLE, s))
                        done |= max(low, i) <= min(high, j - LEAST)
                    if done:
                        break
    return out


def settled_passages(members: DataFrame) -> DataFrame:
    """Passages of open members, whichever of the earlier members of their groups has them."""

    def run(rows: pa.Table) -> pa.Table:
        key, doc, begin, stretches, size = (np.concatenate([unpacked(x) for x in rows.column(k).to_pylist()]) for k in ("keys", "docs", "begins", "runs", "sizes"))
        values = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("values").to_pylist()])
        at = np.cumsum(size) - size
        rank = np.lexsort((begin, doc, key))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(key[rank]) != 0]))
        group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(rank))))
        is_open = np.maximum.reduceat(stretches[rank], edges)[group] >= 0
        rank, group = rank[is_open], group[is_open]
        # Groups together, of about so many shingles; a larger one is alone.
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(rank) else np.zeros(0, np.int64)
        through, a = np.cumsum(size[rank]), 0
        found: set[tuple] = set()
        while a < len(rank):
            done = through[a - 1] if a else 0
            b = int(edges[max(np.searchsorted(edges, a) + 1, np.searchsorted(edges, np.searchsorted(through, done + TOGETHER, "right"), "right") - 1)])
            pick = rank[a:b]
            found.update(settled(doc[pick], begin[pick], stretches[pick], [values[at[k] : at[k] + size[k]] for k in pick.tolist()], group[a:b]))
            a = b
        pa.default_memory_pool().release_unused()  # of the bucket before
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        cols = list(zip(*found, strict=True)) or [()] * 7
        return pa.table([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return members.groupBy("bucket").applyInArrow(run, FOUND)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """A row for each passage of a document that an earlier one (by doc_id) has too, by words; ends are excluded."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    chunked = staged(chunks(given, F.lit(False), CHUNK_WORDS), "passage-chunks").select("chunk", "n_tokens", "doc_ids", "lengths", "words", "tokens")
    words = chunked.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // BUCKET_WORDS)
    bits = min(64, max(16, words.bit_length() + MORE_BITS))
    told = staged(answer(ask(chunked, buckets, bits)), "shared")
    made = staged(windows_and_regions(chunked, told, buckets, bits), "windows")
    discard(chunked)
    windows = made.filter("key is not null").select("doc", "key", "span", "run")
    parts = made.filter("values is not null").groupBy("doc").agg(F.collect_list(F.struct("begin", "values")).alias("regions"))
    # Least documents' windows too, where the last step may need them.
    grouped = staged(windows.join(groups_of(windows), "key").filter("doc > other or n > 2"), "grouped")
    found = staged(verified(staged(candidates(grouped.filter("doc > other")), "candidates"), parts), "passages")
    members = staged(open_groups(grouped, found), "members")
    discard(grouped)
    settled_ones = staged(settled_passages(messages(parts, members, buckets)), "settled")
    discard(made)
    discard(members)
    return found.unionByName(settled_ones)


def merged_passages(found: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, source_doc_id, n_sources, similarity): overlapping passages as one."""

    w = "partition by doc_id order by start_word, end_word, source_doc_id rows between unbounded preceding and 1 preceding"
    marked = found.withColumn("_new", F.expr(f"case when start_word <= max(end_word) over ({w}) then 0 else 1 end"))
    numbered = marked.withColumn("_span", F.expr("sum(_new) over (partition by doc_id order by start_word, end_word, source_doc_id rows unbounded preceding)"))
    return numbered.groupBy("doc_id", "_span").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("source_doc_id").alias("source_doc_id"), F.countDistinct("source_doc_id").alias("n_sources"), F.max("similarity").alias("similarity")
    ).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source_doc_id", "n_sources", "similarity")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these words and the white space after each span."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in merged(np.array(spans, np.int64).reshape(-1, 2) - [0, 1]).tolist():
        if a < len(words):
            out.append(text[at : words[a][0]])
            at = words[b + 1][0] if b + 1 < len(words) else len(text)
    return ("".join(out) + text[at:]).strip() if spans else text


def _with_own_ids(docs: DataFrame) -> DataFrame:
    """Adds _ledgerloom_id: the doc_id, but for rows that share theirs with another text a number from their id and text, beyond
    all ids under 2 ** 62. So these come last, each text as a document of its own."""
    told = docs.withColumn("_ledgerloom_id", F.col("doc_id").cast("long"))
    h = F.xxhash64("_ledgerloom_id", "text")
    shared = told.filter("_ledgerloom_id is not null and text is not null").groupBy("_ledgerloom_id").agg(F.min(h).alias("_a"), F.max(h).alias("_b")).filter("_a <> _b").select("_ledgerloom_id", F.lit(True).alias("_shared"))
    if shared.isEmpty():
        return told
    apart = F.shiftleft(F.lit(1).cast("long"), 62) + F.shiftrightunsigned(h, 2)
    return told.join(shared, "_ledgerloom_id", "left").withColumn("_ledgerloom_id", F.when(F.col("_shared"), apart).otherwise(F.col("_ledgerloom_id"))).drop("_shared")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without the passages that an earlier document has; rows of which nothing is left go. Rows with one id and
    different texts are documents of their own."""
    told = _with_own_ids(docs)
    found = repeated_passages(told.select(F.col("_ledgerloom_id").alias("doc_id"), "text"))
    spans = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
    names = docs.columns
    joined = told.join(spans, F.col("_ledgerloom_id") == F.col("_doc"), "left").drop("_doc", "_ledgerloom_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans = batch.column("_spans").to_pylist()
            texts = batch.column("text").to_pylist()
            cut = [t if not s or t is None else without_spans(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
            keep = pa.array([not s or bool(c) for c, s in zip(cut, spans, strict=True)])
            made = [pa.array(cut, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names]
            yield pa.record_batch(made, names).filter(keep)

    return joined.mapInArrow(run, docs.schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_passages(repeated_passages(table(spark, sf_dir, "documents")))
