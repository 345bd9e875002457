"""SimHash near-duplicates: a self-join of fingerprints in binary tries.

Equal fingerprints are one. Two that differ in at most 4 of 64 bits are equal in one of five blocks of 12 or 13 bits,
so each fingerprint goes to five tries, one for each block, rotated so that the block comes first; a trie's root is a
value of that block. In a trie, pairs of nodes go down together, one bit at a time; the pair's budget loses one
where the branches differ, and the pair is dropped when it is spent. Sorted fingerprints are the trie: a node is a
range, and all pairs of a level are handled as arrays. Tries that are too large for a task are taken apart before, by
the same walk over node sizes, into pairs of nodes.

Each task only returns a star for each group that it has connected; components() joins them.

Defined results: a null or empty text has no words and fingerprint zero, and is linked like any other; fewer than
four words are one shingle; repeated rows and ids fall into one component; an empty table gives no rows; other
columns are ignored. A null doc_id has the component of its fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.base import slices, staged, table
from ledgerloom.llm.components import components, looked_up

SHINGLE = 4
SEED = 42
BITS = 64
BUDGET = 4
#: Widths of the blocks: one more than the budget.
BLOCKS = (13, 13, 13, 13, 12)
#: A trie or a pair of nodes with up to so many fingerprints on each side is one task's.
NODE = 20_000
#: Bits by which larger ones go down at once.
STRIDE = 6
#: Pairs of ranges with so few pairs of fingerprints are compared at once, and so many pairs at a time.
LEAF, CHUNK = 256, 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As an unsigned number. bytes.lower() and bytes.split() know ASCII letters and white space only."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(line, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, same, fp) with the fingerprint as a signed long; same is a hash of the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("same"), pa.array(fps.view(np.int64))], ["doc_id", "same", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("same"), "text").mapInArrow(make, "doc_id long, same long, fp long")


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent after joining a[i] with b[i]; parents are never larger."""
    while len(a):
        parent = _roots(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return _roots(parent)


def join_tries(values: np.ndarray, pairs: np.ndarray, bit: int, budget: int = BUDGET) -> np.ndarray:
    """Connects values that differ in at most `budget` bits within pairs of nodes, and returns each one's root.

    values: unsigned, sorted within each node. pairs: rows (from, to, from, to, spent) of ranges of values that have
    all bits above `bit` in common within a range; a range paired with itself stands for its own pairs.
    """
    parent = np.arange(len(values))
    waiting: list[np.ndarray] = []
    lone = lambda p: (p[:, 0] == p[:, 2]) & (p[:, 1] - p[:, 0] < 2)

    def settle(p: np.ndarray) -> None:
        nonlocal parent
        size = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2])
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1
        for part, n in zip(np.split(p, cuts), np.split(size, cuts), strict=True):
            if not len(part):
                continue
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(part[:, 3] - part[:, 2], n)
            a, b = np.repeat(part[:, 0], n) + k // wide, np.repeat(part[:, 2], n) + k % wide
            near = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (a != b)
            parent = _link(parent, a[near], b[near])

    now = pairs[~lone(pairs)]
    while len(now):
        small = (now[:, 1] - now[:, 0]) * (now[:, 3] - now[:, 2]) <= LEAF if bit >= 0 else np.ones(len(now), bool)
        waiting.append(now[small])
        now = now[~small]
        if sum(map(len, waiting)) > CHUNK // 64:
            settle(np.concatenate(waiting))
            waiting = []
        if not len(now):
            break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        a0, a2, b0, b2, spent = now.T
        a1, b1 = a2 - (ones[a2] - ones[a0]), b2 - (ones[b2] - ones[b0])
        same = a0 == b0
        down = [np.stack([a0, a1, b0, b1, spent], 1), np.stack([a1, a2, b1, b2, spent], 1), np.stack([a0, a1, b1, b2, spent + 1], 1), np.stack([a1, a2, b0, b1, spent + 1], 1)[~same]]
        now = np.concatenate(down)
        now = now[(now[:, 4] <= budget) & (now[:, 0] < now[:, 1]) & (now[:, 2] < now[:, 3])]
        now = now[~lone(now)]
        bit -= 1
    if waiting:
        settle(np.concatenate(waiting))
    return _roots(parent)


def _rotated(block: int) -> str:
    """SQL: the fingerprint with this block's bits first."""
    before = sum(BLOCKS[:block])
    return f"(shiftleft(fp, {before}) | shiftrightunsigned(fp, {BITS - before}))" if before else "fp"


def _tries(distinct: DataFrame) -> DataFrame:
    """(trie, root, value): a row for each fingerprint and block."""
    rows = ", ".join(f"named_struct('trie', {k}, 'root', shiftrightunsigned({_rotated(k)}, {BITS - w}), 'value', {_rotated(k)})" for k, w in enumerate(BLOCKS))
    return distinct.select(F.expr(f"inline(array({rows}))"))


def _unrotated(value: np.ndarray, trie: np.ndarray) -> np.ndarray:
    before = np.array([sum(BLOCKS[:k]) for k in range(len(BLOCKS))], np.uint64)[trie]
    return np.where(before > 0, (value >> before) | (value << ((np.uint64(BITS) - before) % np.uint64(BITS))), value)


def _stars(trie: np.ndarray, value: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    ends = [_unrotated(value[k], trie[k]).view(np.int64) for k in (moved, parent[moved])]
    return pa.record_batch([pa.array(x) for x in ends], ["a", "b"])


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str], keys: int, most: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups (equal in the first `keys` columns, side by side), about `most` rows at a time."""
    held: list[list[np.ndarray]] = []

    def cut(last: bool) -> list[np.ndarray] | None:
        nonlocal held
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        if last:
            return cols
        new = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:keys]], axis=0))
        if not len(new):
            held = [cols]
            return None
        end = new[-1] + 1
        held = [[c[end:] for c in cols]]
        return [c[:end] for c in cols]

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in names])
            if sum(len(x[0]) for x in held) >= most and (out := cut(False)):
                yield out
    if held:
        yield cut(True)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of whole tries, which come sorted by trie and root."""
    for trie, root, value in _chunks(batches, ["trie", "root", "value"], 2, 1 << 18):
        value = value.view(np.uint64)
        order = np.lexsort((value, root, trie))
        trie, root, value = trie[order], root[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(trie) != 0) | (np.diff(root) != 0)]))
        ends = np.append(starts[1:], len(trie))
        pairs = np.stack([starts, ends, starts, ends, np.zeros_like(starts)], 1)
        yield _stars(trie, value, join_tries(value, pairs, BITS - 1 - min(BLOCKS)))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of pairs of nodes, which come sorted by pair. The walk starts at the top: bits that a node has in common
    don't split it, and those in which the two differ are counted there."""
    for pair, side, trie, value in _chunks(batches, ["pair", "side", "trie", "value"], 1, 1 << 18):
        value = value.view(np.uint64)
        order = np.lexsort((value, side, pair))
        pair, side, trie, value = pair[order], side[order], trie[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0]))
        ends = np.append(starts[1:], len(pair))
        ones = np.concatenate([[0], np.cumsum(side)])
        middle = ends - (ones[ends] - ones[starts])
        own = middle == ends
        pairs = np.stack([starts, middle, np.where(own, starts, middle), ends, np.zeros_like(starts)], 1)
        yield _stars(trie, value, join_tries(value, pairs, BITS - 1))


def _node_pairs(members: DataFrame, node: int, stride: int) -> DataFrame | None:
    """(pair, side, trie, value): large tries taken apart into pairs of nodes of at most node fingerprints each,
    or of fingerprints that can't be told apart further."""
    wide = {k: w for k, w in enumerate(BLOCKS)}
    depth_of = F.create_map(*(F.lit(x) for k, w in wide.items() for x in (k, w)))
    members = members.withColumn("deep", depth_of[F.col("trie")])
    prefix = lambda level: F.expr(f"shiftrightunsigned(value, greatest(0, {BITS} - deep - {stride * level}))")
    now = members.select("trie", F.col("root").alias("x"), F.col("root").alias("y"), F.lit(0).alias("spent")).distinct()
    done = None
    for level in range(1, -(-(BITS - min(BLOCKS)) // stride) + 1):
        gained = F.expr(f"least({stride}, greatest(0, {BITS} - deep - {stride * (level - 1)}))")
        sizes = staged(members.groupBy("trie", prefix(level).alias("p"), gained.alias("gained")).agg(F.count("*").alias("n")).withColumn("up", F.expr("shiftrightunsigned(p, gained)")), "nodes")
        left = sizes.select("trie", F.col("up").alias("x"), F.col("p").alias("x1"), F.col("n").alias("nx"))
        right = sizes.select("trie", F.col("up").alias("y"), F.col("p").alias("y1"), F.col("n").alias("ny"))
        down = now.join(left, ["trie", "x"]).join(right, ["trie", "y"]).filter("x < y or x1 <= y1").withColumn("spent", F.expr("spent + bit_count(x1 ^ y1) - bit_count(x ^ y)")).filter(F.col("spent") <= BUDGET)
        down = staged(down.select("trie", F.col("x1").alias("x"), F.col("y1").alias("y"), "spent", "nx", "ny"), "pairs")
        last = level == -(-(BITS - min(BLOCKS)) // stride)
        ended = (F.col("nx") * F.col("ny") <= node * node) | F.lit(last)
        tasks = down.filter(ended).select(F.xxhash64("trie", F.lit(level), "x", "y").alias("pair"), "trie", "x", "y")
        here = members.select("trie", "value", prefix(level).alias("x"))
        a = tasks.join(here, ["trie", "x"]).select("pair", F.lit(0).alias("side"), "trie", "value")
        b = tasks.filter("x <> y").join(here.withColumnRenamed("x", "y"), ["trie", "y"]).select("pair", F.lit(1).alias("side"), "trie", "value")
        both = a.unionByName(b)
        done = both if done is None else done.unionByName(both)
        now = down.filter(~ended).select("trie", "x", "y", "spent")
        if now.isEmpty():
            break
    return done


def links(prints: DataFrame, node: int = NODE, stride: int = STRIDE) -> DataFrame:
    """prints: (fp), all different. (a, b): enough links for the components of all fingerprints within the budget."""
    tries = _tries(prints)
    large = staged(tries.groupBy("trie", "root").agg(F.count("*").alias("n")).filter(F.col("n") > node), "large-tries")
    none = large.isEmpty()
    small = tries if none else tries.join(large, ["trie", "root"], "left_anti")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = small.repartition(parts, "trie", "root").sortWithinPartitions("trie", "root").mapInArrow(_within, "a long, b long")
    if not none:
        apart = _node_pairs(staged(tries.join(large, ["trie", "root"], "left_semi"), "hot-tries"), node, stride)
        out = out.unionByName(apart.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(_between, "a long, b long"))
    return out


def labelled(docs: DataFrame, node: int = NODE, stride: int = STRIDE) -> DataFrame:
    """(doc_id, same, fp, component_id, root) of each row: same is a hash of its text; root is its component's least
    fingerprint, which tells components without ids apart."""
    prints = staged(fingerprints(docs), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    found = components(links(classes.select("fp"), node, stride))
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    linked = staged(looked_up(joined, least, "root", "members", n_classes).select("fp", "component_id", "root"), "linked")
    of_class = classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return looked_up(prints, of_class, "fp", "n", n_rows)


def near_duplicates(docs: DataFrame, node: int = NODE, stride: int = STRIDE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    return labelled(docs, node, stride).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
