"""Approximate nearest neighbours by inner product, with stable projections and kd-trees.

Vectors get one more component so that all have the norm of the longest; the largest inner product is then the least
distance. A few seeded Gaussian projections (2-stable: a projected squared distance over the true one is chi-square
distributed) put each vector into a low-dimensional space. Its kd-tree's upper part is fitted on a bounded sample and
says to which cell a vector goes; each cell has its own tree. A query takes leaves in the order of their projected
distance, verifies their vectors by the true measure, and stops when the chi-square test holds: at the distance of its
k-th best so far, a vector in the next leaf would be that far off in the projection with a chance under 1 - SURE.
Queries visit their own cell first, then every cell that the test doesn't rule out.

Equal vectors are searched as one. Cells and their queries are dealt in blocks of bounded size.

Defined results: vectors that are null, zero, have null or non-finite components, or haven't the number of components
that most have, take no part; equal rows count once; rows of a query's own id are no candidates; null ids take no
part; fewer candidates than asked for give fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.base import staged, table

NEIGHBOURS = 20
QUERY_EVERY = 20
PROJECTIONS = 16
SURE = 0.92
SEED = 5
#: Rows that the upper tree is fitted on; rows of a block of a cell and of its queries; points of a leaf.
SAMPLE, CELL, QUERY_BLOCK, LEAF = 100_000, 8192, 4096, 256
#: The upper tree has so many sampled rows in a cell at least.
SAMPLED_IN_CELL = 32


def chi_square_cdf(x: float, even: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, even // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, even) < p else (low, mid)
    return high


def projection(size: int, m: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size + 1, m))


def project(x: np.ndarray, longest2: float, matrix: np.ndarray, query: bool) -> np.ndarray:
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, longest2 - np.einsum("ij,ij->i", x, x)))
    return x @ matrix[:-1] + more[:, None] * matrix[-1]


class Splits:
    """The upper tree: node i has children 2i+1 and 2i+2; cells are numbered from left to right."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.at = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = [points]
        for level in range(depth):
            after = []
            for k, p in enumerate(parts):
                node = 2**level - 1 + k
                axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
                self.axis[node], self.at[node] = axis, float(np.median(p[:, axis])) if len(p) else 0.0
                left = p[:, axis] <= self.at[node]
                after += [p[left], p[~left]]
            parts = after

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - (2**self.depth - 1)


def leaves(points: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Indices of the points of each leaf of a kd-tree: the widest axis is cut at its median."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            out.append(part)
            continue
        p = points[part]
        axis = int(np.argmax(np.ptp(p, axis=0)))
        order = np.argpartition(p[:, axis], len(part) // 2)
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return out


def search(q: np.ndarray, qp: np.ndarray, bound: np.ndarray, x: np.ndarray, xp: np.ndarray, k: int, longest2: float, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and row numbers (query, k) of the best found, -inf and -1 for none, and how many pairs were verified.
    bound: a score that k others have.

    Leaves come in the order of their projected distance; of a leaf's vectors, those are verified whose own projected
    distance passes the test.
    """
    tree = leaves(xp)
    low, high = (np.stack([f(xp[t], axis=0) for t in tree]) for f in (np.min, np.max))
    best, found, verified = np.full((len(q), k), -np.inf), np.full((len(q), k), -1), 0
    norm2, qp2, xp2 = (np.einsum("ij,ij->i", v, v) for v in (q, qp, xp))
    for a in range(0, len(q), 512):
        b = min(len(q), a + 512)
        p = qp[a:b, None, :]
        far = (np.maximum(0, np.maximum(low - p, p - high)) ** 2).sum(axis=2)
        order = np.argsort(far, axis=1)
        active = np.arange(b - a)
        for r in range(len(tree)):
            leaf = order[active, r]
            worst = np.maximum(best[a + active].min(axis=1), bound[a + active])
            radius2 = np.where(np.isfinite(worst), factor * np.maximum(0, norm2[a + active] + longest2 - 2 * worst), np.inf) * (1 + 1e-9) + 1e-12
            go = far[active, leaf] <= radius2
            active, leaf, radius2 = active[go], leaf[go], radius2[go]
            if not len(active):
                break
            turn = np.argsort(leaf, kind="stable")
            for part in np.split(turn, np.flatnonzero(np.diff(leaf[turn])) + 1):
                rows, points = a + active[part], tree[leaf[part[0]]]
                near = qp2[rows, None] + xp2[points] - 2 * (qp[rows] @ xp[points].T) <= radius2[part, None]
                row, col = np.nonzero(near)
                verified += len(row)
                s = np.full(near.shape, -np.inf)
                if 4 * len(row) > near.size:
                    s[near] = (q[rows] @ x[points].T)[near]
                elif len(row):
                    s[row, col] = np.einsum("ij,ij->i", q[rows[row]], x[points[col]])
                hit = (s > best[rows].min(axis=1)[:, None]).any(axis=1)
                rows, s = rows[hit], s[hit]
                if len(rows):
                    both = np.concatenate([best[rows], s], axis=1)
                    at = np.argpartition(-both, k - 1, axis=1)[:, :k]
                    names = np.concatenate([found[rows], np.broadcast_to(points, s.shape)], axis=1)
                    best[rows], found[rows] = np.take_along_axis(both, at, 1), np.take_along_axis(names, at, 1)
    found[np.isneginf(best)] = -1
    return best, found, verified


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(-1, size)


def valid_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v, same): v the components as packed doubles, same its digest; and the number of components."""
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null and e is not null")
    good = given.filter("size(e) > 0 and forall(e, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(e, c -> c <> 0)")
    sizes = good.groupBy(F.size("e").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) + 0.0  # no negative zero
                yield pa.record_batch([batch.column("vec_id"), pa.array([x.tobytes() for x in flat.astype("<f8")], pa.binary())], ["vec_id", "v"])

    packed = good.filter(F.size("e") == size).mapInArrow(pack, "vec_id long, v binary")
    return packed.withColumn("same", F.md5("v")), size


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(rep, same, ids): equal vectors; ids their least k + 1 ids, found in two steps so that no task holds a large class."""
    deals = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = vectors.select("same", "vec_id").distinct().withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(deals)))
    for keys in (("same", "deal"), ("same",)):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    return ids.groupBy("same").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Index:
    """All different vectors, each with its projection and cell, in the shared folder."""

    def __init__(self, rows: DataFrame, k: int = NEIGHBOURS, sample: int = SAMPLE, cell: int = CELL) -> None:
        self.k, self.cell = k, cell
        vectors, self.size = valid_vectors(rows)
        self.vectors = staged(vectors, "vectors")
        self.classes = staged(classes_of(self.vectors, k), "classes")
        different = self.vectors.join(self.classes.select(F.col("rep").alias("vec_id"), "same"), ["vec_id", "same"], "left_semi").dropDuplicates(["vec_id", "same"])
        size = self.size

        def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = _matrix(batch.column("v"), size)
                    yield pa.record_batch([pa.array(np.einsum("ij,ij->i", v, v))], ["n2"])

        self.different = staged(different, "different")
        n, longest2 = self.different.select("v").mapInArrow(norms, "n2 double").agg(F.count("*"), F.max("n2")).first()
        self.count, self.longest2 = n, longest2 or 0.0
        self.matrix = projection(self.size)
        part = min(1.0, sample / max(1, n))
        picked = self.different.filter(F.pmod(F.xxhash64(F.lit("cells"), "vec_id"), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * sample).select("v")
        points = self._points(picked)
        depth = max(0, min(math.ceil(math.log2(max(1, n / cell))), int(math.log2(max(1, len(points) / SAMPLED_IN_CELL)))))
        self.splits = Splits(points, depth)
        self.indexed = staged(self._project(self.different.select("vec_id", "same", "v"), False), "indexed")
        boxes = self.indexed.groupBy("cell").agg(F.count("*").alias("n"), *(f(F.col("p")[i]).alias(f"{name}{i}") for i in range(PROJECTIONS) for name, f in (("lo", F.min), ("hi", F.max)))).collect()  # cells: fewer than sampled rows
        self.boxes = {r["cell"]: (r["n"], [r[f"lo{i}"] for i in range(PROJECTIONS)], [r[f"hi{i}"] for i in range(PROJECTIONS)]) for r in boxes}

    def _points(self, picked: DataFrame) -> np.ndarray:
        """Projections of a bounded sample."""
        size, longest2, matrix = self.size, self.longest2, self.matrix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = project(_matrix(batch.column("v"), size), longest2, matrix, False)
                    yield pa.record_batch([pa.array([x.tobytes() for x in p], pa.binary())], ["p"])

        found = picked.mapInArrow(run, "p binary").toArrow().column("p").to_pylist()
        return np.frombuffer(b"".join(found), np.float64).reshape(-1, PROJECTIONS)

    def _project(self, df: DataFrame, query: bool) -> DataFrame:
        size, longest2, matrix, splits = self.size, self.longest2, self.matrix, self.splits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = project(_matrix(batch.column("v"), size), longest2, matrix, query)
                    yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(list(p), pa.list_(pa.float64())), pa.array(splits.cells(p).astype(np.int32))], ["vec_id", "same", "v", "p", "cell"])

        return df.mapInArrow(run, "vec_id long, same string, v binary, p array<double>, cell int")

    def _visit(self, visits: DataFrame) -> DataFrame:
        """visits: (same, v, p, bound, cell). (same, rep, score) of the best in each cell, by blocks."""
        size, k, longest2, factor = self.size, self.k + 1, self.longest2, chi_square_quantile(SURE, PROJECTIONS)
        blocks = {c: -(-n // self.cell) for c, (n, _, _) in self.boxes.items()}
        counts = {r["cell"]: -(-r["n"] // QUERY_BLOCK) for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        n_of = lambda of: F.create_map(*(F.lit(int(x)) for kv in of.items() for x in kv))[F.col("cell")]
        if not counts:
            return visits.sparkSession.createDataFrame([], "same string, rep long, score double")
        own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        q = visits.withColumns({"qb": own("same", n_of(counts)), "_b": n_of(blocks)}).withColumn("xb", upto(F.col("_b"))).select("cell", "xb", "qb", "same", "v", "p", "bound")
        x = self.indexed.filter(F.col("cell").isin(list(counts))).withColumns({"xb": own("vec_id", n_of(blocks)), "_q": n_of(counts)}).withColumn("qb", upto(F.col("_q"))).select("cell", "xb", "qb", "vec_id", "v", "p")

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["same", "rep", "score"]
            if not left.num_rows or not right.num_rows:
                return pa.table({"same": pa.array([], pa.string()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            qv, xv = _matrix(left.column("v"), size), _matrix(right.column("v"), size)
            qp, xp = (np.array(t.column("p").to_pylist()) for t in (left, right))
            ids = right.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, xv, xp = ids[order], xv[order], xp[order]
            _, found, _ = search(qv, qp, left.column("bound").to_numpy(), xv, xp, k, longest2, factor)
            row, col = np.nonzero(found >= 0)
            x = found[row, col]
            exact = np.einsum("ij,ij->i", qv[row], xv[x])
            return pa.table([left.column("same").take(pa.array(row)).combine_chunks(), pa.array(ids[x]), pa.array(exact)], names)

        keys = ["cell", "xb", "qb"]
        return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(block, "same string, rep long, score double")

    def _best(self, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("same").orderBy(F.desc("score"), "rep")
        return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= self.k + 1)

    def neighbours(self, queries: DataFrame) -> DataFrame:
        """queries: (vec_id, v, same). (query_id, rank, vec_id, score)."""
        k = self.k
        one = queries.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.first("v").alias("v"))
        asked = staged(self._project(one.select("vec_id", "same", "v"), True), "asked")
        home = staged(self._visit(asked.withColumn("bound", F.lit(float("-inf")))), "home")
        bounds = self._best(home).groupBy("same").agg(F.count("*").alias("c"), F.min("score").alias("s")).select("same", F.when(F.col("c") == k + 1, F.col("s")).otherwise(F.lit(float("-inf"))).alias("bound"))
        size, longest2, factor, boxes = self.size, self.longest2, chi_square_quantile(SURE, PROJECTIONS), self.boxes
        names = np.array(sorted(boxes), np.int32)
        low, high = (np.array([boxes[c][i] for c in names]).reshape(-1, PROJECTIONS) for i in (1, 2))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, p = _matrix(batch.column("v"), size), np.array(batch.column("p").to_pylist())
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                radius2 = np.where(np.isfinite(bound), factor * np.maximum(0, np.einsum("ij,ij->i", v, v) + longest2 - 2 * bound), np.inf)
                far = (np.maximum(0, np.maximum(low - p[:, None], p[:, None] - high)) ** 2).sum(axis=2)
                go = (far <= radius2[:, None] * (1 + 1e-9)) & (names != batch.column("cell").to_numpy()[:, None])
                row, c = np.nonzero(go)
                at = pa.array(row)
                yield pa.record_batch([batch.column("same").take(at), batch.column("v").take(at), batch.column("p").take(at), batch.column("bound").take(at), pa.array(names[c])], ["same", "v", "p", "bound", "cell"])

        joined = asked.join(bounds, "same", "left").select("same", "v", "p", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), "cell")
        rest = self._visit(staged(joined.mapInArrow(others, "same string, v binary, p array<double>, bound double, cell int"), "visits"))
        best = self._best(home.unionByName(rest)).select("same", "rep", "score")
        each = best.join(self.classes.select("rep", "ids"), "rep").select("same", "score", F.explode("ids").alias("vec_id"))
        order = Window.partitionBy("same").orderBy(F.desc("score"), "vec_id")
        first = each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
        lists = first.groupBy("same").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
        out = queries.select(F.col("vec_id").alias("query_id"), "same").distinct().join(lists, "same")
        near = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
        return out.select("query_id", F.posexplode(near).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(table(spark, sf_dir, "embeddings"))
    return index.neighbours(index.vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).select("vec_id", "v", "same"))
