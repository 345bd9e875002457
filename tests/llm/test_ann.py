import numpy as np
import pytest

from ledgerloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, query, k=20):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    got = sorted((-float(x[query] @ v), i) for i, v in x.items() if i != query)[:k]
    return [(i, -s) for s, i in got]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def run(spark, rows, **sizes):
    index = ann.Index(frame(spark, rows), **sizes)
    out = {}
    for r in index.neighbours(index.vectors.filter("vec_id % 20 = 0").select("vec_id", "v", "same")).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_chi_square():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3) and ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def test_recall_in_many_cells(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.5 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(1500)]
    got = run(spark, rows, cell=100, sample=1000)
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        want = brute(rows, q)
        assert [r for r, _, _ in found] == list(range(1, 21))
        hit += len({i for _, i, _ in found} & {i for i, _ in want})
        scores = [s for _, _, s in found]
        assert scores == sorted(scores, reverse=True)
    assert hit >= 0.9 * 20 * len(got)


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(i, [0.0, 1.0]) for i in range(100, 140)] + [(140, [-1.0, 2.0]), (141, [1.0, -0.0])]
    got = run(spark, rows)
    for q, found in got.items():
        assert [(i, s) for _, i, s in found] == brute(rows, q), q


def test_odd_rows(spark):
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [1.0, float("nan")]), (100, [float("inf"), 1.0]), (120, [1.0]), (None, [1.0, 2.0]), (3, [])]
    good = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])]
    assert run(spark, bad + good) == {0: [(1, 1, 4.0), (2, 2, -1.0)]}
    assert run(spark, []) == {} and run(spark, [(0, [1.0])]) == {}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in ann.op9_nearest_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    assert sum(len(set(v) & {i for i, _ in brute(rows, q)}) for q, v in got.items()) >= 0.9 * 20 * len(got)
