"""The stored text index against a scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import textindex as T


def scan(rows, words):
    return sorted(i for i, t in rows if i is not None and t is not None and words.lower() in t.lower())


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/index"


def test_searches_equal_a_scan(spark, folder):
    r = random.Random(2)
    words = ["Straße", "sea", "seal", "Öl", "日本語", "x", "The end", "a😀b", "ABC"]
    rows = [(i * r.choice([1, 70_000]) + i, " ".join(r.choices(words, k=r.randrange(12)))) for i in range(300)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(None, "sea"), (-5, "the END of a seal"), (5_000_000_000, "日本語"), (-70_000, None), (10**15, "")]
    index = T.TextIndex(spark, folder)
    for part in range(3):
        index = index.add(spark.createDataFrame([x for k, x in enumerate(rows) if k % 3 == part], "id long, text string"))
    df = spark.createDataFrame(rows, "id long, text string")
    for one in (index, index.compact()):
        assert len(one.generations) in (1, 3)
        for q in ("sea", "SEAL", "straße", "日本語", "The end", "end sea", "a😀b", "Öl", "x", "nothing", "", "e s"):
            got = [x["id"] for x in one.search(df.filter("id is not null"), "id", "text", q, 10_000, [F.col("id")]).collect()]
            assert got == scan(rows, q), q


def test_candidates_are_few_and_the_scan_is_asked_for_them(spark, folder, tmp_path):
    rows = [(i, f"common text number {i} {'rare needle' if i % 1000 == 7 else ''}") for i in range(5000)]
    spark.createDataFrame(rows, "id long, text string").write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts")
    index = T.TextIndex(spark, folder).add(df)
    assert index.candidates("needle").count() == 5
    plan = index.search(df, "id", "text", "needle", 3, [F.col("id")])._jdf.queryExecution().toString()
    assert "In(id, [1007,2007,3007,4007,7])" in plan.split("PushedFilters")[-1]
    assert "In(gram" in index.candidates("needle")._jdf.queryExecution().toString()
    many = index.search(df, "id", "text", "common", 10_000, [F.col("id")])
    assert many.count() == 5000 and "LeftSemi" in many._jdf.queryExecution().toString()


def test_changed_texts(spark, folder):
    """A text that came again is found as it is now; what it was is not."""
    index = T.TextIndex(spark, folder).add(spark.createDataFrame([(1, "old words"), (2, "other")], "id long, text string"))
    now = spark.createDataFrame([(1, "new words"), (2, "other")], "id long, text string")
    index = index.add(now.filter("id = 1")).compact()
    find = lambda q: [r["id"] for r in index.search(now, "id", "text", q, 9, [F.col("id")]).collect()]
    assert find("new words") == [1] and find("old words") == [] and find("other") == [2]
    assert [r["id"] for r in T.TextIndex(spark, folder).search(now, "id", "text", "words", 9, [F.col("id")]).collect()] == []


def test_packing():
    rng = np.random.default_rng(0)
    gram, ids = T._distinct(rng.integers(0, 5, 4000), rng.integers(-200_000, 200_000, 4000))
    batch = T._packed(gram, ids)
    back = T.unpacked(batch)
    assert (back[0] == gram).all() and (back[1] == ids).all() and batch.num_rows == len({(g, i >> 16) for g, i in zip(gram.tolist(), ids.tolist(), strict=True)})
