import random
import re

import xxhash
from conftest import ODD

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components, looked_up


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: [(id, fp)]; the least id that each row reaches."""
    fps = list({f for _, f in prints})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                up[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in prints]


def key(row):
    return str(tuple(row))


def test_odd_rows(docs):
    got = [tuple(r) for r in simhash.near_duplicates(docs(ODD)).collect()]
    assert sorted(got, key=key) == sorted(brute_components([(r[0], brute_print(r[1])) for r in ODD]), key=key)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_walks_equal_brute_force(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1, 1 << 63]
    fps = {s for s in seeds}
    for s in seeds:
        f = s
        for _ in range(12):
            for _ in range(rng.choice((1, 2, 4, 5, 6))):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    dense = rng.getrandbits(64)  # a group that no bit splits well
    fps |= {dense ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    prints = [(i, f) for i, f in enumerate(sorted(fps))]
    want = {f: c for _, f, c in brute_components(prints)}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in prints], "fp long")
    for node, stride in ((20_000, 6), (8, 6), (3, 5)):
        got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(simhash.links(frame, node, stride)).collect()}
        group = {}
        for _, f in prints:
            group.setdefault(got.get(f, f), set()).add(f)
        brute = {}
        for _, f in prints:
            brute.setdefault(want[f"{f:016x}"], set()).add(f)
        assert sorted(map(sorted, group.values())) == sorted(map(sorted, brute.values())), node


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in simhash.op2_simhash_near_dedup(spark, sf).collect())
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(brute_components([(r[0], brute_print(r[1])) for r in rows]))
    assert any(d != c for d, _, c in got)


def test_hot_keys_are_joined_where_they_are(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    known = rows.filter("k <> 8").groupBy("k").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    got = looked_up(rows, known, "k", "n", rows.count())
    want = rows.join(known.drop("n"), "k")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 19_999


def test_a_hub_with_many_links(spark):
    from pyspark.sql import functions as F

    hub = spark.range(1, 9_000).select(F.lit(5_000).alias("a"), F.col("id").alias("b"))
    chain = spark.range(10_000, 10_040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["root"] for r in components(hub.unionByName(chain)).collect()}
    assert got == {**dict.fromkeys(range(1, 9_000), 1), **dict.fromkeys(range(10_000, 10_041), 10_000)}
