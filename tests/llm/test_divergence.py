import random
import re
from collections import Counter

import pytest
from conftest import ODD

from ledgerloom.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    rows = [(lang or "", source or "", [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(w for r in rows if r[0] == lang for w in set(r[2]))
        kept = [w for w, n in df.items() if n >= least]
        counts = {s: Counter() for l, s, _ in rows if l == lang}
        for l, s, w in rows:
            if l == lang:
                counts[s].update(x for x in w if df[x] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + D.UNIT * (c[w] + D.ADDED) // (c.total() + D.ADDED * len(kept))  # noqa: E731, B023
        for s, c in counts.items():
            pairs = [(sum(abs(p(c, w) - p(o, w)) for w in kept), t) for t, o in counts.items() if t != s]
            terms = [(p(c, w) - p(whole, w), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, k + 1) for k, (v, t) in enumerate(found[:most])]
    return sorted(out)


def rows_of(n, seed=0):
    r = random.Random(seed)
    names = ["the", "Cat", "straße", "日本", "x", "zebra", "Übung", "co-op", "a1b"]
    return [(i, " ".join(r.choices(names, [9, 5, 3, 2, 2, 1, 1, 1, 1], k=r.randrange(30))), r.choice(["en", "en", "de", None]), r.choice(["s0"] * 5 + ["s1", "s2", "é", None])) for i in range(n)]


@pytest.mark.parametrize("block", [1, 2_000, 1 << 24])
def test_equals_brute_force(spark, docs, block):
    """Blocks of one document, of some, and of all."""
    rows = [*((*r, *("en", "src1")[len(r) - 2 :]) if len(r) < 4 else r for r in ODD), *rows_of(300)]
    got = D.audit(docs(rows), least_docs=5, top=4, block_bytes=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4)


def test_many_ranges(spark, docs):
    """A term that fills several ranges is added up over them."""
    rows = [(i, "the" + " other" * (i % 3), "en", f"s{i % 4}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = D.audit(docs(rows).repartition(9), least_docs=30, top=50, block_bytes=1)
        assert sorted(map(tuple, got.collect())) == brute(rows, 30, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_to_compare(spark, docs):
    assert D.audit(docs([])).count() == 0
    rows = [(1, None, "en", "a"), (2, "few words", "en", "b"), (3, "x", "de", "a")]
    assert sorted(map(tuple, D.audit(docs(rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_large_counts():
    import numpy as np

    n = np.array([0, 5, 10**12, 4 * 10**18])
    total = int(n.sum())
    assert D.probability(n, total, 4).tolist() == [1 + 10**9 * (int(x) + 5) // (total + 20) for x in n]
