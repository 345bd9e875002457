import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import ODD
from pyspark.sql import functions as F

from ledgerloom.llm import lm


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def discounts(counts):
    n = Counter(counts)
    last = 6 * n[6] / n[1] if n[1] else 1.0
    d = {}
    for r in range(1, 6):
        x = ((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last) if n[r] and last != 1 else 0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return lambda c: c * d.get(c, 1), n


def brute(rows, order=3):
    """rows: (doc_id, text). The same model with dictionaries: contexts are tuples, runs stay inside <end> + document."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    uni, after = Counter(), [defaultdict(Counter) for _ in range(order)]
    for i, text in rows:
        if not held[i]:
            t = [None, *tokens_of(text)]
            uni.update(t[1:])
            for k in range(1, order):
                for at in range(k, len(t)):
                    after[k][tuple(t[at - k : at])][t[at]] += 1
    total, kinds = sum(uni.values()), len(uni)
    d1, n1 = discounts(uni.values())
    d = [discounts([c for x in a.values() for c in x.values()])[0] for a in after]
    unknown = max(n1[1], 1) / (total + 1)
    kept = sum(map(d1, uni.values())) or 1

    @functools.cache
    def weights(context):
        seen, k = after[len(context)][context], len(context)
        n, mass = sum(seen.values()), sum(map(d[k], seen.values()))
        whole = n if mass < n * (1 - 1e-12) else n + 1
        return whole, (1 - mass / whole) / (1 - sum(p(context[1:], w) for w in seen))

    def p(context, w):
        if not context:
            return (1 - unknown) * d1(uni[w]) / kept if w in uni else unknown
        if context not in after[len(context)]:
            return p(context[1:], w)
        whole, left = weights(context)
        seen = after[len(context)][context]
        return d[len(context)](seen[w]) / whole if w in seen else left * p(context[1:], w)

    out = []
    for i, text in rows:
        t = [None, *tokens_of(text)]
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t[1:])
        score = sum(math.log10(p(tuple(t[max(0, at - order + 1) : at]), t[at])) for at in range(1, len(t)))
        out.append((i, held[i], len(t) - 1, sum(w in uni for w in t[1:]), total, base, score))
    return out, p, list(uni), list(after[-1])


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2], r[5])) for x in (got, want))
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("sizes", [(1_000_000, 2_000_000), (300, 2_000)])
def test_equals_dictionaries(spark, sizes, order):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, p, vocabulary, contexts = brute(rows, order)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(lm.Model(frame, lm.held_out(), *sizes, order=order).scores().collect(), want)
    if order > 1:
        for context in (*contexts[:3], *contexts[-3:], ("never seen",) * (order - 1), (*contexts[0][:-1], "never seen")):
            assert sum(p(context, w) for w in vocabulary) + p(context, "never seen") == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("sizes", [(1_000_000, 2_000_000), (3_000, 20_000), (300, 2_000)])
def test_private_runs_are_counted_by_their_chunk(spark, sizes, order):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, "one two three four five " * 30), (501, "one two three " * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.Model(frame, lm.held_out(), *sizes, order=order, stored=False)
    same(model.scores().collect(), brute(rows, order)[0])
    model.rounds = 3
    same(model.scores().collect(), brute(rows, order)[0])
    full = lm.Model(frame, lm.held_out(), *sizes, order=order)
    bytes_of = lambda m: sum(t.agg(F.sum(F.expr("length(a) + coalesce(length(b), 0) + coalesce(length(c), 0)"))).first()[0] for t in m.tables)
    assert bytes_of(model) < 0.7 * bytes_of(full) and not any(t.filter(F.col("kind") == lm.MODEL).count() for t in model.tables)
    assert all(t.filter(F.col("kind") == lm.MODEL).count() for t in full.tables)
    # The hashes go when they have been asked for; the texts stay.
    assert all(f"kind={lm.TEXTS}" in f for f in spark.read.parquet(model.chunks.inputFiles()[0].rpartition("/kind=")[0]).inputFiles())


def test_sorted_places():
    import numpy as np

    for keys in ([], [3, 1, 3, 2], [2**63, 5, 2**64 - 1, 5], [0, 0]):
        keys = np.array(keys, np.uint64)
        order, ranked = lm.in_order(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and ranked.tolist() == sorted(keys.tolist())
        found, place = lm.numbered_keys(keys)
        assert found.tolist() == sorted(set(keys.tolist())) and found[place].tolist() == keys.tolist()


def test_longer_contexts_tell_more(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    of = [lm.Model(docs, lm.held_out(), order=k).scores().filter("held_out").agg(F.sum("score")).first()[0] for k in (1, 2, 3)]
    assert of[0] < of[1] < of[2]


def test_odd_rows(docs):
    same(lm.Model(docs(ODD), lm.held_out()).scores().collect(), brute([(r[0], r[1]) for r in ODD])[0])
    assert lm.Model(docs([]), lm.held_out()).scores().count() == 0
    none = lm.Model(docs([(1, "a b")]), F.lit(True)).scores().collect()
    assert [tuple(r)[2:] for r in none] == [(3, 0, 0, 0.0, 0.0)]


def test_counts_beyond_32_bits():
    import numpy as np

    assert lm.added(np.array([0, 0, 1]), np.array([3 * 10**9, 3 * 10**9, 2**53 + 1]), 3).tolist() == [6 * 10**9, 2**53 + 1, 0]
    assert lm.unpacked(lm.packed(np.array([6 * 10**9, -1]))).tolist() == [6 * 10**9, -1]
