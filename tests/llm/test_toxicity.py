import math

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD

from ledgerloom.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def brute(names, counts, word, kind):
    """Kneser-Ney by dictionaries and strings, straight from its definition."""
    marked = [T._BEGIN + x + T._END for x in names]
    top, wider = {}, {}
    for x, n in zip(marked, counts, strict=True):
        for i in range(1, len(x)):
            g = x[max(0, i + 1 - T.ORDER) : i + 1]
            top.setdefault(g, np.zeros(2))
            top[g] += n
            for k in range(1, T.ORDER):
                if i - k >= 0:
                    wider.setdefault(k, {}).setdefault(x[i + 1 - k : i + 1], set()).add(x[i - k])
    lower = {k: {g: len(v) for g, v in found.items()} for k, found in wider.items()}
    letters = len({c for x in marked for c in x[1:]}) + 1

    def level(table, g, d):
        same = [n for h, n in table.items() if h[:-1] == g[:-1] and len(h) == len(g)]
        total, kinds = sum(same), sum(n > 0 for n in same)
        return (max(table.get(g, 0) - d, 0) / total, d * kinds / total) if total else (0.0, 1.0)

    mine = {g: n[kind] for g, n in top.items()}
    out, x = 0.0, T._BEGIN + word + T._END
    for i in range(1, len(x)):
        longest = min(T.ORDER, i + 1)
        p = 1 / letters
        for k in range(1, longest):
            own, left = level(lower.get(k, {}), x[i + 1 - k : i + 1], T.discount(np.array(list(lower.get(k, {"": 0}).values()))))
            p = own + left * p
        own, left = level(mine, x[i + 1 - longest : i + 1], T.discount(np.array(list(mine.values()))))
        out += math.log(own + left * p)
    return out


def test_equals_brute_force():
    names = ["the", "then", "thin", "idiot", "idea", "a", "straße", "loser", "lose", "hen"]
    counts = np.array([[9, 3], [2, 0], [1, 1], [0, 5], [3, 0], [7, 2], [1, 0], [0, 2], [2, 0], [1, 1]], float)
    model = T.Model(names, counts)
    for word in [*names, "idiots", "xyz", "th", "日本"]:
        got = model.log([word, "the"])[0]
        for kind in (T.ORDINARY, T.TOXIC):
            assert got[kind] == pytest.approx(brute(names, counts, word, kind), abs=1e-5)


def test_probabilities_add_up():
    names = ["ab", "abc", "b", "cab"]
    model = T.Model(names, np.array([[3, 1], [1, 2], [2, 0], [0, 1]], float))
    # The probability of all words up to a length approaches one from below; letters that weren't seen have the rest.
    total, layer = np.zeros(2), [""]
    for _ in range(9):
        total += np.exp(model.log(layer)).sum(0)
        layer = [w + c for w in layer for c in "abc"]
    assert (total < 1).all() and (total > 0.75).all()


def test_held_out_accuracy(spark):
    got = T.op11_toxicity(spark, "/root/testdata/sf0.1")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    good, bad = [r["score"] for r in rows if r["toxic"] == 0], [r["score"] for r in rows if r["toxic"] == 1]
    above = np.searchsorted(np.sort(good), bad) / len(good)
    assert above.mean() > 0.92
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.01 * len(good) and sum(r["predicted"] for r in rows if r["toxic"] == 1) > 0.5 * len(bad)


def test_query(spark):
    got = T.op11_toxicity(spark, SF)
    rows = got.collect()
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_odd_rows(spark, docs):
    insults = [(100 + i, f"you are an idiot and a loser number {chr(97 + i % 20)} of them all") for i in range(40)]
    kind = [(200 + i, f"we are in the garden with a friend number {chr(97 + i % 20)} of them all") for i in range(40)]
    frame = docs([*ODD, *insults, *kind])
    labels = spark.createDataFrame([(i, 1) for i, _ in insults] + [(i, 0) for i, _ in kind] + [(1, 0), (None, 1), (7, None), (4, 0), (4, 0)], "doc_id long, toxic int")
    got = {}
    for r in T.score(frame, T.train(frame, labels)).collect():
        assert got.setdefault(r["doc_id"], r["score"]) == r["score"]  # repeated rows score alike
    share = 40 / 82
    assert all(got[k] == pytest.approx(share) for k in (1, 2, 3))
    assert all(got[i] > 0.5 for i, _ in insults) and all(got[i] < 0.5 for i, _ in kind) and math.isfinite(got[7])
    assert T.score(docs([]), T.train(frame, labels)).count() == 0
    assert {r["score"] for r in T.score(frame, T.train(frame, labels.filter("toxic = 0"))).collect()} == {0.0}
    assert {r["score"] for r in T.score(frame, T.train(frame, labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in T.score(frame, T.train(docs([]), labels)).collect()} == {share}


def test_long_words_stay_finite():
    model = T.Model(["the", "idiot"], np.array([[5, 1], [0, 3]], float))
    logs, n = model.likelihoods(pa.array(["x" * 100_000, "idiot " * 50_000, None]))
    assert np.isfinite(logs).all() and n.tolist() == [1, 1, 0]
