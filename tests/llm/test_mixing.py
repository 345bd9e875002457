import hashlib
import re

import duckdb
from conftest import ODD

from ledgerloom.llm import mixing


def split(budget, children):
    """children: [(name, weight, cap)]. Whole tokens, filled in the order of cap / weight."""
    part = {}
    todo = sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    left, weight = budget, sum(c[1] for c in children)
    full = [c for k, c in enumerate(todo) if (budget - sum(x[2] for x in todo[:k])) * c[1] >= c[2] * (weight - sum(x[1] for x in todo[:k]))]
    left, weight = budget - sum(c[2] for c in full), weight - sum(c[1] for c in full)
    for c in todo:
        part[c[0]] = c[2] if c in full else left * c[1] // weight
    return part


def brute(rows, budget=mixing.BUDGET, epochs=mixing.MAX_EPOCHS):
    leaf, size = {}, {}
    for doc, text, lang, source in rows:
        m = re.search(r"([0-9]{1,9})$", source or "")
        leaf.setdefault((f"d{int(m[1]) % 4}" if m else "d?", lang or "und", source or "?"), []).append((doc, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    size = {k: sum(n for _, n in v) for k, v in leaf.items()}
    cap = lambda *prefix: epochs * sum(n for k, n in size.items() if k[: len(prefix)] == prefix)
    names = lambda *prefix: sorted({k[len(prefix)] for k in size if k[: len(prefix)] == prefix})
    out = []
    tops = split(sum(size.values()) * budget[0] // budget[1], [(d, mixing.DOMAIN_WEIGHTS.get(d, 1), cap(d)) for d in names()])
    for d in names():
        langs = split(tops[d], [(x, mixing.LANGUAGE_WEIGHTS.get(x, 1), cap(d, x)) for x in names(d)])
        for x in names(d):
            for s, b in split(langs[x], [(s, 1, cap(d, x, s)) for s in names(d, x)]).items():
                n = size[d, x, s]
                whole, rest = (b // n, b % n) if n else (0, 0)
                key = lambda doc: hashlib.md5(f"17:{whole}:{'null' if doc is None else doc}".encode()).hexdigest()
                for doc, tokens in leaf[d, x, s]:
                    upto = sum(t for o, t in leaf[d, x, s] if key(o) <= key(doc))
                    out += [(doc, d, x, s, tokens, b, e) for e in range(whole + (rest > 0 and upto <= rest))]
    return out


def test_odd_rows(docs):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1") for r in ODD]
    got = [tuple(r) for r in mixing.select_epochs(docs(ODD)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str) and got
    assert mixing.select_epochs(docs([])).count() == 0 and mixing.select_epochs(docs([(1, None), (2, "")])).count() == 0


def test_equals_rule_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]))
    assert sorted(tuple(r) for r in mixing.op6_mix_sources(spark, sf).collect()) == want
    found = duckdb.sql(mixing.oracle(f"'{sf}/documents.parquet'"))
    at = [found.columns.index(c) for c in ("doc_id", "domain", "language", "source", "n_tokens", "leaf_budget", "epoch")]
    assert sorted(tuple(r[i] for i in at) for r in found.fetchall()) == want
    kept = mixing.mix_documents(docs, (1, 2), 1)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and kept.select("doc_id").distinct().count() == kept.count()


def test_shortages_stay_with_siblings():
    assert split(100, [("a", 1, 10), ("b", 1, 1000), ("c", 2, 1000)]) == {"a": 10, "b": 30, "c": 60}
