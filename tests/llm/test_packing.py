import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import ODD
from tokenizers import Tokenizer

from ledgerloom.llm import packing


def check_plan(lengths, capacity):
    rows, made = packing.plan(Counter(lengths), capacity)
    fill = defaultdict(list)
    ranks = defaultdict(set)
    for length, rank, first, offset, many in rows.tolist():
        for k in range(many):
            fill[first + k].append((offset, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert {k: len(v) for k, v in ranks.items()} == dict(Counter(lengths)) and all(v == set(range(len(v))) for v in ranks.values())
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in parts) <= 2
    assert len(fill) == made
    return made


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits)[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins)


def test_plans():
    rng = random.Random(2)
    assert check_plan([], 10) == 0 and check_plan([10, 10], 10) == 2 and check_plan([6, 4, 6, 4], 10) == 2 and check_plan([1] * 25, 10) == 3
    for capacity in (7, 30, 100, 2048):
        for kind in range(4):
            top = (capacity, max(1, capacity // 2), max(1, capacity // 5), capacity)[kind]
            lengths = [min(capacity, int(rng.expovariate(6 / capacity)) + 1) if kind == 3 else rng.randint(1, top) for _ in range(400)]
            made = check_plan(lengths, capacity)
            assert -(-sum(lengths) // capacity) <= made <= best_fit(lengths, capacity) * 1.02 + 1, (capacity, kind)


def test_few_texts_are_encoded_at_once():
    import pyarrow as pa

    texts = [f"some words {k} of a text " * 100 for k in range(4000)]
    batch = pa.record_batch([pa.array(range(4000)), pa.array(texts)], ["doc_id", "text"])
    made = list(packing.cut_pieces(iter([batch])))
    assert all(sum(len(texts[d]) for d in set(b.column("doc_id").to_pylist())) <= 4 << 20 for b in made)
    assert sorted({d for b in made for d in b.column("doc_id").to_pylist()}) == list(range(4000))


def brute(rows):
    t = Tokenizer.from_file(packing.TOKENIZER)
    out = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def same(found, rows):
    key = lambda r: str(r)
    assert sorted((tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found), key=key) == sorted(brute(rows), key=key)
    fill = defaultdict(list)
    for r in found:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(fill)


def test_odd_rows(docs, monkeypatch):
    for deal in (200_000, 2):
        monkeypatch.setattr(packing, "RANKED_AT_ONCE", deal)
        pieces, placed = packing.pack_documents(docs(ODD))
        same(placed.collect(), [(r[0], r[1]) for r in ODD])
        assert pieces.filter("length(ids) <> 4 * length").count() == 0
    assert packing.pack_documents(docs([]))[1].count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = packing.op3_best_fit_packing(spark, sf).collect()
    made = same(found, rows)
    assert made <= -(-sum(r["length"] for r in found) // 2048) + 2
