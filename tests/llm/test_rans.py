import zlib

import numpy as np
import pytest
from conftest import ODD
from tokenizers import Tokenizer

from ledgerloom.llm import rans


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000, 200_001])
@pytest.mark.parametrize("kinds", [1, 2, 3000])
def test_blocks(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = np.minimum(rng.zipf(1.3, n), kinds) * 11
    names, counts = np.unique(ids, return_counts=True)
    table = rans.Table(dict(zip(names.tolist(), counts.tolist()))) if n else rans.Table({5: 1})
    assert table.freq.sum() == 1 << rans.SCALE
    block = rans.encode_block(ids, table)
    assert np.array_equal(rans.decode_block(block, table), ids)
    marks = -(-(-(-n // rans.LANES)) // rans.CHECKPOINT_STEPS)
    parts = [rans.decode_block(block, table, k, k + 1) for k in range(marks)]
    assert np.array_equal(np.concatenate(parts) if parts else ids[:0], ids)
    if n > 1000 and kinds > 2:
        p = counts / n
        assert len(block) < n * -(p * np.log2(p)).sum() / 8 * 1.02 + 8 * rans.LANES * (marks + 1) + 100
    damaged = bytearray(block)
    damaged[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(damaged), table)


def brute(rows):
    t = Tokenizer.from_file(rans.TOKENIZER)
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_odd_rows(spark, docs):
    got = rans.read_blocks(spark, rans.write_blocks(docs(ODD))).collect()
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == brute([(r[0], r[1]) for r in ODD])
    assert rans.read_blocks(spark, rans.write_blocks(docs([]))).count() == 0


def test_whole_table(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in rans.op5_token_files(spark, sf).collect()) == brute(rows)
