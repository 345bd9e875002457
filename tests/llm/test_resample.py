import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import ODD

from ledgerloom.llm import resample as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, target, order, buckets, least, part, seed):
    def counts(text):
        w = words(text)
        return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1))

    s, t = Counter(), Counter()
    for _, x in docs:
        s += counts(x)
    for x in target:
        t += counts(x)
    ns, nt = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        c = counts(x)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] * n for b, n in c.items())
        rows.append((i, c.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= least))
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = len(enough) * part[0] // part[1]
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(enough)] + [(*r[:4], None) for r in rows if not r[4]], key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, docs, order):
    rows = [*((r[0], r[1]) for r in ODD), *((50 + i, f"Straße {i} the cat; sat on 12 mats x{i % 7}\x7f`über\n" * (1 + i % 5)) for i in range(60))]
    target = ["the cat sat on a mat", None, "", "Straße über 12", "\x00the\x01"]
    got = R.resample(docs(rows), spark.createDataFrame([(t, 1) for t in target], "text string, rank int"), order, 97, 4, (30, 100), 7)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.drop("n_words").collect()), key=repr) == brute(rows, target, order, 97, 4, (30, 100), 7)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert R.resample(docs([]), none).count() == 0
    rows = [(1, "a b c"), (2, None)]
    got = R.resample(docs(rows), none, 1, 10, 1, (1, 1), 3).drop("n_words").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, [], 1, 10, 1, (1, 1), 3)
