import random

import numpy as np
from conftest import ODD

from ledgerloom.llm import substrings as S


def tree(values, low, high, least, out):
    """Windows by the recursive definition."""
    if high - low + 1 < least:
        return
    c = min(range(low, high + 1), key=lambda i: (values[i], i))
    out.append((low, c, high))
    tree(values, low, c - 1, least, out)
    tree(values, c + 1, high, least, out)


def test_windows_are_the_trees_nodes():
    rng = np.random.default_rng(1)
    for n, least in ((1, 1), (5, 6), (40, 3), (300, 7), (1000, 46)):
        sizes = [n // 3, n - n // 3]
        values = rng.integers(0, 2**63, n).astype(np.uint64)
        doc = np.repeat([0, 1], sizes)
        want = []
        for a, b in ((0, sizes[0]), (sizes[0], n)):
            tree(values >> np.uint64(24), a, b - 1, least, want)
        got = S.compact_windows(values, doc, least)
        assert sorted(zip(*got[[0, 4, 3]].tolist())) == sorted(want)
        for low, first, last, high, centre in got.T.tolist():
            assert low <= first <= last <= high - least + 1 and all(int(np.argmin(values[s : s + least] >> np.uint64(24))) + s == centre for s in range(first, last + 1))


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def test_planted_passages(docs):
    rng = random.Random(4)
    long, near, line = words(rng, 70), words(rng, 120), words(rng, 12)
    rows, want = [], set()
    for i in range(60):
        w = words(rng, rng.randrange(20, 400))
        if i % 3 == 0:  # one passage in twenty documents
            w[len(w) // 2 : len(w) // 2] = long
            want.add(i)
        if i % 7 == 1:  # a passage with a word changed here and there
            p = list(near)
            for k in rng.sample(range(120), 2):
                p[k] = "other"
            w += p
            want.add(i)
        w = w + line  # too short to count
        rows.append((i, " ".join(w)))
    rows += [(100, rows[5][1]), (101, rows[5][1].upper())]
    found = S.merged_passages(S.repeated_passages(docs(rows + ODD[:3]))).collect()
    later = want - {0, 1}
    got = {r["doc_id"] for r in found}
    assert got == later | {x for x in (100, 101) if len(rows[5][1].split()) >= 50}
    by = {r["doc_id"]: r for r in found}
    for i in range(3, 60, 3):
        text = rows[i][1].split()
        spans = [(r["start_word"], r["end_word"]) for r in found if r["doc_id"] == i]
        at = text.index(long[0])
        assert any(a <= at + 2 and b >= at + 68 for a, b in spans), (i, spans, at)
    assert all(r["source_doc_id"] < r["doc_id"] for r in found) and by[3]["source_doc_id"] == 0
    kept = {r["doc_id"]: r for r in S.remove_repeats(docs(rows)).collect()}
    assert kept[0]["text"] == rows[0][1] and kept[2]["text"] == rows[2][1] and kept[0]["ids"] == "x"
    assert long[30] not in kept[3]["text"] and line[0] in kept[3]["text"]


def test_odd_rows(docs):
    assert S.repeated_passages(docs([])).count() == 0
    assert S.repeated_passages(docs(ODD)).count() == 0
    two = [(1, "a b c " * 40_000), (2, "a b c " * 40_000), (3, None)]
    assert {(r["doc_id"], r["source_doc_id"]) for r in S.repeated_passages(docs(two)).collect()} == {(2, 1)}
    assert {r["doc_id"] for r in S.remove_repeats(docs([*ODD])).collect()} == {r[0] for r in ODD}
    assert S.without_spans("  a b  c d ", [(1, 3)]) == "a d" and S.without_spans("a b", [(0, 9)]) == ""


def test_exact_repeats_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    first, want = {}, set()
    for d, text in sorted(rows):
        w = text.encode().lower().split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                want.add(d)
    got = {r["doc_id"] for r in S.op4_substring_dedup(spark, sf).collect()}
    assert want <= got and len(want) > 5


def test_an_edit_at_any_place_of_a_short_passage():
    rng = np.random.default_rng(5)
    of = lambda w: S.shingles(" ".join(map(str, w)))
    for n in (50, 51, 55, 60, 65, 70):
        for k in range(n):
            p = rng.integers(0, 2**60, n)
            q = p.copy()
            q[k] = -1
            x, y = (of([*rng.integers(0, 2**60, 90), *w, *rng.integers(0, 2**60, 90)]) for w in (p, q))
            found = S.agreeing(x, y)
            assert len(found) == 1, (n, k)
            i, j, _, _, s = found[0]
            assert s >= 0.8 and min(j - i, n - 4) >= S.LEAST and i <= 90 + (k + 1 if k < 5 else 5) and j >= 90 + n - 9, (n, k, found)


def test_agreeing_finds_planted_runs_of_any_edits():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(46, 300))
        p = rng.integers(0, 2**60, n).astype(np.uint64)
        x, y, kept = list(p), list(p), n
        for k in sorted(rng.choice(n - 2, n // 60, replace=False).tolist(), reverse=True):  # replaced, left out or put in
            kind = rng.integers(3)
            if kind != 1:
                x[k : k + (kind != 2)] = rng.integers(0, 2**60, 3).astype(np.uint64).tolist()
            else:
                del x[k]
        kept = len(set(x) & set(y))
        if kept / (len(set(x)) + len(set(y)) - kept) < 0.8 or min(len(x), len(y)) < 46:
            continue
        wide = lambda w: np.array([*rng.integers(0, 2**60, 80), *w, *rng.integers(0, 2**60, 80)], np.uint64)
        assert sum(j - i for i, j, *_ in S.agreeing(wide(x), wide(y))) >= 0.8 * len(x)


def test_a_passage_beside_a_stretch_that_is_less_similar():
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(0, 2**60, n).astype(np.uint64)
    left = fresh(221)
    other = left.copy()
    other[20::31] = fresh(len(other[20::31]))
    good = fresh(74)
    near = good.copy()
    near[37] = fresh(1)[0]
    of = lambda w: S.shingles(" ".join(map(str, w)))
    x, y = of([*left, *good]), of([*other, *near])
    found = S.agreeing(x, y)
    assert any(i <= 226 and j >= 289 and s >= 0.8 for i, j, *_, s in found), found
    a, b = fresh(60), fresh(60)  # in one place here, in two there, in either order
    whole = np.concatenate([a, b])
    for parts in ((a, fresh(200), b), (b, fresh(200), a)):
        found = S.agreeing(whole, np.concatenate(parts))
        assert [(i, j) for i, j, *_ in found] == [(0, 60), (60, 120)], found


def variants(rng, p, n, part):
    """Copies of a passage with that part of the words replaced, so that they don't agree with it or one another."""
    return [[w if rng.random() > part else f"v{rng.randrange(10**7)}" for w in p] for _ in range(n)]


def test_repeats_in_groups_that_variants_lead(docs):
    rng = random.Random(9)
    rows, want, at = [], {}, 0
    for _ in range(40):
        p = words(rng, 50)
        for v in variants(rng, p, 12, 0.035):
            rows.append((at, " ".join(words(rng, 30) + v + words(rng, 30))))
            at += 1
        same = variants(rng, p, 1, 0.035)[0]
        for _ in range(2):  # exactly the same variant in both
            rows.append((at, " ".join(words(rng, 30) + same + words(rng, 30))))
            at += 1
        want[at - 1] = same
    found = S.merged_passages(S.repeated_passages(docs(rows))).collect()
    for d in want:
        spans = [(r["start_word"], r["end_word"]) for r in found if r["doc_id"] == d]
        assert any(a <= 30 and b >= 80 for a, b in spans), (d, spans)


def test_open_members_are_compared_with_all_before():
    rng = np.random.default_rng(8)
    line = rng.integers(0, 2**32, 20).astype(np.uint32)
    parts = [np.concatenate([rng.integers(0, 2**32, 30).astype(np.uint32), line, rng.integers(0, 2**32, 30).astype(np.uint32)]) for _ in range(40)]
    parts += [parts[17], parts[0][20:], parts[33]]  # the group's least document doesn't have the first and the last
    runs = np.array([S.span_of(5, 25)] * 43)
    found = S.settled(np.arange(43), np.zeros(43, np.int64), runs, parts)
    assert {(r[0], r[3]) for r in found} == {(40, 17), (41, 0), (42, 33)}
    assert not S.settled(np.arange(43), np.zeros(43, np.int64), np.full(43, -1), parts)


def test_only_the_repeating_rows_words_go(docs):
    """A row keeps its words where another row with its id repeats something."""
    rng = random.Random(11)
    passage, own, other = words(rng, 60), words(rng, 100), words(rng, 100)
    rows = [(1, " ".join([*passage, *words(rng, 5)])), (7, " ".join([*words(rng, 20), *passage])), (7, " ".join(own)), (7, " ".join(own)), (8, " ".join(other)), (None, " ".join(passage))]
    got = sorted((r["doc_id"] or 0, len(r["text"].split())) for r in S.remove_repeats(docs(rows)).collect())
    assert got == [(0, 60), (1, 65), (7, 20), (7, 100), (7, 100), (8, 100)]
    assert S.remove_repeats(docs(rows)).columns == docs(rows).columns


def test_fewest_kinds_of_a_stretch():
    rng = np.random.default_rng(12)
    for _ in range(30):
        parts = [rng.integers(0, rng.integers(2, 40), rng.integers(1, 30)) for _ in range(6)]
        before, at = [], 0
        for p in parts:
            before += [max((at + j for j in range(i) if p[j] == p[i]), default=-1) for i in range(len(p))]
            at += len(p)
        got = S.fewest_kinds(np.array(before), np.array([len(p) for p in parts]), 9)
        for p, n in zip(parts, got.tolist()):
            assert n > 1 << 30 if len(p) < 9 else n == min(len(set(p[i : i + 9])) for i in range(len(p) - 8))


def test_places_by_value():
    rng = np.random.default_rng(13)
    for bits in (3, 40, 60, 64):
        v = rng.integers(0, 1 << bits, 2000, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 1 << 62, 2000).astype(np.uint64) << np.uint64(2)
        v[::7] = v[0]
        assert S.places_by(v, bits).tolist() == sorted(range(2000), key=lambda k: (v[k], k))


def test_texts_of_too_few_common_shingles_are_not_compared(monkeypatch):
    """Two texts that repeat their 44 shingles, 37 of them the same: 37 of 51 whatever the passage."""
    rng = np.random.default_rng(14)
    common = rng.integers(0, 2**32, 37).astype(np.uint32)
    parts = [np.tile(np.concatenate([common, rng.integers(0, 2**32, 7).astype(np.uint32)]), 20) for _ in range(6)]
    calls, plain = [], S.agreeing
    monkeypatch.setattr(S, "agreeing", lambda *a: calls.append(1) or plain(*a))
    assert not S.settled(np.arange(6), np.zeros(6, np.int64), np.full(6, S.span_of(0, 800)), parts) and not calls
    assert not plain(parts[0], parts[1])
    near = parts[0].copy()
    near[43::44] = 5
    found = S.settled(np.arange(7), np.zeros(7, np.int64), np.full(7, S.span_of(0, 800)), [*parts, near])
    assert [(r[0], r[3]) for r in found] == [(6, 0)] and len(calls) == 1


def test_groups_together_are_as_groups_alone():
    rng = np.random.default_rng(15)
    doc, begin, runs, parts, group, want = [], [], [], [], [], set()
    for g in range(25):
        base = rng.integers(0, 2**32, 70).astype(np.uint32)
        if g % 3 == 0:
            base[35:] = base[:35]
        n = int(rng.integers(2, 12))
        own = []
        for _ in range(n):
            p = base.copy()
            p[rng.choice(70, rng.integers(0, 16), replace=False)] = rng.integers(0, 2**32, 1)
            own.append(p[int(rng.integers(0, 10)) :])
        docs, at = np.sort(rng.integers(0, 8, n)), rng.integers(0, 50, n)
        stretch = np.array([S.span_of(int(a) + 3, int(a) + 12) if rng.random() < 0.7 else -1 for a in at])
        want |= set(S.settled(docs, at, stretch, own))
        # Each open member that an earlier document of its group has a passage of, around the run, has one.
        for k in np.flatnonzero(stretch >= 0).tolist():
            covers = lambda i, j, k=k: max((int(stretch[k]) >> 32), int(at[k]) + i) <= min(int(stretch[k]) & 0xFFFFFFFF, int(at[k]) + j - S.LEAST)
            if any(docs[o] < docs[k] and any(covers(i, j) for i, j, *_ in S.agreeing(own[k], own[o])) for o in range(k)):
                assert any(r[0] == docs[k] and covers(r[1] - at[k], r[2] - S.SHINGLE + 1 - at[k]) for r in want), (g, k)
        for col, v in ((doc, docs), (begin, at), (runs, stretch), (parts, own), (group, [g] * n)):
            col.extend(v)
    got = S.settled(np.array(doc), np.array(begin), np.array(runs), parts, np.array(group))
    assert set(got) == want and len(want) > 30
