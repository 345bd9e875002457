import math
from functools import lru_cache

import numpy as np
import pytest
from conftest import ODD

from ledgerloom.llm import langid


def test_sums_over_all_segmentations():
    vocabulary = langid.Vocabulary.shared(langid.VOCABULARY)
    rng = np.random.default_rng(0)
    prob = rng.random((vocabulary.size, 3)) / 1000
    prob[0] = 1e-9
    words = ["the", "straße", "a", "thisisaword", "ქართული"]

    def brute(word, lang):
        @lru_cache(None)
        def total(i):
            if i == len(word):
                return 1.0
            out, single = 0.0, False
            for j in range(i + 1, len(word) + 1):
                if (p := vocabulary.index.get(word[i:j])) is not None:
                    out += prob[p, lang] * total(j)
                    single |= j == i + 1
            return out if single else out + 1e-9 * total(i + 1)

        return math.log(total(0))

    got = langid.word_scores(words, vocabulary, prob)
    for w, word in enumerate(words):
        for k in range(3):
            assert got[w, k] == pytest.approx(brute(vocabulary.MARK + word, k))
    counts = langid.expected_counts(words, np.ones(len(words)), vocabulary, prob[:, :1])
    letters = np.array([1] + [len(p) for p in vocabulary.index])  # expected pieces cover each word once
    assert (counts * letters).sum() == pytest.approx(sum(len(w) + 1 for w in words))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = langid.op7_language_id(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(docs):
    rows = [*ODD, (20, "the house and the garden", "en"), (21, "das haus und der garten", "de"), (22, "der hund und das kind", "de"), (23, "the dog and the child", "en"), (24, "12 !!", "en"), (25, "½ ² Ⅷ ①", "en"), (26, "\u0301\u093f", "en")]
    frame = docs(rows)
    model = langid.train(frame.filter("lang is not null and text is not null"))
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3, 24, 25, 26))
    assert got[21]["lang_pred"] == got[22]["lang_pred"] == "de" and got[20]["lang_pred"] == "en" and got[20]["ids"] == "x"
    assert langid.identify(docs([]), model).count() == 0
    none = langid.identify(docs([(1, "text")]), langid.train(frame.limit(0))).collect()
    assert none[0]["lang_pred"] == "und"


def test_long_runs_of_unknown_letters_stay_finite():
    import numpy as np

    from ledgerloom.llm import langid

    vocabulary = langid.Vocabulary.shared(langid.VOCABULARY)
    prob = np.full((vocabulary.size, 2), 1 / vocabulary.size)
    prob[0] = langid.UNKNOWN
    words = ["\U00010330" * 48, "hello"]
    scores = langid.word_scores(words, vocabulary, prob)
    assert np.isfinite(scores).all() and abs(scores[0, 0] - np.log(langid.UNKNOWN) * 48 - np.log(prob[1, 0])) < 20
    assert np.isfinite(langid.expected_counts(words, np.ones(2), vocabulary, prob[:, :1])).all()


def test_words_are_letters_and_their_marks():
    assert langid.words_of("हिन्दी में लिखा, x² ½ naïve e\u0301t") == ["हिन्दी", "में", "लिखा", "x", "naïve", "e\u0301t"]
    assert langid.words_of("Straße I've 3D") == ["straße", "i", "ve", "d"] and langid.words_of("½ ² ① \u0301") == []


def test_long_words_are_scored_whole():
    """As the short ones are, and with the same sum over segmentations at any length."""
    vocabulary = langid.Vocabulary.shared(langid.VOCABULARY)
    rng = np.random.default_rng(2)
    prob = rng.random((vocabulary.size, 3)) / 1000
    prob[0] = 1e-9
    for word in ("the", "thisisaword", "ქართული", "a" * langid.LONGEST):
        assert langid.long_word_score(word, vocabulary, prob) == pytest.approx(langid.word_scores([word], vocabulary, prob)[0])
    word = "donaudampfschifffahrtsgesellschaft" * 3
    marked, sums = vocabulary.MARK + word, [[1.0] * 3]
    for j in range(1, len(marked) + 1):  # in whole numbers of log, language by language
        found = [(i, vocabulary.index[marked[i:j]]) for i in range(j) if marked[i:j] in vocabulary.index]
        if not any(i == j - 1 for i, _ in found):
            found.append((j - 1, 0))
        sums.append([sum(sums[i][k] * prob[p, k] for i, p in found) for k in range(3)])
    mixed = langid.word_scores(["the", word, "a"], vocabulary, prob)
    assert mixed[1] == pytest.approx([math.log(x) for x in sums[-1]]) and mixed[0] == pytest.approx(langid.word_scores(["the"], vocabulary, prob)[0])
    assert np.isfinite(langid.word_scores(["\U00010330" * 20_000], vocabulary, prob)).all()
