"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is
the sum over all its segmentations into pieces, which a forward algorithm gives; no piece reaches over a word, so a
text's is the product over its words. Piece probabilities are learned by expectation-maximisation over the words of
labelled documents, with the forward-backward algorithm.

Only a bounded sample of labelled documents is learned from: whole documents, chosen by a hash of the id, about
SAMPLE of each language. Everything else covers all rows and whole texts.

Words are runs of letters (Unicode's category L), with the marks that follow them; numbers such as ½ or ² aren't letters.

Defined results: und with score 0 if the text is null or has no letter, or if nothing could be learned; a word of any
length is scored whole, by a state that is rescaled on its way (words over LONGEST letters teach nothing); repeated rows are scored alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.base import slices, staged, table, texts

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Labelled documents of each language that the model learns from, about.
SAMPLE = 1500
ROUNDS = 2
#: Counts added to each piece, and the probability of a letter that no piece has.
ADDED, UNKNOWN = 0.05, 1e-9
LONGEST = 48
#: Sums over segmentations are kept times two to so many for each letter.
SCALE_BITS = 13
CACHE_WORDS = 300_000
#: Words where no character is RARE, and words of any text.
LETTERS = re.compile(r"[^\W\d_]+")
RARE = regex.compile(r"[\p{M}\p{Nl}\p{No}]")
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PIECE = regex.compile(r"[\p{L}\p{M}]+")
UNDETERMINED = "und"


class Vocabulary:
    """Pieces of letters; one at a word's begin starts with a mark."""

    MARK = "▁"
    _made: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i).lower() for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        pieces = sorted({p for p in found if PIECE.fullmatch(p.removeprefix(self.MARK)) or p == self.MARK})
        self.index = {p: i + 1 for i, p in enumerate(pieces)}  # 0: an unknown letter
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def shared(cls, path: str) -> Vocabulary:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows (end, word, begin, piece), sorted, of all pieces in the marked words; and the words' lengths."""
        out: list[int] = []
        index, longest = self.index, self.longest
        for w, word in enumerate(words):
            n = len(word)
            for i in range(n):
                single = False
                for j in range(i + 1, min(n, i + longest) + 1):
                    if (p := index.get(word[i:j])) is not None:
                        out += (j, w, i, p)
                        single |= j == i + 1
                if not single:
                    out += (i + 1, w, i, 0)
        rows = np.array(out, np.int32).reshape(-1, 4)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))], np.fromiter(map(len, words), np.int64, len(words))


def words_of(text: str) -> list[str]:
    lowered = text.lower()
    return (LETTERS if lowered.isascii() or not RARE.search(lowered) else WORDS).findall(lowered)


def _scale(rows: np.ndarray) -> np.ndarray:
    """Each letter's factor, so that LONGEST unknown letters stay above the least double."""
    return np.ldexp(1.0, SCALE_BITS * (rows[:, 0] - rows[:, 2]))[:, None]


def _sweep(state: np.ndarray, rows: np.ndarray, key: int, source: int, prob: np.ndarray) -> None:
    """state[word, rows.key] += state[word, rows.source] * prob[piece] for rows of one key value, sorted by word."""
    w = rows[:, 1]
    add = state[w, rows[:, source]] * prob[rows[:, 3]] * _scale(rows)
    first = np.flatnonzero(np.concatenate([[True], np.diff(w) != 0]))
    state[w[first], rows[0, key]] += np.add.reduceat(add, first, axis=0)


def forward(words: list[str], vocabulary: Vocabulary, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State (word, place, language) of the sums over segmentations up to a place; the edges; the lengths."""
    rows, n = vocabulary.edges([vocabulary.MARK + w for w in words])
    alpha = np.zeros((len(words), int(n.max()) + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
        _sweep(alpha, part, 0, 2, prob)
    return alpha, rows, n


def word_scores(words: list[str], vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    long = [k for k, w in enumerate(words) if len(w) > LONGEST]
    if long:
        out = np.empty((len(words), prob.shape[1]))
        short = np.setdiff1d(np.arange(len(words)), long)
        if len(short):
            out[short] = word_scores([words[k] for k in short], vocabulary, prob)
        out[long] = [long_word_score(words[k], vocabulary, prob) for k in long]
        return out
    alpha, _, n = forward(words, vocabulary, prob)
    return np.log(alpha[np.arange(len(words)), n]) - (n * SCALE_BITS * np.log(2))[:, None]


def long_word_score(word: str, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """The same of one word of any length: only the sums up to the last places are held, and multiplied as they shrink."""
    marked, index, most = vocabulary.MARK + word, vocabulary.index, vocabulary.longest
    last = np.zeros((most + 1, prob.shape[1]))  # sums up to place j are in row j % (most + 1)
    last[0] = 1
    factor = np.zeros(prob.shape[1])
    for j in range(1, len(marked) + 1):
        pieces = [(i, p) for i in range(max(0, j - most), j) if (p := index.get(marked[i:j])) is not None]
        if not pieces or pieces[-1][0] != j - 1:
            pieces.append((j - 1, 0))
        at = np.array(pieces)
        now = (last[at[:, 0] % (most + 1)] * prob[at[:, 1]]).sum(axis=0)
        last[j % (most + 1)] = now
        small = now < 1e-100
        if small.any():
            up = np.where(small, 1e100, 1.0)
            last *= up
            factor += np.log(up)
    return np.log(last[len(marked) % (most + 1)]) - factor


def expected_counts(words: list[str], weights: np.ndarray, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Pieces expected in the words' segmentations; prob and the result have one column."""
    alpha, rows, n = forward(words, vocabulary, prob)
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), n] = 1
    back = rows[np.lexsort((rows[:, 1], -rows[:, 2]))]
    for part in np.split(back, np.flatnonzero(np.diff(back[:, 2])) + 1):
        _sweep(beta, part, 2, 0, prob)
    total = alpha[np.arange(len(words)), n]
    w = rows[:, 1]
    share = alpha[w, rows[:, 2]] * prob[rows[:, 3]] * _scale(rows) * beta[w, rows[:, 0]] / total[w] * weights[w][:, None]
    return np.bincount(rows[:, 3], share[:, 0], vocabulary.size)


class Model:
    def __init__(self, path: str, languages: list[str], prior: np.ndarray, prob: np.ndarray) -> None:
        self.path, self.languages, self.prior, self.prob = path, languages, prior, prob.astype(np.float32)


def _sampled(labelled: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """Whole documents by a hash of the id, about `sample` of a language; a row for each language reaches the driver."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    limit: Column = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample / n) * (1 << 30)))).otherwise(limit)
    return labelled.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < limit), sizes


def train(labelled: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """labelled: (doc_id, text, lang), lang not null."""
    chosen, sizes = _sampled(labelled, sample)
    languages = sorted(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                found.setdefault(lang, Counter()).update(w for w in words_of(text) if len(w) <= LONGEST)
            if sum(map(len, found.values())) > 200_000:
                yield from rows(found)
                found = {}
        yield from rows(found)

    def rows(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, n in found.items():
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    words = staged(chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    vocabulary = Vocabulary.shared(path)
    prob = np.full((vocabulary.size, len(languages)), 1 / vocabulary.size)
    prob[0] = UNKNOWN
    for _ in range(rounds):
        seen = _expect(words, path, languages, prob)
        prob = seen + ADDED
        prob /= prob.sum(axis=0)
        prob[0] = UNKNOWN
    prior = np.array([sizes[x] for x in languages], np.float64)
    return Model(path, languages, np.log(prior / prior.sum()) if len(languages) else prior, prob)


def _expect(words: DataFrame, path: str, languages: list[str], prob: np.ndarray) -> np.ndarray:
    """Expected counts; a row for each language and piece at most reaches the driver."""
    prob32 = prob.astype(np.float32)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.shared(path)
        total = np.zeros((len(languages), vocabulary.size))
        for batch in batches:
            langs, items, n = (batch.column(k).to_pylist() for k in ("lang", "word", "n"))
            for k, lang in enumerate(languages):
                at = [i for i, x in enumerate(langs) if x == lang]
                for a in range(0, len(at), 4000):
                    part = at[a : a + 4000]
                    total[k] += expected_counts([items[i] for i in part], np.array([n[i] for i in part], float), vocabulary, prob32[:, k : k + 1].astype(np.float64))
        lang, piece = np.nonzero(total)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])], ["lang", "piece", "n"])

    out = np.zeros_like(prob)
    for r in words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"], r["lang"]] = r["n"]
    return out


class Scorer:
    """A worker's model with the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.vocabulary = model, Vocabulary.shared(model.path)
        self.prob = model.prob.astype(np.float64)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((CACHE_WORDS, len(model.languages)), np.float32)

    def _learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 4000):
            part = words[a : a + 4000]
            at = len(self.place)
            self.scores[at : at + len(part)] = word_scores(part, self.vocabulary, self.prob)
            self.place.update(zip(part, range(at, at + len(part)), strict=True))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its number of words."""
        found = [words_of(t) for t in texts]
        total = np.zeros((len(texts), len(self.model.languages)))
        n = np.zeros(len(texts), np.int64)
        for k, words in enumerate(found):
            n[k] = len(words)
            for a in range(0, len(words), CACHE_WORDS // 2):
                part = words[a : a + CACHE_WORDS // 2]
                try:
                    at = list(map(self.place.__getitem__, part))
                except KeyError:
                    new = self._unknown(found, k, part)
                    if len(self.place) + len(new) > CACHE_WORDS:
                        self.place.clear()
                        new = list(set(part))
                    self._learn(new)
                    at = list(map(self.place.__getitem__, part))
                total[k] += self.scores[at].sum(axis=0, dtype=np.float64)
        return total, n

    def _unknown(self, found: list[list[str]], k: int, part: list[str]) -> list[str]:
        """New words of this text, and of the next ones so that they are scored together."""
        new = set(part).difference(self.place)
        for words in found[k + 1 :]:
            if len(new) > 4000 or len(words) > 50_000:
                break
            new.update(set(words).difference(self.place))
        return list(new)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(*docs, lang_pred, score) of docs' rows; looks at the text only. docs must have a column text;
    its own lang_pred and score are replaced."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.languages else None
        for batch in slices(batches, "text"):
            langs: list[str] = [UNDETERMINED] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            if scorer:
                total, n = scorer.totals(texts(batch))
                total += model.prior
                best = total.argmax(axis=1)
                odds = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                scores = np.where(n > 0, odds, 0.0)
                langs = [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), n.tolist(), strict=True)]
            yield pa.record_batch([*(batch.column(i) for i in range(len(names))), pa.array(langs, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)


def held_out(fold: int = 4, held: int = 2) -> Column:
    """The fold by the id's digits; a null id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
