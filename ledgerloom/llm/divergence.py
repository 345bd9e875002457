"""How far the sources of a language differ in their terms, by sorted runs.

A task sorts the terms of a block of documents by (language, term, source, document) and scans the runs: a row for each
run of (language, term, source), with its number of documents and of occurrences. These partial rows are dealt to ranges
of (language, term, source, block) and sorted there; a scan over a range adds up what belongs together. A term whose
rows fill more than one range stays partial at the ranges' ends: only those ends are grouped once more. So the most
frequent term is split like any other rows.

Terms that enough documents of the language have are kept. A second scan, over ranges of (language, term), holds one
block of terms by sources at a time, and gives each range's part of the pairs' sums and each range's terms.

Probabilities are whole numbers of 1e-9, from counts with ADDED more for each kept term; all arithmetic is exact (64-bit
integers, Python's where counts are too large for them). What reaches the driver is a row for each language and source:
their square is part of the result, so that list is small beside it. A task holds that square of one language.

Defined results: a null text, language or source is ''; a row is a document, repeated rows too; a group without terms
counts none of each kept term; without kept terms all pairs differ by 0; a language with one source has no pairs; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.base import discard, parts_for, slices, staged, strings, table
from ledgerloom.llm.words import LETTERS, word_runs

#: A term is kept if so many documents of its language have it.
LEAST_DOCS = 30
ADDED = 5
UNIT = 1_000_000_000
#: Terms are listed up to this rank.
TOP = 50
#: Bytes of text that are sorted together.
BLOCK_BYTES = 24 << 20
#: Cells of terms by sources that a task holds at a time, about.
CELLS = 2_000_000

PARTIAL = "lang string, term string, source string, block long, docs long, n long"
TOTALS = "lang string, term string, source string, docs long, n long, edge boolean"
#: Stands for no term in rows that say that a group occurs; no term is empty.
NO_TERM = ""


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _block_runs(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """The runs of a block of documents, after sorting (language, term, source, document)."""
    runs, n = word_runs(batch.column("text"), LETTERS)
    terms = runs.dictionary_encode()
    langs, sources = (strings(batch.column(c)).dictionary_encode() for c in ("lang", "source"))
    row = np.repeat(np.arange(len(n)), n)
    code = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lang, source, term = code(langs), code(sources), code(terms)
    pairs, pair = np.unique(lang * len(sources.dictionary) + source, return_inverse=True)
    keys = (term * len(pairs) + pair[row]) * max(1, len(n)) + row
    keys.sort()
    first, docs_at = np.divmod(keys, max(1, len(n)))[0], _changes(keys)
    new = np.flatnonzero(_changes(first)) if len(keys) else np.zeros(0, np.int64)
    occurrences = np.diff(np.append(new, len(keys)))
    documents = np.add.reduceat(docs_at.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    of_term, of_pair = np.divmod(first[new], max(1, len(pairs)))
    groups, sizes = np.unique(pair, return_counts=True)
    of_pair, of_row = np.concatenate([of_pair, groups]), np.concatenate([of_term, np.zeros(len(groups), np.int64)])
    which = pairs[of_pair]
    names = terms.dictionary.take(pa.array(of_row[: len(new)])).cast(pa.string())
    return pa.record_batch(
        [
            langs.dictionary.take(pa.array(which // len(sources.dictionary))).cast(pa.string()), pa.concat_arrays([names, pa.array([NO_TERM] * len(groups), pa.string())]),
            sources.dictionary.take(pa.array(which % len(sources.dictionary))).cast(pa.string()), pa.array(np.full(len(which), block)),
            pa.array(np.concatenate([documents, sizes])), pa.array(np.concatenate([occurrences, np.zeros(len(groups), np.int64)])),
        ],
        [c.split()[0] for c in PARTIAL.split(", ")],
    )


def partial_runs(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, term, source, block, docs, n) of each block of documents, and a row with NO_TERM for each of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), count()
        held, size = [], 0
        for batch in slices(batches, "text", block_bytes):
            if held and size + batch.nbytes > block_bytes:
                yield _block_runs(pa.Table.from_batches(held).combine_chunks().to_batches()[0], (task << 32) + next(made))
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield _block_runs(pa.Table.from_batches(held).combine_chunks().to_batches()[0], (task << 32) + next(made))

    return docs.select("lang", "source", "text").mapInArrow(run, PARTIAL)


def _sorted_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Sorted rows cut only where `columns` change, and whether more may follow; a group is in one part, whatever the
    batches are."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in columns]
        same = np.ones(batch.num_rows, bool)
        for c, v in zip(columns, last, strict=True):
            same &= pc.equal(batch.column(c), v).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))
        before = batch.slice(0, cut)
        if rest and (cut or any(rest[-1].column(c)[0].as_py() != v for c, v in zip(columns, last, strict=True))):
            yield pa.Table.from_batches([*rest, before]).combine_chunks().to_batches()[0], True
            rest = []
        elif cut:
            yield before, True
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0], False


def _codes(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _added_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted rows with equal (lang, term, source) as one."""
    new = np.flatnonzero(_changes(_codes(batch, "lang"), _codes(batch, "term"), _codes(batch, "source")))
    first = batch.take(pa.array(new))
    sums = [pa.array(np.add.reduceat(batch.column(c).to_numpy(), new)) for c in ("docs", "n")]
    return pa.record_batch([*(first.column(c) for c in ("lang", "term", "source")), *sums], ["lang", "term", "source", "docs", "n"])


def _with_df(rows: pa.RecordBatch) -> np.ndarray:
    """For each row the documents of its (lang, term)."""
    new = _changes(_codes(rows, "lang"), _codes(rows, "term"))
    return np.add.reduceat(rows.column("docs").to_numpy(), np.flatnonzero(new))[np.cumsum(new) - 1]


def term_totals(partial: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, docs, n) of all kept terms, and NO_TERM with every group's documents.

    A range's first and last terms may go on in other ranges; they are marked, and added up with each other.
    """
    parts = parts_for(partial)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last term so far; it is an end if nothing follows
        first = True

        def out(rows: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
            keep = np.ones(rows.num_rows, bool) if edge else (_with_df(rows) >= least_docs)
            keep |= pc.equal(rows.column("term"), NO_TERM).to_numpy(zero_copy_only=False)
            rows = rows.filter(pa.array(keep))
            return pa.record_batch([*rows.columns, pa.array(np.full(rows.num_rows, edge))], [c.split()[0] for c in TOTALS.split(", ")])

        for part, _ in _sorted_groups(batches, ["lang", "term"]):
            rows = _added_runs(part)
            if waiting is not None:
                yield out(waiting, first)
                first, waiting = False, None
            new = np.flatnonzero(_changes(_codes(rows, "lang"), _codes(rows, "term")))
            if first and len(new) > 1:
                yield out(rows.slice(0, new[1]), True)
                rows, new, first = rows.slice(new[1]), new[1:] - new[1], False
            yield out(rows.slice(0, new[-1]), False)
            waiting = rows.slice(new[-1])
        if waiting is not None:
            yield out(waiting, True)

    order = ["lang", "term", "source", "block"]
    found = staged(partial.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(scan, TOTALS), "divergence-totals")
    ends = found.filter("edge").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    ends = ends.withColumn("df", F.sum("docs").over(Window.partitionBy("lang", "term"))).filter((F.col("df") >= least_docs) | (F.col("term") == NO_TERM)).drop("df")
    return found.filter("not edge").drop("edge").unionByName(ends)


def probability(n: np.ndarray, total, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)); total may have a value for each n's last axis."""
    most = (2**63 - 1) // UNIT - ADDED
    if n.size and int(n.max()) > most or np.max(total, initial=0) > 2**62:
        whole = (n.astype(object) + ADDED) * UNIT // (np.asarray(total, object) + ADDED * kept) + 1
        return whole.astype(np.int64)
    return (n + ADDED) * UNIT // (np.asarray(total) + ADDED * kept) + 1


class Groups:
    """The sources of each language, in order, with their counts of kept terms, and how many terms the language keeps."""

    def __init__(self, rows: list) -> None:
        self.sources: dict[str, list[str]] = {}
        self.totals: dict[str, np.ndarray] = {}
        self.kept: dict[str, int] = {}
        by_lang: dict[str, list] = {}
        for r in rows:
            by_lang.setdefault(r["lang"], []).append(r)
        for lang, found in by_lang.items():
            found.sort(key=lambda r: r["source"].encode())
            self.sources[lang] = [r["source"] for r in found]
            self.totals[lang] = np.array([r["n"] for r in found], np.int64)
            self.kept[lang] = max(r["kept"] for r in found)


def _matrix_parts(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """(language, terms, counts by source) of sorted rows, some terms at a time."""
    place = {lang: {s: i for i, s in enumerate(names)} for lang, names in groups.sources.items()}
    for part, _ in _sorted_groups(batches, ["lang", "term"]):
        langs = _changes(_codes(part, "lang"))
        cuts = np.append(np.flatnonzero(langs), part.num_rows)
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = part.slice(a, b - a)
            lang = rows.column("lang")[0].as_py()
            at = place[lang]
            coded = rows.column("source").dictionary_encode()
            source = np.array([at[s] for s in coded.dictionary.to_pylist()])[coded.indices.to_numpy(zero_copy_only=False)]
            new = np.flatnonzero(_changes(_codes(rows, "term")))
            term = np.repeat(np.arange(len(new)), np.diff(np.append(new, rows.num_rows)))
            names = rows.column("term").take(pa.array(new)).to_pylist()
            n = rows.column("n").to_numpy()
            step = max(1, CELLS // len(at))
            for t in range(0, len(new), step):
                inside = (term >= t) & (term < t + step)
                counts = np.zeros((min(step, len(new) - t), len(at)), np.int64)
                counts[term[inside] - t, source[inside]] = n[inside]
                yield lang, names[t : t + step], counts


PARTS = "lang string, source string, part string, item string, value long"


def compare(totals: DataFrame, groups: Groups) -> DataFrame:
    """(lang, source, part, item, value): parts of the pairs' sums, and each group's terms that are likelier in it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for lang, names, counts in _matrix_parts(batches, groups):
            sources, total, kept = groups.sources[lang], groups.totals[lang], groups.kept[lang]
            p, q = probability(counts, total, kept), probability(counts.sum(1), total.sum(), kept)
            mine = sums.setdefault(lang, np.zeros((len(sources), len(sources)), np.int64))
            for a in range(len(sources) - 1):
                mine[a, a + 1 :] += np.abs(p[:, a + 1 :] - p[:, a : a + 1]).sum(0)
            above = (counts > 0) & (p > q[:, None])
            term, source = np.nonzero(above)
            if len(term):
                value = p[term, source] - q[term]
                yield rows(lang, pa.array(sources, pa.string()).take(pa.array(source)), "term", pa.array(names, pa.string()).take(pa.array(term)), value)
        for lang, mine in sums.items():
            a, b = np.nonzero(mine)
            names = pa.array(groups.sources[lang], pa.string())
            yield rows(lang, names.take(pa.array(np.concatenate([a, b]))), "pair", names.take(pa.array(np.concatenate([b, a]))), np.tile(mine[a, b], 2))

    def rows(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        n = len(source)
        return pa.record_batch([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value)], [c.split()[0] for c in PARTS.split(", ")])

    return totals.mapInArrow(scan, PARTS)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text)."""
    partial = staged(partial_runs(docs, block_bytes), "divergence-runs")
    totals = staged(term_totals(partial, least_docs), "divergence-terms")
    discard(partial)
    per_group = totals.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = totals.filter(F.col("term") != NO_TERM).groupBy("lang").agg(F.countDistinct("term").alias("kept"))
    named = per_group.join(per_lang, "lang", "left").na.fill(0, ["kept"])
    groups = Groups(named.collect())
    order = ["lang", "term"]
    kept = totals.filter(F.col("term") != NO_TERM).select("lang", "term", "source", "n").repartitionByRange(parts_for(totals), *order).sortWithinPartitions(*order)
    found = staged(compare(kept, groups), "divergence-parts")
    by_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= top)
    each = per_group.select("lang", "source")
    pairs = each.join(each.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(by_group)).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents", least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = lambda n, total: f"(1 + ({UNIT} * CAST({n} + {ADDED} AS HUGEINT)) // ({total} + {ADDED} * v))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
t AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "g.total")} AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, {p("sum(n)", "any_value(all_n)").replace(" * v)", " * any_value(v))")} AS q FROM c JOIN (SELECT lang, sum(total) AS all_n, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM t a JOIN t b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
      UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
      UNION ALL SELECT lang, source, 'term', term, p - q FROM t JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM f
QUALIFY part = 'pair' OR rank <= {top}"""
