"""The catalogue: a view that can be rebuilt, and searches in it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import latest

#: Payloads of up to this size together are held by each task.
PAYLOAD_BYTES = 16 << 20


def search(df: DataFrame, text: str, words: str, k: int, order: list[Column]) -> DataFrame:
    """The first k rows whose text contains the words, regardless of case; order must end in a unique column."""
    return df.filter(F.contains(F.lower(F.col(text)), F.lit(words.lower()))).orderBy(*order).limit(k)


def build(revisions: DataFrame, decisions: DataFrame) -> DataFrame:
    """revisions (asset_id, revision, sha256, status) and decisions (asset_id, decision_seq, field, value): the current
    revision of each asset with its effective decisions as a map. Stale revisions don't show."""
    now = latest(revisions, ["asset_id"], ["revision"])
    chosen = latest(decisions, ["asset_id", "field"], ["decision_seq"]).groupBy("asset_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("decided"))
    return now.join(chosen, "asset_id", "left")


def payload_containment(df: DataFrame, text: str, payloads: DataFrame, payload: str, most_bytes: int = PAYLOAD_BYTES) -> DataFrame:
    """Rows that contain a known payload. Payloads of up to most_bytes together become one automaton, which reads each
    text once; more than that are joined."""
    known = payloads.select(F.col(payload).cast("string").alias("_p")).filter(F.length("_p") > 0).distinct()
    if (known.agg(F.sum(F.octet_length("_p"))).first()[0] or 0) > most_bytes:
        return df.join(known, F.contains(F.col(text), F.col("_p")), "left_semi")
    words = [r["_p"] for r in known.collect()]  # of that size at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in words:
            found.add_word(w)
        found.make_automaton()
        has = lambda t: bool(words) and t is not None and next(found.iter(t), None) is not None
        for batch in batches:
            yield batch.filter(pa.array([has(t) for t in batch.column(text).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
