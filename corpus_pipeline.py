"""Documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents. A stage
works on all rows that its predecessor kept. Rows with one doc_id and one text are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, mixing, packing, simhash, substrings
from ledgerloom.llm.base import staged, table

#: A document's language must be this probable.
LEAST_SCORE = 0.5
#: The mixture reads this part of the tokens that are left, each document once at most.
BUDGET, EPOCHS = (19, 20), 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or no probable language."""
    labelled = docs.filter(~langid.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = langid.train(labelled.select("doc_id", "text", "lang"))
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = langid.identify(docs.withColumnsRenamed(own), model)
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the least id, of several with that id the one with the least hash of
    its text. Documents without an id come last and are told apart by their texts."""
    found = simhash.labelled(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("f")).select(F.col("f.doc_id").alias("_doc"), F.col("f.same").alias("_text"))
    rows = docs.withColumn("_ledgerloom_text", F.xxhash64("text"))
    kept = rows.join(first, (F.col("doc_id").cast("long").eqNullSafe(F.col("_doc"))) & (F.col("_ledgerloom_text") == F.col("_text")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_ledgerloom_text"]).drop("_ledgerloom_text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has."""
    return substrings.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture reads."""
    return mixing.mix_documents(docs, BUDGET, EPOCHS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of a document in the packed sequences."""
    return packing.pack_documents(docs)[1]


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]
#: XXH64, tokenizers and learned models aren't to be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
