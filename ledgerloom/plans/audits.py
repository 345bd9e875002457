"""Audits over the driver's tables, each with the SQL that gives the same rows. Documents are assets, sources archives."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import coverage, independence
from ledgerloom.plans import proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
query = partial(proxies.query, into=(QUERIES, ORACLES))

#: Of a class of files: which documents have one, which of these are lost, and which came out different.
_HAS = {"media": "true", "xmp": "doc_id % 29 <> 3", "unknown": "doc_id % 5 = 1", "blob": "doc_id % 7 = 2"}
_LOST = {"media": "doc_id % 41 = 5", "xmp": "doc_id % 37 = 6", "unknown": "doc_id % 15 = 1", "blob": "doc_id % 28 = 9"}
_OTHER = {"media": "doc_id % 43 = 7", "xmp": "doc_id % 47 = 8", "unknown": "doc_id % 35 = 6", "blob": "doc_id % 49 = 16"}


def _evidence(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected files of each document, and what an audit found."""
    base = documents.select("doc_id", F.sha2("text", 256).alias("t"))
    kinds = [(k, F.concat_ws("/", F.lit(k), F.col("doc_id").cast("string")), F.sha2(F.concat(F.lit(k), "t"), 256)) for k in coverage.CLASSES]
    expected = [base.filter(_HAS[k]).select(F.col("doc_id").alias("asset_id"), F.lit(k).alias("kind"), path.alias("path"), d.alias("sha256")) for k, path, d in kinds]
    found = [base.filter(_HAS[k]).filter(f"not ({_LOST[k]})").select(path.alias("path"), F.when(F.expr(_OTHER[k]), F.sha2(d, 256)).otherwise(d).alias("sha256")) for k, path, d in kinds]
    return reduce(DataFrame.unionByName, expected), reduce(DataFrame.unionByName, found)


_BITS = "SELECT doc_id AS asset_id, source, " + ", ".join(f"({_HAS[k]}) AS e_{k}, ({_HAS[k]}) AND NOT ({_LOST[k]}) AND NOT ({_OTHER[k]}) AS v_{k}" for k in coverage.CLASSES) + " FROM documents"
_SUM = {x: " + ".join(f"{b} * CAST({x}_{k} AS INT)" for k, b in coverage.BITS.items()) for x in "ev"}
_LACKING = "list_filter([" + ", ".join(f"CASE WHEN {'true' if k in coverage.REQUIRED else f'e_{k}'} AND NOT v_{k} THEN '{k}' END" for k in coverage.CLASSES) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT asset_id, {_SUM['e']} AS expected, {_SUM['v']} AS verified, array_to_string({_LACKING}, ',') AS lacking, len({_LACKING}) = 0 AS covered FROM ({_BITS})", "documents")
def audit_coverage(documents):
    """Which classes of files the audit covers, for each document."""
    return coverage.coverage(coverage.item_states(*_evidence(documents))).withColumn("lacking", F.array_join("lacking", ","))


_FORMAT = "CASE CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 5 WHEN 1 THEN 'other.archive' WHEN 2 THEN NULL ELSE 'ledgerloom.archive' END"
_VERSION = "CASE CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 5 WHEN 3 THEN 2 WHEN 2 THEN NULL ELSE 1 END"


@query(f"""WITH b AS ({_BITS}), c AS (SELECT b.*, len({_LACKING}) = 0 AS covered, coalesce(quality, -1) = 1 AS good FROM b LEFT JOIN labels ON doc_id = asset_id),
g AS (SELECT source, bool_and(covered OR asset_id % 2 = 0) AS covered, bool_and(good OR asset_id % 3 > 0) AS validated, coalesce({_FORMAT} = 'ledgerloom.archive' AND {_VERSION} = 1, false) AS format FROM c GROUP BY source)
SELECT source, covered, validated, format, array_to_string(list_filter([CASE WHEN NOT covered THEN 'covered' END, CASE WHEN NOT validated THEN 'validated' END, CASE WHEN NOT format THEN 'format' END], lambda x: x IS NOT NULL), ',') AS blockers,
 covered AND validated AND format AS ready FROM g""", "documents", "labels")
def migration_verdicts(documents, labels):
    """Each source: coverage of its odd documents, validation of each third, and a supported format."""
    covered = coverage.coverage(coverage.item_states(*_evidence(documents))).select(F.col("asset_id").alias("doc_id"), "covered")
    status = F.when((F.col("doc_id") % 3 > 0) | (F.col("quality") == 1), "passed").when(F.col("quality").isNull(), "unavailable").otherwise("failed")
    rows = documents.select("doc_id", "source").join(covered, "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    assets = rows.select("source", (F.col("covered") | (F.col("doc_id") % 2 == 0)).alias("covered"), status.alias("status"), F.lit("structure-walk").alias("validator"), F.lit("1").alias("version"))
    archives = documents.select("source").distinct().select("source", F.expr(_FORMAT).alias("format"), F.expr(_VERSION).alias("format_version"))
    return coverage.verify_migration(assets, archives, "source").withColumn("blockers", F.array_join("blockers", ","))


@query("""SELECT min(c_custkey) AS class_id, count(*) AS n_copies, count(DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 12 END) AS n_volumes, bool_or(c_custkey % 3 = 0 AND c_custkey % 5 < 3) AS proven
 FROM customer GROUP BY c_custkey // 12""", "customer")
def copy_class_summary(customer):
    """Copies in threes by their path, and threes in fours by a volume."""
    key = F.col("c_custkey")
    path, volume = F.concat(F.lit("p"), F.floor(key / 3).cast("string")), F.when(key % 3 == 0, F.concat(F.lit("v"), F.floor(key / 12).cast("string")))
    copies = customer.select(key.alias("copy_id"), path.alias("path"), volume.alias("volume_id"), (key % 5 < 3).alias("confirmed"))
    return independence.class_summary(independence.copy_classes(copies))
