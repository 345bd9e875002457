"""Trees of files over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import merkle
from ledgerloom.plans import proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
query = partial(proxies.query, into=(QUERIES, ORACLES))


def _document_files(documents: DataFrame) -> DataFrame:
    """A tree for each language: source/tens/doc_id.txt."""
    path = F.concat_ws("/", "source", (F.col("doc_id") % 10).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("lang", "doc_id", path.alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def _level(name: str, below: str, parent: str, child: str, kind: str) -> str:
    """A level of folders in SQL: parts by three digits of the names' hashes, then the folder."""
    return f"""{name}_p AS (SELECT lang, {parent} AS dir, substr(sha256({child}), 1, 3) AS part, sha256(string_agg('{kind}:' || d || ':' || {child}, chr(10) ORDER BY encode({child}))) AS pd, sum(n) AS n, sum(b) AS b FROM {below} GROUP BY ALL),
{name} AS (SELECT lang, dir, sha256(string_agg('part:' || pd || ':' || part, chr(10) ORDER BY part)) AS d, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b FROM {name}_p GROUP BY ALL)"""


@query(f"""WITH f AS (SELECT lang, source || '/' || (doc_id % 10) AS dir0, doc_id || '.txt' AS name, sha256(text) AS d, 1 AS n, octet_length(encode(text)) AS b FROM documents),
{_level("tens", "f", "dir0", "name", "file")}, {_level("sources", "(SELECT *, split_part(dir, '/', 1) AS up, split_part(dir, '/', 2) AS name FROM tens)", "up", "name", "folder")},
{_level("trees", "(SELECT *, dir AS name FROM sources)", "''", "name", "folder")}
SELECT lang AS tree, d AS digest, n AS n_files, b AS n_bytes FROM trees""", "documents")
def tree_roots(documents):
    """One digest for all documents of a language, through folders."""
    return merkle.roots(merkle.nodes(_document_files(documents), "lang", "path", "sha256", "size"))


@query("""WITH a AS (SELECT lang AS tree, source || '/' || (doc_id % 10) || '/' || doc_id || '.txt' AS path, sha256(text) AS d FROM documents WHERE doc_id % 103 <> 2),
b AS (SELECT lang AS tree, CASE WHEN doc_id % 107 = 3 THEN 'moved/' || doc_id ELSE source || '/' || (doc_id % 10) || '/' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 97 = 1 THEN sha256(text || '!') ELSE sha256(text) END AS d FROM documents WHERE doc_id % 101 <> 4)
SELECT coalesce(a.tree, b.tree) AS tree, coalesce(a.path, b.path) AS path, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS status, a.d AS before, b.d AS after
FROM a FULL JOIN b ON a.tree = b.tree AND a.path = b.path WHERE a.d IS DISTINCT FROM b.d""", "documents")
def tree_differences(documents):
    """Two states of the languages' trees: texts changed, files moved, gone and new."""
    files = _document_files(documents.filter("doc_id % 103 <> 2"))
    later = documents.filter("doc_id % 101 <> 4")
    changed = _document_files(later).withColumn("path", F.when(F.col("doc_id") % 107 == 3, F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))).otherwise(F.col("path")))
    texts = later.filter("doc_id % 97 = 1").select("doc_id", F.sha2(F.concat("text", F.lit("!")), 256).alias("new"))
    changed = changed.join(texts, "doc_id", "left").withColumn("sha256", F.coalesce("new", "sha256"))
    return merkle.differences(*(merkle.nodes(x, "lang", "path", "sha256") for x in (files, changed)))
