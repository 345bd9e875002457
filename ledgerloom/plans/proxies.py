"""The reference operators applied to the driver's tables: one query each, with the SQL that gives the same rows.

Reading of the tables: documents are items, labels their validation, orders and lineitem objects and records, events a
ledger, a document's source its part of the export.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, digests, names, states
from ledgerloom.operators import catalogue, gates, identity, integrity, ledger, pairing, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str, *tables: str, into: tuple[dict, dict] = (QUERIES, ORACLES)):
    """Registers a function of these tables under its name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        into[0][f.__name__] = lambda spark, sf_dir: f(*(_read(spark, sf_dir, t) for t in tables))
        into[1][f.__name__] = sql
        return f

    return add


def sha() -> Column:
    return digests.content_digest(F.col("text"))


def source_number() -> Column:
    return F.regexp_extract("source", r"(\d+)", 1).try_cast("int")


@query("SELECT sha256(text) AS sha256, count(*) AS n, count(DISTINCT source) AS n_sources, min(doc_id) AS first_id FROM documents GROUP BY 1", "documents")
def content_identity(documents):
    return identity.content_groups(documents, sha(), "source", "doc_id")


@query("SELECT sha256(text) AS sha256, count(*) AS n, count(DISTINCT source) AS n_sources, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", "documents")
def exact_duplicates(documents):
    return identity.duplicates(identity.content_groups(documents, sha(), "source", "doc_id"))


@query("SELECT sha256(text) AS sha256, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1", "documents")
def canonical_pick(documents):
    return identity.canonical(documents.select("doc_id", "source", sha().alias("_d")), F.col("_d"), "doc_id").drop("_d")


@query("SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^m\\.', '') AS identity, count(*) AS n, count(DISTINCT url) AS n_hints, count(DISTINCT url) > 1 AS review FROM pages GROUP BY 1", "pages")
def url_identity(pages):
    host = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), r"^m\.", "")
    return identity.hint_multiplicity(pages, host, "url")


STATUS = "CASE WHEN l.quality IS NULL THEN 'unavailable' WHEN l.quality = 1 THEN 'passed' ELSE 'failed' END"


def validated(documents, labels):
    return documents.join(labels, "doc_id", "left").withColumn("status", states.validation_status(F.col("quality")))


@query(f"SELECT d.lang AS lang, {STATUS} AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2", "documents", "labels")
def validation_counts(documents, labels):
    return validated(documents, labels).groupBy("lang", "status").agg(F.count("*").alias("n"))


@query(f"SELECT d.source AS source, count(*) AS n, CAST(sum(CASE WHEN {STATUS} <> 'passed' THEN 1 ELSE 0 END) AS BIGINT) AS blockers, bool_and({STATUS} = 'passed') AS ready FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1", "documents", "labels")
def retirement_gate(documents, labels):
    passed = F.col("status") == states.PASSED
    found = gates.readiness(validated(documents, labels), ["source"], {"validated": passed}, others=(F.count_if(~passed).alias("n_blockers"),))
    return found.select("source", "n", F.col("n_blockers").alias("blockers"), "ready")


@query(f"SELECT d.lang AS lang, {STATUS} AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (1, 2)", "documents", "labels")
def validation_rollup(documents, labels):
    return validated(documents, labels).rollup("lang", "status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "orders", "lineitem")
def orphan_objects(orders, lineitem):
    return integrity.orphans(orders.select("o_orderkey", "o_custkey"), lineitem, [("o_orderkey", "l_orderkey")])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')", "lineitem", "orders")
def dangling_records(lineitem, orders):
    return integrity.dangling(lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), orders.filter("o_orderstatus <> 'P'"), [("l_orderkey", "o_orderkey")])


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n_values, count(*) AS n_records FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1", "lineitem")
def binding_conflicts(lineitem):
    return integrity.binding_conflicts(lineitem, ["l_orderkey", "l_linenumber"], "l_partkey")


MIRROR = """m AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size, sha256(text) AS sha, source FROM documents),
d AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size, CASE WHEN doc_id % 53 = 0 THEN 'corrupt' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 17 <> 0
      UNION ALL SELECT 'x' || CAST(doc_id AS VARCHAR), n_chars, sha256(text) FROM documents WHERE doc_id % 97 = 0),
s AS (SELECT coalesce(m.path, d.path) AS path, m.source AS source, CASE WHEN m.path IS NULL THEN 'extra' WHEN d.path IS NULL THEN 'missing' WHEN m.size = d.size AND m.sha = d.sha THEN 'reused' ELSE 'conflict' END AS status FROM m FULL OUTER JOIN d ON m.path = d.path)"""


def mirror(documents):
    """A manifest, and a destination with gaps, corrupt and extra objects."""
    m = documents.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), sha().alias("sha256"), "source", "doc_id")
    d = m.filter("doc_id % 17 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 53 == 0, "corrupt").otherwise(F.col("sha256")))
    extra = m.filter("doc_id % 97 = 0").withColumn("path", F.concat(F.lit("x"), "path"))
    return m, d.unionByName(extra)


@query(f"WITH {MIRROR} SELECT path, status FROM s", "documents")
def mirror_reconcile(documents):
    return integrity.reconcile(*mirror(documents))


@query(f"WITH {MIRROR} SELECT source, path FROM s WHERE status = 'missing' AND source NOT IN (SELECT source FROM s WHERE status = 'conflict')", "documents")
def mirror_preflight(documents):
    m, d = mirror(documents)
    plan = integrity.reconcile(m, d).join(m.select("path", "source"), "path")
    blocked = plan.filter(F.col("status") == integrity.CONFLICT).select("source").distinct()
    return plan.filter(F.col("status") == integrity.MISSING).join(blocked, "source", "left_anti").select("source", "path")


@query(f"WITH {MIRROR} SELECT CAST(count_if(status = 'missing') AS BIGINT) AS copied, CAST(count_if(status = 'reused') AS BIGINT) AS reused, CAST(count_if(status <> 'extra') AS BIGINT) AS total, CAST(count_if(status = 'conflict') AS BIGINT) AS conflicts FROM s", "documents")
def mirror_counts(documents):
    return integrity.mirror_counts(integrity.reconcile(*mirror(documents))).select("copied", "reused", "total", "conflicts")


@query("SELECT source, count(*) AS n_files, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), ';' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1", "documents")
def tree_digest(documents):
    return integrity.tree_digests(documents.select("source", "doc_id", sha().alias("sha256")), "source", "doc_id", "sha256")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1", "events")
def revision_latest(events):
    return ledger.latest(events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_id, event_type, n - 1 AS n_prior FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = 1", "events")
def decision_history(events):
    return ledger.effective(events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT p.user_id AS user_id, p.event_id AS event_id, s.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts", "events")
def asof_decision(events):
    p = events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    s = events.filter("event_type = 'signup'").select("user_id", "event_id", "ts")
    return ledger.as_of(p, s, ["user_id"], "ts", "ts", ["event_id"], "event_id").select("user_id", "event_id", "asof_event_id")


@query("SELECT sha256(text) AS sha256, count(DISTINCT source) AS n_values, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS agreed, count(DISTINCT source) > 1 AS disputed FROM documents GROUP BY 1", "documents")
def field_consensus(documents):
    return identity.field_consensus(documents, sha(), "source")


@query("SELECT event_id, user_id, event_type, value, previous FROM (SELECT *, lag(value) OVER w AS previous, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE k > 1 AND value IS DISTINCT FROM previous", "events")
def metadata_evolution(events):
    return ledger.changes(events.select("event_id", "user_id", "event_type", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"], "value").drop("ts")


@query("SELECT conv_id, turn, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", "conversations")
def neighbor_evidence(conversations):
    return ledger.neighbours(conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role").drop("role")


@query("SELECT o_orderkey, 'Photos/' || strftime(o_orderdate, '%Y/%m - %B') AS folder FROM orders", "orders")
def placement_folder(orders):
    return orders.select("o_orderkey", dates.folder(F.col("o_orderdate")).alias("folder"))


@query("SELECT l_orderkey, CASE WHEN date_trunc('month', min(l_shipdate)) = date_trunc('month', max(l_shipdate)) THEN 'Photos/' || strftime(min(l_shipdate), '%Y/%m - %B') ELSE '_Needs Placement' END AS folder FROM lineitem GROUP BY 1", "lineitem")
def needs_placement(lineitem):
    g = lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return g.select("l_orderkey", dates.placement(F.col("a"), F.col("b")).alias("folder"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y') WHEN 'P' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS partial FROM orders", "orders")
def partial_date(orders):
    d = F.col("o_orderdate")
    known = lambda unit, *of: F.when(~F.col("o_orderstatus").isin(*of), unit(d))
    return orders.select("o_orderkey", dates.partial_text(F.year(d), known(F.month, "O"), known(F.day, "O", "P")).alias("partial"))


RULES = [("early", None, "1997-01-01"), ("middle", "1997-01-01", "1999-01-01"), ("late", "1999-01-01", None)]


@query("SELECT o_orderkey, rule FROM orders JOIN (VALUES ('early', NULL, TIMESTAMP '1997-01-01'), ('middle', TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01'), ('late', TIMESTAMP '1999-01-01', NULL)) r(rule, a, b) ON (a IS NULL OR o_orderdate >= a) AND (b IS NULL OR o_orderdate < b)", "orders")
def rule_range_join(orders):
    rules = orders.sparkSession.createDataFrame(RULES, "rule string, a string, b string").select("rule", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    return spatial.rules_in_force(orders.select("o_orderkey", "o_orderdate"), F.broadcast(rules), "o_orderdate", "a", "b").select("o_orderkey", "rule")


@query("SELECT event_id, ts + INTERVAL 9 HOUR AS local_ts FROM events", "events")
def tz_project(events):
    return events.select("event_id", dates.local_time(F.col("ts"), "Asia/Tokyo").alias("local_ts"))


@query("""WITH p AS (SELECT e.vec_id AS id, r.vec_id AS ref_id, round(list_sum([(CAST(e.embedding[i] AS DOUBLE) - CAST(r.embedding[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(r.embedding[i] AS DOUBLE)) FOR i IN range(1, len(e.embedding) + 1)]), 4) AS distance
 FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 20) r)
SELECT id, ref_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, ref_id) AS k FROM p) WHERE k = 1""", "embeddings")
def nearest_reference(embeddings):
    v = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return spatial.nearest_vector(v, v.filter("id < 20"))  # twenty references


@query("SELECT p_partkey, p_brand, p_type FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_size = 1 AND q.p_brand = p.p_brand AND q.p_type = p.p_type)", "part")
def registry_semi(part):
    return gates.qualified(part, part.filter("p_size = 1"), ("p_brand", "p_type")).select("p_partkey", "p_brand", "p_type")


@query("SELECT p_brand, count(*) AS denied FROM part GROUP BY 1", "part")
def allowlist_empty(part):
    return gates.denied(part, part.filter("1 = 0"), ("p_brand", "p_type")).groupBy("p_brand").agg(F.count("*").alias("denied"))


@query("SELECT conv_id, turn, next_turn FROM (SELECT *, lead(role) OVER w AS r, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'", "conversations")
def pair_adjacent(conversations):
    return pairing.pair_adjacent(conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", "user", "assistant").drop("role")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, max(doc_id) AS second_id FROM documents GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT source) = 2", "documents")
def pair_unique_id(documents):
    return pairing.pair_unique(documents, sha(), "source", "doc_id")


RUN = "CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) < 10"


def runs(documents):
    d = documents.withColumn("sha256", sha())
    return d.filter(source_number() < 10), d.filter(source_number() >= 10)


@query(f"WITH a AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE {RUN}), b AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE NOT ({RUN})) SELECT CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'not_reexported' ELSE 'reappeared' END AS state, count(*) AS n FROM a FULL OUTER JOIN b ON a.h = b.h GROUP BY 1", "documents")
def incremental_delta(documents):
    return identity.exports_delta(*runs(documents), "sha256")


@query(f"SELECT sha256(text) AS sha256 FROM documents WHERE {RUN} EXCEPT SELECT sha256(text) FROM documents WHERE NOT ({RUN})", "documents")
def set_except(documents):
    a, b = runs(documents)
    return a.select("sha256").subtract(b.select("sha256"))


@query(f"SELECT sha256(text) AS sha256 FROM documents WHERE {RUN} INTERSECT SELECT sha256(text) FROM documents WHERE NOT ({RUN})", "documents")
def set_intersect(documents):
    a, b = runs(documents)
    return a.select("sha256").intersect(b.select("sha256"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region", "nation", "region")
def union_parts(nation, region):
    return identity.union_parts([nation.selectExpr("n_nationkey as key", "n_name as name"), region.selectExpr("r_regionkey as key", "r_name as name")])


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND contains(lower(text), 'that') ORDER BY n_chars DESC, doc_id LIMIT 25", "documents")
def search_topk(documents):
    return catalogue.search(documents.filter("lang = 'en'"), "text", "that", 25, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "n_chars")


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 2500 THEN 'medium' ELSE 'large' END AS band FROM documents", "documents")
def size_family_band(documents):
    return documents.select("doc_id", spatial.bands(F.col("n_chars"), [("small", 500), ("medium", 2500)], "large").alias("band"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey = b.n_regionkey AS same_volume FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", "nation")
def same_volume_pairs(nation):
    copies = nation.select(F.format_string("%05d", "n_nationkey").alias("copy_id"), F.col("n_name").alias("path"), F.col("n_regionkey").cast("string").alias("volume_id"), F.lit(False).alias("confirmed"))
    v = gates.storage_independence(copies)
    return v.select(F.col("copy_id_a").cast("int").alias("a"), F.col("copy_id_b").cast("int").alias("b"), (F.col("verdict") == "not_independent").alias("same_volume"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", "events")
def json_field(events):
    return events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(r"""SELECT page_id, CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' ELSE 'clean' END AS state, path = '' OR regexp_matches(path, '^/|^[A-Za-z]:|\\|(^|/)\.{1,2}(/|$)|//|/$') AS unsafe
 FROM (SELECT *, regexp_replace(url, '^[a-z]+://[^/]*/?', '') || CASE page_id % 7 WHEN 1 THEN '/' WHEN 2 THEN '/../x' ELSE '' END AS path FROM pages)""", "pages")
def path_safety(pages):
    """The path of each page's address, some with an end that leaves its folder."""
    path = F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), F.when(F.col("page_id") % 7 == 1, "/").when(F.col("page_id") % 7 == 2, "/../x").otherwise(""))
    state = F.when(F.contains("url", F.lit("?")), "query").when(F.contains("url", F.lit("#")), "fragment").otherwise("clean")
    return pages.select("page_id", state.alias("state"), names.unsafe_path(path).alias("unsafe"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) > 0 AND contains(d.text, b.text))", "documents", "benchmark")
def payload_containment(documents, benchmark):
    return catalogue.payload_containment(documents.select("doc_id", "text"), "text", benchmark.withColumnRenamed("text", "payload"), "payload").select("doc_id")


@query("SELECT lang, source, count(*) AS n, CAST(grouping(lang) AS INTEGER) AS all_langs, CAST(grouping(source) AS INTEGER) AS all_sources FROM documents GROUP BY CUBE (lang, source)", "documents")
def cube_counts(documents):
    return documents.cube("lang", "source").agg(F.count("*").alias("n"), F.grouping("lang").cast("int").alias("all_langs"), F.grouping("source").cast("int").alias("all_sources"))
