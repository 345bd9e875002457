"""More operators applied to the driver's tables: names, signatures, records, pairs, places, gates; with their SQL.

Inputs that the tables don't have, such as file names, are made of their columns, the same way in both.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ledgerloom.functions import dates, digests, names, states
from ledgerloom.operators import gates, identity, integrity, ledger, pairing, spatial
from ledgerloom.plans.proxies import MIRROR, mirror, sha, validated
from ledgerloom.plans.proxies import query as _query

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = partial(_query, into=(QUERIES, ORACLES))


@query("""WITH p AS (SELECT CASE page_id % 4 WHEN 0 THEN '/abs/' || page_id WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN 'ok/' || (page_id // 8) ELSE 'fine/' || page_id END AS path FROM pages),
n AS (SELECT path, starts_with(path, '/') OR contains(path, '..') AS unsafe, count(*) > 1 AS repeated FROM p GROUP BY path) SELECT * FROM n WHERE unsafe OR repeated""", "pages")
def unsafe_paths(pages):
    path = F.expr("case page_id % 4 when 0 then concat('/abs/', page_id) when 1 then concat('a/../', page_id) when 2 then concat('ok/', page_id div 8) else concat('fine/', page_id) end")
    return integrity.unsafe_rows(pages.select(path.alias("path")))


@query("SELECT p_partkey, substr(replace(p_name, '(', '') || '.jpg.supplemental-metadata', 1, 46) || CASE WHEN p_size % 3 = 0 THEN '(2)' ELSE '' END || '.json' AS sidecar FROM part", "part")
def sidecar_names(part):
    media = F.concat(F.replace("p_name", F.lit("("), F.lit("")), F.when(F.col("p_size") % 3 == 0, "(2)").otherwise(""), F.lit(".jpg"))
    return part.select("p_partkey", names.sidecar_name(media).alias("sidecar"))


@query("SELECT p_partkey, CAST(p_partkey AS INTEGER) AS number, CAST(lag(p_partkey) OVER w AS INTEGER) AS previous_number, CAST(lead(p_partkey) OVER w AS INTEGER) AS next_number FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)", "part")
def camera_numbers(part):
    numbered = part.select("p_partkey", "p_brand", names.camera_number(F.format_string("IMG_%06d.jpg", "p_partkey")).alias("number"))
    return ledger.neighbours(numbered, ["p_brand"], ["number"], "number").drop("p_brand")


@query("""SELECT o_orderkey, sha256('{"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}') AS signature FROM orders""", "orders")
def metadata_signature(orders):
    return orders.select("o_orderkey", digests.signature("o_orderstatus", "o_custkey").alias("signature"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, count(DISTINCT lang || ':' || (n_chars // 1000)) > 1 AS evolved FROM documents GROUP BY 1", "documents")
def material_revisions(documents):
    rows = documents.select(sha().alias("sha256"), F.expr("n_chars div 1000").alias("size"), "lang").withColumn("signature", digests.signature("lang", "size"))
    return rows.groupBy("sha256").agg(F.count("*").alias("n"), (F.countDistinct("signature") > 1).alias("evolved"))


@query(f"WITH {MIRROR} SELECT d.path AS path FROM d JOIN m ON m.path = d.path WHERE NOT (m.size = d.size AND m.sha = d.sha)", "documents")
def record_mismatches(documents):
    m, d = mirror(documents)
    return integrity.record_mismatches(d.select("path", "size", "sha256"), m.select("path", "size", "sha256")).select("path")


@query(f"""WITH {MIRROR} SELECT (SELECT count(*) FROM d) AS records, (SELECT count(DISTINCT source) FROM documents WHERE doc_id % 17 <> 0 OR doc_id % 97 = 0) AS archives,
(SELECT count(*) FROM d JOIN m ON m.path = d.path WHERE NOT (m.size = d.size AND m.sha = d.sha)) + (SELECT count(*) FROM d WHERE path NOT IN (SELECT path FROM m)) + (SELECT count(*) FROM m WHERE path NOT IN (SELECT path FROM d)) AS problems""", "documents")
def vault_audit(documents):
    m, d = mirror(documents)
    return integrity.vault_audit(d, m, F.col("source"))


@query("""SELECT content_identifier, min(CASE WHEN kind = 'still' THEN doc_id END) AS still_occ_id, min(CASE WHEN kind = 'movie' THEN doc_id END) AS movie_occ_id
FROM (SELECT sha256(text) AS content_identifier, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'still' ELSE 'movie' END AS kind FROM documents) GROUP BY 1 HAVING count(*) = 2 AND count_if(kind = 'still') = 1""", "documents")
def live_photo_pairs(documents):
    return pairing.pair_live_photos(documents.select(F.col("doc_id").alias("occ_id"), sha().alias("content_identifier"), F.when(F.col("doc_id") % 2 == 0, "still").otherwise("movie").alias("kind")))


@query("""WITH m AS (SELECT p_partkey AS occ_id, p_size AS folder, p_brand AS name FROM part), s AS (SELECT folder, name, count(*) AS s, min(occ_id) AS low FROM m WHERE occ_id % 3 <> 0 GROUP BY 1, 2), n AS (SELECT folder, name, count(*) AS n FROM m GROUP BY 1, 2),
j AS (SELECT m.occ_id, low, CASE WHEN s IS NULL THEN 'none' WHEN s > 1 OR n > 1 THEN 'ambiguous' ELSE 'paired' END AS state FROM m JOIN n USING (folder, name) LEFT JOIN s USING (folder, name)) SELECT occ_id, state, CASE WHEN state = 'paired' THEN low END AS sidecar_occ_id FROM j""", "part")
def sidecar_pairs(part):
    folder, name = F.concat(F.lit("Album "), "p_size"), F.concat("p_brand", F.lit(".jpg"))
    sidecars = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("occ_id"), folder.alias("folder"), F.concat(name, F.lit(".supplemental-metadata.json")).alias("filename"))
    return pairing.pair_sidecars(part.select(F.col("p_partkey").alias("occ_id"), F.concat(folder, F.lit("/"), name).alias("member_path")), sidecars)


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 160 - 79.75 AS lat, c_custkey * 7 % 360 - 179.5 AS lon FROM customer), q AS (SELECT n_nationkey AS place_id, n_nationkey * 6 - 72.0 AS lat2, n_nationkey * 14 - 170.0 AS lon2 FROM nation),
d AS (SELECT id, place_id, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))) AS km FROM p, q),
b AS (SELECT id, place_id, km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, place_id) AS k FROM d WHERE km <= 1500) WHERE k = 1)
SELECT p.id AS id, place_id, round(km, 3) AS km FROM p LEFT JOIN b ON b.id = p.id""", "customer", "nation")
def nearest_places(customer, nation):
    points = customer.selectExpr("c_custkey as id", "c_custkey % 160 - double(79.75) as lat", "c_custkey * 7 % 360 - double(179.5) as lon")
    places = nation.selectExpr("n_nationkey as place_id", "n_nationkey * 6 - double(72) as lat", "n_nationkey * 14 - double(170) as lon")
    return spatial.nearest_place(points, places, 1500.0, 10.0).select("id", "place_id", F.round("km", 3).alias("km"))


@query("SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN c_custkey % 90 ELSE -(c_custkey % 90) END AS DOUBLE) + CASE c_custkey % 3 WHEN 0 THEN 0.5 ELSE -0.5 END AS latitude FROM customer", "customer")
def coordinates(customer):
    text = F.expr("case c_custkey % 3 when 0 then concat(c_custkey % 90, '.5N') when 1 then concat('-', c_custkey % 90, '.5') else concat(c_custkey % 90, ',30S') end")
    return customer.select("c_custkey", dates.coordinate(text).alias("latitude"))


@query("SELECT p_partkey, ['JPEG', 'HEIF', 'VIDEO', 'RAW', 'UNKNOWN', 'VIDEO'][p_partkey % 6 + 1] AS family FROM part", "part")
def format_families(part):
    ending = F.expr("element_at(array('JPG', 'heic', 'mov', 'dng', 'txt', 'M2TS'), int(p_partkey % 6 + 1))")
    return part.select("p_partkey", names.format_family(F.concat(F.lit("a.b/x"), "p_partkey", F.lit("."), ending)).alias("family"))


@query("SELECT doc_id, NOT (quality = 1 AND doc_id % 3 <> 2) AS sound FROM labels", "labels")
def validator_provenance(labels):
    validator = F.expr("element_at(array('', ' Unknown ', 'Pillow'), int(doc_id % 3 + 1))")
    return labels.select("doc_id", states.sound_validation(states.validation_status(F.col("quality")), validator, F.lit("11.0")).alias("sound"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN r_name || ', ' || n_name ELSE c_name || ', ' || n_name END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", "customer", "nation", "region")
def place_labels(customer, nation, region):
    rows = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    city = F.when(F.col("c_custkey") % 4 > 1, F.col("c_name"))
    shown = F.when(F.col("c_custkey") % 4 == 0, F.lit("29")).otherwise(F.col("r_name"))
    return rows.select("c_custkey", names.place_label(city, shown, F.col("n_name")).alias("label"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderstatus <> 'O' THEN CAST(month(o_orderdate) AS INTEGER) END AS month, CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN CAST(day(o_orderdate) AS INTEGER) END AS day,
CASE o_orderstatus WHEN 'O' THEN 'year' WHEN 'P' THEN 'month' ELSE 'day' END AS precision FROM orders""", "orders")
def partial_dates(orders):
    text = F.expr("case o_orderstatus when 'O' then date_format(o_orderdate, 'yyyy') when 'P' then date_format(o_orderdate, 'yyyy-MM') else date_format(o_orderdate, 'yyyy:MM:dd') end")
    return orders.select("o_orderkey", dates.partial_date(text).alias("d")).select("o_orderkey", "d.year", "d.month", "d.day", "d.precision")


@query("""WITH a AS (SELECT sha256(text) AS h, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS k FROM documents WHERE doc_id % 2 = 0)
SELECT d.doc_id AS doc_id FROM documents d LEFT JOIN a ON a.h = sha256(d.text) AND k = 1 WHERE d.doc_id % 2 = 1 AND (a.h IS NULL OR a.source <> d.source)""", "documents")
def later_export(documents):
    rows = documents.select("doc_id", "source", sha().alias("sha256"))
    return identity.latest_intake(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), ["sha256"], F.col("source"), "doc_id").select("doc_id")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'not_independent' WHEN a.n_nationkey % 2 = 0 AND b.n_nationkey % 2 = 0 THEN 'independent' ELSE 'not_proven' END AS verdict FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", "nation")
def storage_verdicts(nation):
    copies = nation.select(F.format_string("%05d", "n_nationkey").alias("copy_id"), F.col("n_name").alias("path"), F.col("n_regionkey").cast("string").alias("volume_id"), (F.col("n_nationkey") % 2 == 0).alias("confirmed"))
    return gates.storage_independence(copies).select(F.col("copy_id_a").cast("int").alias("a"), F.col("copy_id_b").cast("int").alias("b"), "verdict")


GATES = {"complete_text": "n_chars > 0", "audited": "quality is not null", "validated": "quality = 1", "vaulted": "doc_id % 97 <> 5", "redundant": "doc_id % 89 <> 3", "exit_evidence": "length(lang) = 2"}


@query("SELECT source, " + ", ".join(f"bool_and(coalesce({c}, false)) AS {g}" for g, c in GATES.items()) + ", bool_and(n_chars >= 0) AS complete, bool_and(" + " AND ".join(f"coalesce({c}, false)" for c in GATES.values()) + ") AS ready FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", "documents", "labels")
def retirement_gates(documents, labels):
    rows = documents.join(labels, "doc_id", "left")
    return gates.readiness(rows, ["source"], {g: F.expr(c) for g, c in GATES.items()}, F.col("n_chars") >= 0).select("source", *GATES, "complete", "ready")


@query("SELECT lang, count(*) AS n, count_if(quality = 1) AS passed, count_if(quality IS NULL) AS unavailable FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", "documents", "labels")
def validation_pivot(documents, labels):
    found = validated(documents, labels).groupBy("lang").pivot("status", [states.PASSED, states.FAILED, states.UNAVAILABLE]).count().na.fill(0)
    return found.select("lang", F.expr("passed + failed + unavailable").alias("n"), "passed", "unavailable")
