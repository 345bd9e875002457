"""Lookups over the driver's tables, each with the SQL that gives the same rows: zones of points, rules in force, wall
times, texts by a stored index."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import intervals, offsets, textindex, zones
from ledgerloom.plans import proxies
from ledgerloom.sources import zone_rules
from ledgerloom.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
query = partial(proxies.query, into=(QUERIES, ORACLES))

#: Corners of a supplier's zone from its centre, in degrees (east, north), and of the hole in it.
OUTER = ((12, 1), (5, 4), (4, 11), (-1, 6), (-9, 9), (-5, 0), (-11, -8), (-2, -5), (3, -12), (6, -4))
HOLE = ((2, 2), (-2, 2), (-2, -2), (2, -2))
_PLACES = f"""c AS (SELECT s_suppkey AS zone, s_suppkey * 37 % 360 - 180 AS x, s_suppkey * 23 % 150 - 75 AS y FROM supplier),
v AS (SELECT zone, part, k, CAST(((x + dx + 540) % 360 - 180) * 1000000 AS BIGINT) AS lon, CAST((y + dy) * 1000000 AS BIGINT) AS lat, n
  FROM c, (VALUES {", ".join(f"({part}, {k}, {dx}, {dy}, {len(ring)})" for part, ring in enumerate((OUTER, HOLE)) for k, (dx, dy) in enumerate(ring))}) o(part, k, dx, dy, n))"""


@query(f"""WITH {_PLACES},
w AS (SELECT a.*, b.lon AS lon2, b.lat AS lat2, max(abs(a.lon - b.lon)) OVER (PARTITION BY a.zone, a.part) > 180000000 AS crosses FROM v a JOIN v b ON a.zone = b.zone AND a.part = b.part AND b.k = (a.k + 1) % a.n),
e AS (SELECT zone, CASE WHEN crosses AND lon < 0 THEN lon + 360000000 ELSE lon END AS ax, lat AS ay, CASE WHEN crosses AND lon2 < 0 THEN lon2 + 360000000 ELSE lon2 END AS bx, lat2 AS by2 FROM w),
p AS (SELECT c_custkey AS id, c_custkey * 7919 * 1009 % 360000000 - 180000000 + f AS x, c_custkey * 104729 * 13 % 170000000 - 85000000 AS y FROM customer, (VALUES (0), (360000000)) t(f)),
h AS (SELECT id, zone FROM p JOIN e ON (ay > y) <> (by2 > y) AND CASE WHEN by2 > ay THEN (y - ay) * (bx - ax) <= (x - ax) * (by2 - ay) ELSE (y - ay) * (bx - ax) >= (x - ax) * (by2 - ay) END GROUP BY id, zone HAVING count(*) % 2 = 1)
SELECT c_custkey AS id, zone FROM customer LEFT JOIN h ON id = c_custkey""", "customer", "supplier")  # fmt: skip
def zone_lookup(customer, supplier):
    """Zones with a hole around each supplier's place, some over the date line, and the customers in them."""
    x, y = F.col("s_suppkey") * 37 % 360 - 180, F.col("s_suppkey") * 23 % 150 - 75

    def ring(corners: tuple) -> Column:
        return F.array(*(F.struct((y + dy).cast("double").alias("lat"), ((x + dx + 540) % 360 - 180).cast("double").alias("lon")) for dx, dy in corners))

    rings = supplier.select(F.col("s_suppkey").alias("zone"), F.explode(F.array(ring(OUTER), ring(HOLE))).alias("ring"))
    lon, lat = F.col("c_custkey") * (7919 * 1009) % 360_000_000 - 180_000_000, F.col("c_custkey") * (104729 * 13) % 170_000_000 - 85_000_000
    return zones.zones_at(customer.select(F.col("c_custkey").alias("id"), (lat / 1e6).alias("lat"), (lon / 1e6).alias("lon")), rings)


_RULES = """SELECT p_partkey AS rule, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey * 7919 % 2400 AS INT)) END AS a,
 CASE WHEN p_partkey % 50 = 1 THEN NULL WHEN p_partkey % 50 = 0 THEN TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 30 AS INT)) ELSE TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey * 7919 % 2400 + p_size % 7 AS INT)) END AS b FROM part"""


@query(f"SELECT o_orderkey, count(*) AS n_rules, min(rule) AS first_rule, max(rule) AS last_rule FROM orders JOIN ({_RULES}) ON (a IS NULL OR o_orderdate >= a) AND (b IS NULL OR o_orderdate < b) GROUP BY 1", "orders", "part")
def rules_at_size(orders, part):
    """As many rules as parts, some open at an end, without a join column: those in force on each order's date, which are
    counted without a row for each rule and order."""
    day = lambda n: F.expr(f"timestamp_ntz'1995-01-01' + make_dt_interval(cast({n} as int))")
    kind = F.col("p_partkey") % 50
    start = F.when(kind != 0, day("p_partkey * 7919 % 2400"))
    end = F.when(kind == 0, day("p_partkey % 30")).when(kind != 1, day("p_partkey * 7919 % 2400 + p_size % 7"))
    rules = part.select(F.col("p_partkey").alias("rule"), start.alias("a"), end.alias("b"))
    found = intervals.interval_totals(orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("day")), rules, "day", "a", "b", "rule")
    return found.groupBy("o_orderkey").agg(F.sum("n").alias("n_rules"), F.min("least").alias("first_rule"), F.max("greatest").alias("last_rule"))


ZONES = ("Europe/Berlin", "America/New_York", "Australia/Lord_Howe")
_ZONE = "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES)) + " END"
_AT = "o_orderdate + to_minutes(CAST(60 + o_orderkey * 7919 % 180 AS INT))"


def _orders_in_zones(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders with a zone (each fourth has none) and a time of their day between one and four o'clock; the zones' rules."""
    at = F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, cast(60 + o_orderkey * 7919 % 180 as int))")
    rows = orders.select("o_orderkey", F.expr(_ZONE).alias("zone"), at.alias("at"))
    return rows, zone_rules.read_zone_files(zone_rules.installed_zones(orders.sparkSession, list(ZONES)))


@query(f"SELECT o_orderkey, timezone(zone, timezone('UTC', wall)) AS local, CAST(date_diff('second', wall, timezone(zone, timezone('UTC', wall))) AS INT) AS offset_s FROM (SELECT o_orderkey, {_ZONE} AS zone, {_AT} AS wall FROM orders)", "orders")
def wall_times(orders):
    rows, periods = _orders_in_zones(orders)
    return offsets.to_local(rows, periods, "o_orderkey", "at", "zone").drop("abbreviation")


@query(f"""WITH o AS (SELECT o_orderkey, {_ZONE} AS zone, {_AT} AS wall FROM orders),
i AS (SELECT o_orderkey, timezone('UTC', timezone(zone, wall)) + to_minutes(CAST(30 * k AS INT)) AS u, zone, wall FROM o, range(-4, 5) r(k)),
f AS (SELECT o_orderkey, min(u) AS earliest, max(u) AS latest FROM i WHERE timezone(zone, timezone('UTC', u)) = wall GROUP BY 1)
SELECT o_orderkey, CASE WHEN zone IS NULL THEN 'unknown' WHEN earliest IS NULL THEN 'gap' WHEN earliest = latest THEN 'exact' ELSE 'ambiguous' END AS status, earliest, latest FROM o LEFT JOIN f USING (o_orderkey)""", "orders")
def instants_of_wall_times(orders):
    """Times that the clock skipped or showed twice stay a gap or ambiguous."""
    rows, periods = _orders_in_zones(orders)
    return offsets.to_utc(rows, periods, "o_orderkey", "at", "zone")


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'tion the') ORDER BY n_chars DESC, doc_id LIMIT 25", "documents")
def indexed_search(documents):
    """An index of two intakes, merged, then searched."""
    index = textindex.TextIndex(documents.sparkSession, f"{shared_folder(documents.sparkSession)}/texts-{uuid.uuid4().hex}")
    for intake in (0, 1):
        index = index.add(documents.filter(F.col("doc_id") % 2 == intake).select(F.col("doc_id").alias("id"), "text"))
    return index.compact().search(documents, "doc_id", "text", "Tion the", 25, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "n_chars")
