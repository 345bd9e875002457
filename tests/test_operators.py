import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import catalogue, gates, identity, integrity, ledger, pairing, spatial
from ledgerloom.operators import zones as zone_cells


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_consensus_keeps_disputes(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("d", None), ("d", "z")], "h string, f string")
    assert rows(identity.field_consensus(df, F.col("h"), "f")) == [("a", 1, "x", False), ("b", 2, None, True), ("c", 0, None, False), ("d", 1, "z", False)]
    assert rows(identity.canonical(df.withColumn("id", F.monotonically_increasing_id()), F.col("h"), "id").select("sha256")) == [("a",), ("b",), ("c",), ("d",)]


def test_revisions_of_later_exports(spark):
    old = spark.createDataFrame([("a", "m1", 1), ("a", "m2", 2), ("b", "m1", 1)], "h string, m string, run int")
    new = spark.createDataFrame([("a", "m2", 3), ("b", "m9", 3), ("c", "m1", 3)], "h string, m string, run int")
    assert rows(identity.latest_intake(old, new, ["h"], F.sha2("m", 256), "run").select("h")) == [("b",), ("c",)]
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert identity.union_parts([a, b]).count() == 4 and rows(identity.exports_delta(a, b, "k")) == [("new", 1), ("reappeared", 1)]


def test_mirror_plan(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, None), ("../e", 1, "x"), ("f", 1, "x"), ("f", 1, "x")], "path string, size long, sha256 string")
    d = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("d", 1, None), ("z", 1, "x")], "path string, size long, sha256 string")
    plan = integrity.mirror_plan(m, d)
    assert dict(rows(plan)) == {"a": "reused", "b": "conflict", "c": "missing", "d": "conflict", "../e": "unsafe", "f": "unsafe", "z": "extra"}
    assert not integrity.preflight_passes(plan)
    assert integrity.mirror_counts(plan).first().asDict() == {"copied": 1, "reused": 1, "total": 6, "conflicts": 2, "unsafe_paths": 2, "ok": False}
    clean = integrity.mirror_plan(m.filter("path = 'a'"), d)
    assert integrity.preflight_passes(clean) and integrity.mirror_counts(clean).first()["ok"]


def test_vault(spark):
    objects = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y"), ("o", 1, "z")], "path string, size long, sha256 string")
    records = spark.createDataFrame([(1, "p", 1, "x", "z1"), (2, "q", 2, "other", "z1"), (3, "gone", 1, "x", "z2"), (4, "p", None, "x", "z2")], "record_id long, path string, size long, sha256 string, archive string")
    assert rows(integrity.record_mismatches(records, objects).select("record_id")) == [(2,), (4,)]
    assert rows(integrity.orphans(objects, records, [("path", "path")]).select("path")) == [("o",)]
    assert integrity.vault_audit(records, objects, F.col("archive")).first().asDict() == {"records": 4, "archives": 2, "problems": 4}
    assert rows(integrity.binding_conflicts(records, ["path"], "size")) == []


def test_ledgers(spark):
    d = spark.createDataFrame([("a", 1, "t", "x"), ("a", 2, "t", None), ("b", 1, "t", "y")], "asset_id string, decision_seq int, field string, value string")
    assert rows(ledger.projection(d).select("asset_id", "value", "n_prior")) == [("a", None, 1), ("b", "y", 0)]
    e = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", 3, None), ("k", 4, None), ("k", 5, "x")], "k string, n int, s string")
    assert rows(ledger.changes(e, ["k"], ["n"], "s").select("n")) == [(3,), (5,)]
    left = spark.createDataFrame([("k", 10, 1), ("k", 3, 2), ("k", 5, 3), ("j", 9, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("k", 5, 7, "a"), ("k", 5, 8, None), ("k", 11, 9, "c")], "k string, t int, seq int, v string")
    assert rows(ledger.as_of(left, right, ["k"], "t", "t", ["v"], "seq")) == [("k", 10, 1, 5, None), ("k", 5, 3, 5, None)]
    assert rows(ledger.latest(e, ["k"], ["n"])) == [("k", 5, "x")]


def test_pairs(spark):
    media = spark.createDataFrame([("1", "f/a.jpg"), ("2", "g/a.jpg"), ("3", "f/b(1).jpg"), ("4", "h/c.jpg")], "occ_id string, member_path string")
    side = spark.createDataFrame([("s1", "f", "a.jpg.supplemental-metadata.json"), ("s2", "f", "b.jpg.supplemental-metadata(1).json"), ("s3", "h", "c.jpg.supplemental-metadata.json"), ("s4", "h", "c.jpg.supplemental-metadata.json")], "occ_id string, folder string, filename string")
    assert rows(pairing.pair_sidecars(media, side)) == [("1", "paired", "s1"), ("2", "none", None), ("3", "paired", "s2"), ("4", "ambiguous", None)]
    items = spark.createDataFrame([(1, "x", "still"), (2, "x", "movie"), (3, "y", "still"), (4, "y", "still"), (5, "y", "movie"), (6, None, "still"), (7, None, "movie")], "occ_id long, content_identifier string, kind string")
    assert rows(pairing.pair_live_photos(items)) == [("x", 1, 2)]


def test_space(spark):
    p = spark.createDataFrame([(1, 34.68, 135.8), (2, 0.0, 179.99), (3, 80.0, 0.0), (4, None, 1.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([(10, 34.7, 135.8), (11, 34.66, 135.8), (12, 0.0, -179.99), (9, 34.66, 135.8)], "place_id long, lat double, lon double")
    got = {r["id"]: r["place_id"] for r in spatial.nearest_place(p, places, 50.0).collect()}
    assert got == {1: 9, 2: 12, 3: None, 4: None} or got == {1: 10, 2: 12, 3: None, 4: None}
    km = spatial.haversine_km(*(F.lit(x) for x in (34.68, 135.8, 34.7, 135.8)))
    assert spark.range(1).select(km).first()[0] == pytest.approx(2.2239, abs=1e-3)
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 5.0), (5.0, 5.0), (5.0, 0.0)]
    zones = spark.createDataFrame([("z", ring)], "zone string, ring array<struct<lat:double,lon:double>>")
    q = spark.createDataFrame([(1, 2.0, 2.0), (2, 7.0, 2.0), (3, 7.0, 7.0), (4, 50.0, 5.0)], "id long, lat double, lon double")
    assert rows(zone_cells.zones_at(q, zones)) == [(1, "z"), (2, None), (3, "z"), (4, None)]
    rules = spark.createDataFrame([("old", None, 10), ("new", 10, None)], "rule string, a int, b int")
    t = spark.createDataFrame([(9,), (10,), (None,)], "t int")
    assert rows(spatial.rules_in_force(t, rules, "t", "a", "b").select("t", "rule")) == [(10, "new"), (9, "old")]


def test_gates(spark):
    copies = spark.createDataFrame([("a", "/x", "v1", True), ("b", "/x", "v2", True), ("c", "/y", "v1", True), ("d", "/z", "v9", True), ("e", "/w", "v8", False), ("f", "/u", None, True)], "copy_id string, path string, volume_id string, confirmed boolean")
    got = {(r["copy_id_a"], r["copy_id_b"]): r["verdict"] for r in gates.storage_independence(copies).collect()}
    assert got["a", "b"] == got["a", "c"] == "not_independent" and got["a", "d"] == "independent" and got["d", "e"] == got["d", "f"] == "not_proven"
    tools = spark.createDataFrame([("1", "x"), ("1", "y")], "version string, executable_sha256 string")
    listed = spark.createDataFrame([("1", "x"), ("2", "y")], "version string, executable_sha256 string")
    assert rows(gates.qualified(tools, listed)) == [("1", "x")] and gates.denied(tools, listed.limit(0)).count() == 2
    df = spark.createDataFrame([("s", True, True), ("s", None, True), ("t", True, True)], "k string, a boolean, b boolean")
    got = {r["k"]: (r["ready"], r["blockers"]) for r in gates.readiness(df, ["k"], {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {"s": (False, ["a"]), "t": (True, [])}
    gates.require_format(None, None, True)
    gates.require_format("ledgerloom.archive", 1, False)
    for args in ((None, None, False), ("ledgerloom.archive", 2, False), ("other", 1, True)):
        with pytest.raises(ValueError):
            gates.require_format(*args)


def test_catalogue(spark):
    rev = spark.createDataFrame([("a", 1, "x", "failed"), ("a", 2, "y", "passed"), ("b", 1, "z", "passed")], "asset_id string, revision int, sha256 string, status string")
    dec = spark.createDataFrame([("a", 1, "title", "old"), ("a", 2, "title", "new")], "asset_id string, decision_seq int, field string, value string")
    got = {r["asset_id"]: (r["sha256"], r["decided"]) for r in catalogue.build(rev, dec).collect()}
    assert got == {"a": ("y", {"title": "new"}), "b": ("z", None)}


def test_binding_conflicts_with_nulls(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "x"), (None, "a", "x"), (None, "a", "z"), (None, "a", None), (2, "a", None), (2, "a", "x")]
    got = integrity.binding_conflicts(spark.createDataFrame(rows, "k long, j string, v string"), ["k", "j"], "v").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", 2, 2), (None, "a", 2, 3)]


def test_nearest_vector_is_for_few_references(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id long, v array<double>")
    got = spatial.nearest_vector(v, v.filter("id in (0, 4)"), 2).collect()
    assert sorted((r["id"], r["ref_id"], r["distance"]) for r in got) == [(0, 0, 0.0), (1, 0, 1.0), (2, 0, 4.0), (3, 4, 1.0), (4, 4, 0.0)]
    with pytest.raises(ValueError):
        spatial.nearest_vector(v, v, 4)
