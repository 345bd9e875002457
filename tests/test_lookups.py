"""Zones, intervals and offsets against plain versions of them."""

import math
import random
import zoneinfo
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import intervals, offsets, zones
from ledgerloom.plans import lookups
from ledgerloom.sources import zone_rules

RING = "zone string, ring array<struct<lat:double,lon:double>>"
POINT = "id long, lat double, lon double"


def exact(points, rings):
    """Ray casting in whole numbers; a zone's rings count together."""
    edges = {}
    for zone, ring in rings:
        c = [(round(x * 1e6), round(y * 1e6)) for y, x in ring]
        if any(abs(a[0] - b[0]) > 180e6 for a, b in zip(c, c[1:] + c[:1], strict=True)):
            c = [(x + 360_000_000 if x < 0 else x, y) for x, y in c]
        edges.setdefault(zone, []).extend(zip(c, c[1:] + c[:1], strict=True))
    out = set()
    for i, lat, lon in points:
        held = set()
        if lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180:
            for zone, found in edges.items():
                n = 0
                for turn in (0, 360_000_000):
                    x, y = round(lon * 1e6) + turn, round(lat * 1e6)
                    for a, b in found:
                        if (a[1] > y) != (b[1] > y):
                            d = b[1] - a[1]
                            left, right = (y - a[1]) * (b[0] - a[0]), (x - a[0]) * d
                            n += left <= right if d > 0 else left >= right
                if n % 2:
                    held.add((i, zone))
        out |= held or {(i, None)}
    return out


def made_rings(r):
    out = []
    for k in range(16):
        cy, cx, n = r.randint(-60, 60), r.choice([r.randint(-180, 179), 175, -178]), r.choice([3, 5, 12, 90])
        for scale in (1, 0.3)[: 1 + k % 2]:
            ring = []
            for i in range(n):
                d = scale * r.choice([5, 8, 12, 20])
                ring.append((float(cy + round(d * math.sin(2 * math.pi * i / n))), float((cx + round(d * math.cos(2 * math.pi * i / n)) + 180) % 360 - 180)))
            out.append((f"z{k}", ring))
    return out


def test_zones_are_exact(spark):
    """Stars with holes, over the date line too; points on corners and edges, off the globe and without a place."""
    r = random.Random(5)
    rings = made_rings(r)
    points = [(i, float(r.randint(-90, 90)), float(r.randint(-180, 180))) if i % 2 else (i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(1500)]
    corners = [c for _, ring in rings for c in ring]
    points += [(2000 + i, *c) for i, c in enumerate(corners[:200])] + [(3000, None, 1.0), (3001, 1.0, None), (3002, 91.0, 0.0), (3003, 0.0, 200.0)]
    got = zones.zones_at(spark.createDataFrame(points, POINT), spark.createDataFrame(rings, RING))
    assert set(map(tuple, got.collect())) == exact(points, rings)


def test_cover(spark):
    """Inner cells have no edge, boundary cells few; no row but the first holds a whole ring; the cover can be stored."""
    ring = [(30 * math.sin(i / 500 * math.pi), 40 * math.cos(i / 500 * math.pi)) for i in range(1000)]
    polygons = spark.createDataFrame([("z", ring), (None, ring), ("line", ring[:2])], RING)
    cells = zones.cover(polygons).cache()
    inner, most = cells.filter("size(edges) = 0").count(), cells.agg(F.max(F.size("edges"))).first()[0]
    assert inner > 20 and most <= zones.MOST_EDGES and {r["zone"] for r in cells.select("zone").distinct().collect()} == {"z"}
    points = [(1, 0.0, 0.0), (2, 29.9, 0.0), (3, 30.1, 0.0), (4, 0.0, -39.9), (5, 0.0, -40.1)]
    got = zones.zones_at(spark.createDataFrame(points, POINT), cells=cells)
    assert {tuple(r) for r in got.collect()} == {(1, "z"), (2, "z"), (3, None), (4, "z"), (5, None)}
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Python" not in plan and "mapInPandas" not in plan
    none = zones.zones_at(spark.createDataFrame(points, POINT), polygons.limit(0))
    assert {r["zone"] for r in none.collect()} == {None}


def test_equal_zones_share_a_cover(spark, monkeypatch):
    """Zones at few places, over the date line too: one cover for each place, within the world, finer for more points;
    found zones are neither counted nor grouped. One place has most zones; some points are in none."""
    r = random.Random(8)
    star = [(12, 1), (4, 11), (-9, 9), (-5, 0), (-11, -8), (6, -4)]
    at = lambda cx, cy, turn: [(float(cy + dy), float((cx + dx + 540) % 360 - 180)) for dx, dy in star[turn:] + star[:turn]]
    places = [(175, 10), (-172, -40), (0, 0), (3, 2)]
    rings = [(f"z{k}", at(*places[k if k < 4 else 0], k % 6)) for k in range(40)] + [("hole", at(175, 10, 0)), ("hole", [(12.0, 177.0), (12.0, 173.0), (8.0, 173.0), (8.0, 177.0)])]
    points = [(i, cy + r.uniform(-14, 14), (cx + r.uniform(-14, 14) + 540) % 360 - 180) for i in range(800) for cx, cy in [places[i % 4]]] + [(900, 80.0, 0.0), (901, None, None), (902, 10.0, 180.0), (903, 10.0, -180.0)]
    kept = {}
    monkeypatch.setattr(zones, "stored", lambda df, name: kept.setdefault(name, df.cache()))
    got = zones.zones_at(spark.createDataFrame(points, POINT), spark.createDataFrame(rings, RING))
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == exact(points, rings)
    cells = kept["zone-cells"]
    assert cells.select("zone").distinct().count() == 5
    assert all((c["cx"] << c["level"]) <= zones.TURN + 1 for c in cells.select("level", "cx").collect())
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert [zones._widest_bits(n) for n in (0, 15_000, 900_000, 10**12)] == [30, 22, 20, 14]


@pytest.mark.parametrize("on", [(), ("k",)])
def test_intervals(spark, on):
    r = random.Random(6)
    points = [(i, r.randrange(3), None if i == 7 else r.randint(-500, 5000)) for i in range(400)]
    rules = [(100 + j, r.randrange(3), a := r.choice([None, r.randint(-600, 5000)]), r.choice([None, (a or 0) + r.choice([-3, 0, 1, 2, 9, 70, 4000])])) for j in range(300)]
    p = spark.createDataFrame(points, "id long, k int, t long")
    q = spark.createDataFrame(rules, "rule long, k int, a long, b long")
    if not on:
        q = q.withColumnRenamed("k", "rule_k")
    found = intervals.interval_join(p, q, "t", "a", "b", on)
    want = sorted((i, j) for i, k, t in points for j, kr, a, b in rules if t is not None and (not on or k == kr) and (a is None or t >= a) and (b is None or t < b))
    assert sorted((x["id"], x["rule"]) for x in found.collect()) == want and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert intervals.interval_join(p.limit(0), q, "t", "a", "b", on).count() == 0 == intervals.interval_join(p, q.limit(0), "t", "a", "b", on).count()


@pytest.mark.parametrize("kind", ["long", "timestamp_ntz", "timestamp", "date"])
def test_interval_totals(spark, kind):
    """Counts, least and greatest against pairs; one time, none, nulls, microseconds at the ends."""
    r, day = random.Random(7), datetime(2024, 3, 1)
    value = {"long": lambda n: n, "date": lambda n: (day + timedelta(days=n)).date()}.get(kind, lambda n: day + timedelta(microseconds=n * 1_000_003 if n % 3 else n * 3_600_000_000))
    some = lambda n: None if n is None else value(n)
    for size, most in ((300, 3000), (300, 20), (1, 5), (0, 5)):
        points = [(i, None if i == 7 else value(r.randint(-most, most))) for i in range(size)]
        rules = [(100 + j, a and some(a[0]), some(r.choice([None, (a or [0])[0] + r.choice([-3, 0, 1, 2, 9, 70, most])]))) for j in range(200) for a in [r.choice([None, [r.randint(-most - 9, most + 9)], [r.randint(-most, most)]])]]
        rules += [(j % 2 and j, None, None) for j in range(4)] if size > 1 else []
        p, q = spark.createDataFrame(points, f"id long, t {kind}"), spark.createDataFrame(rules, f"rule long, a {kind}, b {kind}")
        want = {}
        for i, t in points:
            held = [j for j, a, b in rules if (a is None or t is not None and t >= a) and (b is None or t is not None and t < b)]
            if held:
                want[i] = (len(held), min(held), max(held))
        found = intervals.interval_totals(p, q, "t", "a", "b", "rule")
        assert found.columns == ["id", "t", "n", "least", "greatest"] and sorted(tuple(x)[0:1] + tuple(x)[2:] for x in found.collect()) == sorted((i, *x) for i, x in want.items())
        assert intervals.interval_totals(p, q.limit(0), "t", "a", "b", "rule").count() == 0
    for wrong in (p.withColumn("t", F.lit(1.5)), p.withColumn("t", F.lit("x"))):
        with pytest.raises(ValueError):
            intervals.interval_totals(wrong, q, "t", "a", "b", "rule")


def rows_made(df):
    """The most rows that any step of a DataFrame made when it was collected."""
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.nodeName()
        todo += [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if kind.endswith("QueryStage") else [plan.children().apply(k) for k in range(plan.children().size())]
        if (rows := plan.metrics().get("numOutputRows")).isDefined():
            made.append(rows.get().value())
    return max(made)


def test_totals_make_no_pairs(spark):
    """Of orders and rules there are 22 pairs for each order; of made times and intervals, over 90 million."""
    found = lookups.QUERIES["rules_at_size"](spark, "/root/testdata/sf0.01")
    got = found.collect()
    assert len(got) == 15_000 and sum(r["n_rules"] for r in got) > 300_000 and 15_000 <= rows_made(found) < 40_000
    p = spark.range(20_000).select("id", (F.col("id") % 1_009).alias("t"))
    q = spark.range(20_000).select(F.col("id").alias("rule"), (F.col("id") * 7 % 1_009).alias("a"), (F.col("id") * 11 % 1_013 + 500).alias("b"))
    found = intervals.interval_totals(p, q, "t", "a", "b", "rule")
    got = found.collect()
    assert sum(r["n"] for r in got) > 90_000_000 and 19_000 < rows_made(found) < 100_000


def test_zone_files_agree_with_python(spark):
    names = sorted(zoneinfo.available_timezones())[::6] + ["America/New_York", "Australia/Lord_Howe", "Europe/Dublin", "Africa/Casablanca", "America/Nuuk", "Etc/UTC"]
    rows = zone_rules.read_zone_files(zone_rules.installed_zones(spark, sorted(set(names)))).collect()
    assert not [r for r in rows if r["problem"]]
    by_zone = {}
    for r in rows:
        by_zone.setdefault(r["zone"], []).append(r)
    moments = [datetime(y, m, d, 1, 30) for y in (1850, 1905, 1945, 1976, 1995, 2007, 2024, 2038, 2055, 2099) for m, d in ((1, 1), (3, 29), (6, 15), (10, 27), (12, 31))]
    for name, found in by_zone.items():
        found.sort(key=lambda r: r["utc_from"] or datetime.min)
        assert found[0]["utc_from"] is None and all(a["utc_to"] == b["utc_from"] for a, b in zip(found, found[1:], strict=False)), name
        zone = zoneinfo.ZoneInfo(name)
        for t in moments:
            (hit,) = [r for r in found if (r["utc_from"] is None or t >= r["utc_from"]) and (r["utc_to"] is None or t < r["utc_to"])]
            assert timedelta(seconds=hit["offset_s"]) == t.replace(tzinfo=UTC).astimezone(zone).utcoffset(), (name, t)


def test_unreadable_zone_files(spark):
    files = spark.createDataFrame([("ok", bytearray(zone_rules.installed_zones(spark, ["Asia/Tokyo"]).first()["content"])), ("cut", bytearray(b"TZif2" + bytes(60))), ("text", bytearray(b"none")), ("null", None)], "zone string, content binary")
    got = {r["zone"]: r["problem"] for r in zone_rules.read_zone_files(files).collect()}
    assert got["ok"] is None and all(got[k].startswith("unreadable zone file") for k in ("cut", "text", "null"))


def test_folder_of_zone_files(spark, tmp_path):
    data = bytes(zone_rules.installed_zones(spark, ["Asia/Tokyo"]).first()["content"])
    (tmp_path / "pack" / "Asia").mkdir(parents=True)
    (tmp_path / "pack" / "Asia" / "Tokyo").write_bytes(data)
    (tmp_path / "pack" / "zone.tab").write_text("not a zone")
    for folder in (f"{tmp_path}/pack", f"file://{tmp_path}/pack/"):
        assert [tuple(r) for r in zone_rules.zone_files(spark, folder).collect()] == [("Asia/Tokyo", bytearray(data))]


def test_rules_for_later_years():
    rule = zone_rules.Rule("<+0330>-3:30<+0430>,J79/24,J263/24")
    assert rule.standard == (12600, False, "+0330") and rule.summer == (16200, True, "+0430")
    assert zone_rules._day("M2.5.0", 2024) == 31 + 24 and zone_rules._day("J60", 2024) == 60 and zone_rules._day("J60", 2023) == 59 and zone_rules._day("60", 2024) == 60
    with pytest.raises(ValueError):
        zone_rules.Rule("EST5EDT")


def test_gaps_and_folds_stay(spark):
    at = lambda *x: datetime(2024, *x)
    rows = [
        (1, at(3, 31, 2, 30), "Europe/Berlin"), (2, at(10, 27, 2, 30), "Europe/Berlin"), (3, at(7, 1, 12, 0), "Europe/Berlin"), (4, at(7, 1), "Nowhere/Land"), (5, at(7, 1), None),
        (6, None, "Europe/Berlin"), (7, datetime(2150, 1, 1), "Europe/Berlin"), (8, at(3, 31, 3, 0), "Europe/Berlin"), (9, at(10, 27, 3, 0), "Europe/Berlin"), (10, datetime(1850, 1, 1), "Europe/Berlin"), (11, datetime(2150, 1, 1), "Asia/Tokyo"),
    ]
    df = spark.createDataFrame(rows, "id long, t timestamp_ntz, zone string")
    periods = zone_rules.read_zone_files(zone_rules.installed_zones(spark, ["Europe/Berlin", "Asia/Tokyo"]))
    got = {r["id"]: tuple(r)[1:] for r in offsets.to_utc(df, periods, "id", "t", "zone").collect()}
    assert got[1] == ("gap", None, None) and got[2] == ("ambiguous", at(10, 27, 0, 30), at(10, 27, 1, 30)) and got[3] == ("exact", at(7, 1, 10), at(7, 1, 10))
    assert all(got[k] == ("unknown", None, None) for k in (4, 5, 6, 7))
    assert got[8][:2] == ("exact", at(3, 31, 1)) and got[9][:2] == ("exact", at(10, 27, 2)) and got[10][:2] == ("exact", datetime(1849, 12, 31, 23, 6, 32)) and got[11][0] == "exact"
    local = {r["id"]: r["local"] for r in offsets.to_local(df, periods, "id", "t", "zone").collect()}
    assert local[3] == at(7, 1, 14) and local[1] == at(3, 31, 4, 30) and local[4] is local[5] is local[6] is local[7] is None and len(local) == len(rows)
