"""Coverage of an audit, verdicts on migrations, classes of copies."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import coverage as C
from ledgerloom.operators import independence as I

EXPECTED = "asset_id long, kind string, path string, sha256 string"


def test_states_and_bits(spark):
    expected = [
        (1, "media", "m1", "a"), (1, "xmp", "x1", "b"), (2, "media", "m2", "a"), (2, "xmp", "x2", "b"), (2, "blob", "b2", "c"), (3, "media", "m3", "a"), (4, "media", "m4", "a"), (4, "xmp", "x4", None),
        (5, "media", "m5", "a"), (5, "xmp", "x5", "b"), (5, "odd", "o5", "c"), (6, "media", "m6", "a"), (6, "media", "m6b", "z"), (6, "xmp", "x6", "b"), (7, "media", "m7", "a"), (7, "xmp", "x7", "b"), (None, "media", "m8", "a"),
    ]
    found = [(p, d) for _, _, p, d in expected if p not in ("b2", "m6b", "x7")] + [("m6b", "other"), ("x7", "b"), ("x7", "not b"), ("extra", "q"), ("m7", "a"), ("x4", "b")]
    states = C.item_states(spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(found, "path string, sha256 string"))
    told = {r["path"]: r["state"] for r in states.collect()}
    assert told["b2"] == "missing" and told["m6b"] == told["x7"] == "different" and told["x4"] == told["o5"] == "unknown" and told["extra"] == "unexpected" and told["m1"] == "verified"
    got = {r["asset_id"]: (r["expected"], r["verified"], r["lacking"], r["covered"]) for r in C.coverage(states).collect()}
    assert got[1] == (3, 3, [], True) and got[2] == (11, 3, ["blob"], False) and got[3] == (1, 1, ["xmp"], False) and got[4][2:] == (["xmp"], False)
    assert got[5][3] is False and got[6] == (3, 2, ["media"], False) and got[7][2:] == (["xmp"], False) and got[None][3] is False
    assert C.coverage(C.item_states(spark.createDataFrame([], EXPECTED), spark.createDataFrame(found, "path string, sha256 string"))).count() == 0


def test_migrations_fail_closed(spark):
    rows = [("good", True, "passed", "v", "1"), ("future", True, "passed", "v", "1"), ("foreign", True, "passed", "v", "1"), ("none", True, "passed", "v", "1"), ("open", False, "passed", "v", "1"), ("failed", True, "failed", "v", "1"), ("anon", True, "passed", None, "1"), ("null", None, None, None, None)]
    formats = [(k, "ledgerloom.archive", 1) for k in ("good", "open", "failed", "anon", "null", "empty")] + [("future", "ledgerloom.archive", 2), ("foreign", "other", 1), ("none", None, None)]
    assets, archives = spark.createDataFrame(rows, "k string, covered boolean, status string, validator string, version string"), spark.createDataFrame(formats, "k string, format string, format_version int")
    got = {r["k"]: r for r in C.verify_migration(assets, archives, "k").collect()}
    assert {k for k, r in got.items() if r["ready"]} == {"good"} and len(got) == 9
    assert all(got[k]["blockers"] == ["format"] for k in ("future", "foreign", "none")) and got["open"]["blockers"] == ["covered"] and got["failed"]["blockers"] == got["anon"]["blockers"] == ["validated"]
    legacy = C.verify_migration(assets, archives, "k", legacy_analysis=True).collect()
    assert not [r for r in legacy if r["ready"]] and {r["k"]: r["blockers"] for r in legacy}["none"] == ["not_legacy_analysis"]


def plain(copies):
    """Union-find."""
    up = {c[0]: c[0] for c in copies}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in (1, 2):
        first = {}
        for c in copies:
            if c[k] is not None:
                a, b = find(c[0]), find(first.setdefault(c[k], c[0]))
                up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_classes(spark):
    r = random.Random(1)
    copies = [(i, r.choice([None, f"p{r.randrange(60)}"]), r.choice([None, None, f"v{r.randrange(50)}"]), r.choice([True, False, None])) for i in range(150)]
    copies += [(1000 + i, f"chain{(i + 1) // 2}", f"chain{i // 2}", True) for i in range(64)]  # a long chain of shared paths and volumes
    df = spark.createDataFrame(copies, "copy_id long, path string, volume_id string, confirmed boolean")
    classes = I.copy_classes(df)
    assert {x["copy_id"]: x["class_id"] for x in classes.collect()} == plain(copies)
    assert I.redundancy(classes).first()["copies"] == len(copies)


def test_redundancy(spark):
    def verdict(rows):
        return I.redundancy(I.copy_classes(spark.createDataFrame(rows, "copy_id long, path string, volume_id string, confirmed boolean"))).first()["verdict"]

    assert verdict([(1, "a", "v", True), (2, "b", "w", True)]) == "independent"
    assert verdict([(1, "a", "v", True), (2, "b", "v", True)]) == verdict([(1, "a", "v", True), (2, "a", "w", True)]) == verdict([(1, "a", "v", True), (2, "b", "v", True), (3, "b", "w", True)]) == verdict([]) == "not_independent"
    assert verdict([(1, "a", "v", True), (2, "b", "w", False)]) == verdict([(1, "a", "v", True), (2, "b", None, True)]) == "not_proven"
    two = I.copy_classes(spark.createDataFrame([(1, "a", "v", True), (2, "b", "w", None)], "copy_id long, path string, volume_id string, confirmed boolean"))
    assert [tuple(x) for x in I.class_verdicts(two).collect()] == [(1, 2, "not_proven")] and two.filter(F.col("class_id").isNull()).count() == 0
