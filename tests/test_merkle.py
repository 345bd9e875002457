"""Trees of files against a plain recursive version."""

import hashlib
import random

from pyspark.sql import functions as F

from ledgerloom.operators import merkle as M

SCHEMA = "tree string, path string, sha string, size long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(files):
    """Digests of a nested dict: name to digest, or to a dict."""
    def of(kind, d, name):
        return f"{kind}:{d}:{name}"

    parts = {}
    for name, x in files.items():
        d = plain(x) if isinstance(x, dict) else x
        parts.setdefault(sha(name)[:3], []).append((name.encode(), of("folder" if isinstance(x, dict) else "file", d, name), d))
    if any(d is None for rows in parts.values() for *_, d in rows):
        return None
    return sha("\n".join(of("part", sha("\n".join(line for _, line, _ in sorted(rows))), part) for part, rows in sorted(parts.items())))


def nested(rows):
    out = {}
    for path, d in rows:
        *folders, name = path.split("/")
        at = out
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = d
    return out


def made(seed, n=120):
    r = random.Random(seed)
    return {"/".join([*(r.choice("abü") for _ in range(r.randrange(4))), f"f{i}.jpg"]): sha(str(i)) for i in range(n)}


def table(spark, trees):
    return spark.createDataFrame([(t, p, d, 3) for t, files in trees.items() for p, d in files.items()], SCHEMA)


def test_digests_equal_the_recursive_ones(spark):
    trees = {"one": made(1), "two": made(2, 7), "flat": {"x": sha("x")}, "hole": made(3, 20) | {"a/none": None}}
    found = M.nodes(table(spark, trees), "tree", "path", "sha", "size")
    got = {r["tree"]: r for r in M.roots(found).collect()}
    for t, files in trees.items():
        assert (got[t]["digest"], got[t]["n_files"], got[t]["n_bytes"]) == (plain(nested(files.items())), len(files), 3 * len(files))
    folder = found.filter("tree = 'one' and depth = 1 and kind = 'folder' and name = 'a'").first()
    assert folder["digest"] == plain(nested(trees["one"].items())["a"])


def test_odd_rows(spark):
    """Null and empty paths are left out; a path twice is one file if both agree, else unknown; no rows give no tree."""
    rows = [("t", "a/x", "1", 1), ("t", "a/x", "1", 1), ("t", None, "2", 1), ("t", "", "3", 1), ("t", "a/", "4", 1), ("u", "y", "1", 1), ("u", "y", "2", 1), ("v", "z", None, 1)]
    got = {r["tree"]: r for r in M.roots(M.nodes(spark.createDataFrame(rows, SCHEMA), "tree", "path", "sha")).collect()}
    assert got["t"]["digest"] == plain({"a": {"x": "1"}}) and got["t"]["n_files"] == 1 and got["u"]["digest"] is got["v"]["digest"] is None
    none = M.nodes(spark.createDataFrame([], SCHEMA), "tree", "path", "sha")
    assert none.count() == 0 and M.differences(none, none).count() == 0


def test_differences(spark):
    a = {"one": made(1), "same": made(4), "gone": made(5, 5)}
    b = {"one": dict(a["one"]), "same": dict(a["same"]), "new": made(6, 5)}
    paths = sorted(b["one"])
    b["one"][paths[3]], b["one"]["a/b/new"], b["one"][paths[9]] = sha("other"), sha("new"), None
    del b["one"][paths[5]]
    na, nb = (M.nodes(table(spark, x), "tree", "path", "sha") for x in (a, b))
    got = {(r["tree"], r["path"]): r["status"] for r in M.differences(na, nb).collect()}
    want = {("one", paths[3]): "changed", ("one", "a/b/new"): "added", ("one", paths[9]): "unknown", ("one", paths[5]): "removed"}
    want |= {("gone", p): "removed" for p in a["gone"]} | {("new", p): "added" for p in b["new"]}
    assert got == want


def test_a_folder_and_a_file_of_one_name(spark):
    na, nb = (M.nodes(spark.createDataFrame([("t", p, "1", 1)], SCHEMA), "tree", "path", "sha") for p in ("a", "a/b"))
    assert {(r["path"], r["status"]) for r in M.differences(na, nb).collect()} == {("a", "removed"), ("a/b", "added")}


def test_evidence_of_an_upgrade(spark):
    a = {"one": made(1), "two": made(2), "three": made(3) | {"n": None}}
    b = {"one": made(1) | {"manifest/format.json": sha("2")}, "two": made(2) | {"a/extra": sha("x")}, "three": made(3) | {"n": None}}
    na, nb = (M.nodes(table(spark, x), "tree", "path", "sha") for x in (a, b))
    got = {r["tree"]: r for r in M.evidence(na, nb, F.col("path").startswith("manifest/")).collect()}
    assert got["one"]["ok"] and (got["one"]["changed"], got["one"]["not_allowed"]) == (1, 0) and got["one"]["before"] != got["one"]["after"]
    assert not got["two"]["ok"] and got["two"]["not_allowed"] == 1 and not got["three"]["ok"] and got["three"]["before"] is None
