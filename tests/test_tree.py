"""Trees listed by tasks, and links in them."""

import os
import stat
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import commits
from ledgerloom.sources import tree as T


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "root"
    for i in range(30):
        folder = at / f"a{i % 3}" / f"b{i % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}").write_bytes(b"x" * i)
    (at / "empty" / "deeper").mkdir(parents=True)
    (at / "ü name").write_text("text")
    return at


def test_entries_equal_a_walk(spark, root):
    got = {r["path"]: (r["kind"], r["size"]) for r in T.entries(spark, str(root)).collect()}
    want = {}
    for d, folders, names in os.walk(root):
        want |= {os.path.relpath(os.path.join(d, n), root): ("folder", None) for n in folders}
        want |= {os.path.relpath(os.path.join(d, n), root): ("file", os.path.getsize(os.path.join(d, n))) for n in names}
    assert got == want
    assert T.entries(spark, f"file://{root}").count() == len(want)


def test_links_are_told_and_not_followed(spark, root, tmp_path):
    elsewhere = tmp_path / "elsewhere"
    elsewhere.mkdir()
    (elsewhere / "secret").write_text("not ours")
    (root / "a0" / "folder-link").symlink_to(elsewhere)
    (root / "a1" / "file-link").symlink_to(elsewhere / "secret")
    (root / "a1" / "dangling").symlink_to(elsewhere / "gone")
    (root / "loop").symlink_to(root)
    os.mkfifo(root / "pipe")
    found = T.entries(spark, str(root))
    kinds = {r["path"]: r["kind"] for r in found.collect()}
    assert {p for p, k in kinds.items() if k == "link"} == {"a0/folder-link", "a1/file-link", "a1/dangling", "loop"} and kinds["pipe"] == "other"
    assert not any("secret" in p for p in kinds)
    planned = spark.createDataFrame([("a0/folder-link/secret",), ("a0/folder-link/x/y",), ("a0/b0/f0",), ("loop/a0/folder-link/z",), ("a1/dangling",), ("a0/folder-linked",)], "path string")
    assert {tuple(r) for r in T.over_links(planned, found).collect()} == {("a0/folder-link/secret", "a0/folder-link"), ("a0/folder-link/x/y", "a0/folder-link"), ("loop/a0/folder-link/z", "loop"), ("a1/dangling", "a1/dangling")}
    with pytest.raises(ValueError, match="link"):
        commits.scan_tree(spark, str(root))


def test_kinds():
    """Reparse points of Windows are links, of whatever tag."""
    folder = {"st_mode": stat.S_IFDIR, "st_file_attributes": T.REPARSE_POINT | 0x10}
    assert T.kind_of(SimpleNamespace(**folder, st_reparse_tag=0xA0000003)) == ("link", "junction")
    assert T.kind_of(SimpleNamespace(**folder, st_reparse_tag=0xA000000C)) == ("link", "symbolic link")
    assert T.kind_of(SimpleNamespace(**folder, st_reparse_tag=0x9000001A)) == ("link", "reparse point")
    assert T.kind_of(SimpleNamespace(st_mode=stat.S_IFDIR, st_file_attributes=0x10)) == ("folder", None) and T.kind_of(SimpleNamespace(st_mode=stat.S_IFSOCK))[0] == "other"


def test_missing_root(spark, tmp_path):
    assert T.entries(spark, f"{tmp_path}/none").filter(F.col("kind") == T.UNREADABLE).count() == 1
